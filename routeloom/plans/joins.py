"""Plans of joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import joins as j
from routeloom.plans.registry import QRELS_SQL, plan, qrels, table


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("skill_id"), F.concat_ws("/", "p_brand", "p_type").alias("path"))


_CODES_SQL = "codes AS (SELECT p_partkey AS skill_id, p_brand || '/' || p_type AS path FROM part WHERE p_size <= 45)"


@plan(
    "ordered_targets",
    f"""WITH {QRELS_SQL}, {_CODES_SQL}, f AS (SELECT query_id, path, min(ord) AS ord FROM qrels JOIN codes USING (skill_id) GROUP BY ALL)
    SELECT query_id, string_agg(path, ' ; ' ORDER BY ord, path) AS target_paths, count(*)::INTEGER AS n_targets FROM f GROUP BY query_id""",
)
def ordered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = j.ordered_targets(qrels(spark, sf_dir), _codes(spark, sf_dir))
    return found.withColumn("target_paths", F.array_join("target_paths", " ; "))


@plan(
    "targets_without_code",
    f"WITH {QRELS_SQL}, {_CODES_SQL} SELECT query_id, skill_id FROM qrels WHERE skill_id NOT IN (SELECT skill_id FROM codes)",
)
def targets_without_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.ordered_targets(qrels(spark, sf_dir), _codes(spark, sf_dir))[1]


@plan("memorization_rows", "SELECT p_partkey AS skill_id, p_name AS input_text, p_brand || '/' || p_type AS target_text FROM part WHERE p_size <= 45")
def memorization_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("input_text"))
    return catalog.join(_codes(spark, sf_dir), "skill_id").withColumnRenamed("path", "target_text")


_REDUCED_SQL = f"""WITH {QRELS_SQL}, catalog AS (SELECT p_partkey AS skill_id FROM part WHERE p_brand <> 'Brand#11'),
q AS (SELECT o_orderkey AS query_id FROM orders WHERE o_orderstatus <> 'P'),
known AS (SELECT * FROM qrels WHERE skill_id IN (SELECT skill_id FROM catalog)),
kept AS (SELECT * FROM q WHERE query_id IN (SELECT query_id FROM known))"""


def _reduced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    catalog = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("skill_id"))
    queries = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("query_id"))
    return j.semijoin_reduced(queries, qrels(spark, sf_dir), catalog)


@plan("kept_queries", f"{_REDUCED_SQL} SELECT query_id FROM kept")
def kept_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir)[0]


@plan("kept_qrels", f"{_REDUCED_SQL} SELECT query_id, skill_id FROM known WHERE query_id IN (SELECT query_id FROM kept)")
def kept_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir)[1].select("query_id", "skill_id")


@plan("missing_reviews", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@plan("review_default", "SELECT d.doc_id, coalesce(l.quality, 0)::INTEGER AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def review_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return j.with_default(docs, table(spark, sf_dir, "labels"), "doc_id", "quality", F.lit(0)).withColumn("quality", F.col("quality").cast("int"))


@plan(
    "compared_assignments",
    """WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey * 3 AS k, s_nationkey AS v FROM supplier)
    SELECT k, CASE WHEN b_k IS NULL THEN 'missing' WHEN a_k IS NULL THEN 'extra' ELSE 'different' END AS status FROM
    (SELECT coalesce(a.k, b.k) AS k, a.k AS a_k, b.k AS b_k, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.k = b.k)
    WHERE a_k IS NULL OR b_k IS NULL OR av IS DISTINCT FROM bv""",
)
def compared_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_nationkey").alias("v"))
    return j.compared(a, b, ["k"], "v")


@plan(
    "frequency_bins",
    f"""WITH {QRELS_SQL}, f AS (SELECT p_partkey, count(query_id) AS n FROM part LEFT JOIN qrels ON skill_id = p_partkey GROUP BY p_partkey)
    SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bin, count(*) AS skills FROM f GROUP BY 1""",
)
def frequency_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = qrels(spark, sf_dir).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    skills = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"))
    all_counts = j.with_default(skills, counts, "skill_id", "n", F.lit(0))
    return j.binned(all_counts, "n", j.FREQUENCY_BINS).groupBy("bin").agg(F.count(F.lit(1)).alias("skills"))


@plan(
    "confusable_skills",
    """WITH p AS (SELECT p_partkey AS id, p_size AS rank, p_brand AS domain, [p_type] AS roles, list_distinct(string_split(lower(p_name), ' ')) AS f FROM part),
    c AS (SELECT a.id AS skill_id, b.id AS confusable_id, b.rank, round(len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f)))
      + CASE WHEN a.domain = b.domain THEN 0.08::DOUBLE ELSE 0 END + 0.02::DOUBLE * len(list_intersect(a.roles, b.roles)), 9) AS score
      FROM p a JOIN p b ON a.id <> b.id AND (a.domain = b.domain OR a.roles = b.roles)),
    r AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY score DESC, rank, confusable_id DESC) AS position FROM c)
    SELECT skill_id, confusable_id, score, position::INTEGER AS position FROM r WHERE position <= 3""",
)
def confusable_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("skill_id"),
        F.col("p_size").alias("rank"),
        F.col("p_brand").alias("domain"),
        F.array("p_type").alias("roles"),
        F.array_distinct(F.split(F.lower("p_name"), " ")).alias("features"),
    )
    return j.confusable(part)


@plan(
    "neighbour_domains",
    """SELECT c.c_custkey, count(*) AS reachable FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
       JOIN nation m ON m.n_regionkey = n.n_regionkey JOIN supplier s ON s.s_nationkey = m.n_nationkey GROUP BY c.c_custkey""",
)
def neighbour_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    neighbours = nation.alias("n").join(nation.alias("m"), F.col("n.n_regionkey") == F.col("m.n_regionkey"))
    per_domain = neighbours.join(table(spark, sf_dir, "supplier"), F.col("m.n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n.n_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("reachable"))
    return table(spark, sf_dir, "customer").join(per_domain, "c_nationkey").select("c_custkey", "reachable")


@plan("best_owner_matches")
def best_owner_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l"), F.col("c_nationkey").alias("block"), F.col("c_acctbal").alias("x"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r"), F.col("s_nationkey").alias("block"), F.col("s_acctbal").alias("y"))
    return j.best_matches(a, b, "block", F.round(-F.abs(F.col("x") - F.col("y")), 2), -500.0)


@plan(
    "unseen_owners",
    """WITH n AS (SELECT o_custkey AS owner, floor(o_totalprice)::BIGINT AS k, o_orderkey FROM orders WHERE o_orderdate >= '2001-06-01'),
    s AS (SELECT DISTINCT floor(o_totalprice)::BIGINT AS k FROM orders WHERE o_orderdate < '2001-06-01'),
    lost AS (SELECT owner FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) > 1 UNION SELECT owner FROM n WHERE k IN (SELECT k FROM s))
    SELECT owner, k, o_orderkey FROM n WHERE owner NOT IN (SELECT owner FROM lost)""",
)
def unseen_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.floor("o_totalprice").cast("long").alias("k"), "o_orderkey", "o_orderdate")
    new = F.col("o_orderdate") >= F.lit("2001-06-01")
    return j.without_seen(orders.filter(new), orders.filter(~new), "owner", "k", [F.col("o_orderkey")]).drop("o_orderdate")


@plan("under_prefix", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def under_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    codes = codes.select("c_custkey", F.array(F.col("n_regionkey"), F.col("n_nationkey") % 2).alias("indices"))
    return j.under_prefix(codes, [2, 0]).select("c_custkey")


@plan(
    "collapsed_variants",
    "SELECT DISTINCT CASE WHEN l_orderkey % 3 = 1 AND l_orderkey > 1 THEN l_orderkey - 1 ELSE l_orderkey END AS query_id, l_partkey AS skill_id FROM lineitem",
)
def collapsed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("skill_id"))
    variants = lines.select(F.col("query_id").alias("variant_id")).distinct().filter("variant_id % 3 = 1 and variant_id > 1")
    return j.collapsed_variants(lines, variants.withColumn("source_id", F.col("variant_id") - 1))


@plan(
    "shared_keys",
    "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("P"))


@plan("unused_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@plan(
    "appended_rounds",
    """SELECT k, name, source, extra FROM (SELECT c_custkey AS k, c_name AS name, 'a' AS source, c_mktsegment AS extra FROM customer WHERE c_custkey % 2 = 0
       UNION ALL SELECT s_suppkey, s_name, 'b', NULL FROM supplier)""",
)
def appended_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("a").alias("source"), F.col("c_mktsegment").alias("extra"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("b").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@plan(
    "unequal_sets",
    """WITH a AS (SELECT l_orderkey AS q, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
    b AS (SELECT l_orderkey AS q, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
    SELECT q, len(a.s)::INTEGER AS left_size, len(b.s)::INTEGER AS right_size, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard,
    (len(list_intersect(a.s, b.s)) = len(a.s)) AS is_subset FROM a JOIN b USING (q) WHERE a.s <> b.s""",
)
def unequal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), "l_suppkey", "l_linenumber", "l_returnflag")
    of = lambda cond, name: lines.filter(cond).groupBy("q").agg(F.array_sort(F.collect_set("l_suppkey")).alias(name))
    both = of("l_linenumber <= 3", "a").join(of("l_returnflag <> 'A'", "b"), "q").filter("a <> b")
    return both.select(
        "q",
        F.size("a").alias("left_size"),
        F.size("b").alias("right_size"),
        F.round(j.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"),
        (F.size(F.array_except("a", "b")) == 0).alias("is_subset"),
    )


@plan(
    "added_counters",
    """SELECT k, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY k""",
)
def added_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.union(b).groupBy("k").agg(F.sum("n").alias("n"))


@plan(
    "replaced_source",
    """SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src3' UNION ALL SELECT doc_id + 1000000, 'src3' FROM documents WHERE lang = 'es'""",
)
def replaced_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = docs.filter(~F.col("source").eqNullSafe(F.lit("src3"))).select("doc_id", "source")
    return kept.union(docs.filter("lang = 'es'").select(F.col("doc_id") + 1000000, F.lit("src3")))
