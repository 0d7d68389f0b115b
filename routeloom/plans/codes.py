"""Plans of code assignment, taxonomies, registries and decoding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import codes as c
from routeloom.operators import decoding as d
from routeloom.operators import documents
from routeloom.plans.registry import plan, table

_SIZES = [16, 8]
# The nearest of 16, then of 8 halved vectors, by distance over the residual.
_RQ_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM v),
b1 AS (SELECT r AS i, v AS c FROM s WHERE r < 16), b2 AS (SELECT r - 16 AS i, list_transform(v, lambda x: x / 2) AS c FROM s WHERE r BETWEEN 16 AND 23),
d1 AS (SELECT vec_id, v, i, c, round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 10) AS d FROM v, b1),
n1 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1),
r1 AS (SELECT vec_id, i AS i1, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS v FROM n1),
d2 AS (SELECT vec_id, i1, i, round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 10) AS d FROM r1, b2),
n2 AS (SELECT vec_id, i1, i AS i2, d FROM d2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


@plan("residual_codes", f"WITH {_RQ_SQL} SELECT vec_id, i1::VARCHAR || '/' || i2::VARCHAR AS path, round(d, 5) AS error FROM n2")
def residual_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    found = c.residual_codes(vectors, c.seeded_codebooks(vectors, _SIZES))
    return found.select("vec_id", F.array_join(F.col("indices").cast("array<string>"), "/").alias("path"), F.round("error", 5).alias("error"))


@plan("beam_paths")
def beam_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return c.beam_paths(vectors, c.seeded_codebooks(vectors, _SIZES), 3).withColumn("error", F.round("error", 5))


@plan("free_codes")
def free_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    books = c.seeded_codebooks(vectors, _SIZES)
    known = F.coalesce(F.col("label") < 5, F.lit(False))
    taken = c.residual_codes(vectors.filter(known), books)
    return c.free_codes(c.beam_paths(vectors.filter(~known), books, 4), taken).withColumn("error", F.round("error", 5))


@plan("fitted_codes")
def fitted_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.fit_codebook(_vectors(spark, sf_dir), 12, 8, 5)[1]


@plan("balanced_codes")
def balanced_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return c.balanced_hierarchical_codes(vectors, c.seeded_codebooks(vectors, _SIZES))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), "s_acctbal")
    return suppliers.select("sample", "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("code")).select(
        "sample", "code", F.abs(F.col("s_acctbal") / 1000 - F.col("code") * 2).alias("cost")
    )


@plan("sinkhorn_assignment")
def sinkhorn_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.round_plan(c.sinkhorn(_costs(spark, sf_dir), 0.5, 5))


@plan(
    "balanced_capacities",
    """WITH n AS (SELECT s_nationkey % 7 AS code, count(*) AS n FROM supplier GROUP BY 1), f AS (SELECT i AS code, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 7)) AS i) LEFT JOIN n ON code = i)
    SELECT code::INTEGER AS code, ((SELECT count(*) FROM supplier) // 7 + CASE WHEN row_number() OVER (ORDER BY n DESC, code) <= (SELECT count(*) FROM supplier) % 7 THEN 1 ELSE 0 END)::INTEGER AS capacity FROM f""",
)
def balanced_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    demand = suppliers.groupBy((F.col("s_nationkey") % 7).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return c.balanced_capacities(demand, 7, suppliers.count())


@plan("deferred_assignment")
def deferred_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _costs(spark, sf_dir)
    nearest = costs.groupBy("sample").agg(F.min(F.struct("cost", "code"))["code"].alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return c.deferred_assignment(costs, c.balanced_capacities(nearest, 5, table(spark, sf_dir, "supplier").count()))


@plan("grouped_assignment")
def grouped_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("group"))
    return c.grouped_assignment(_costs(spark, sf_dir).join(groups, "sample"))


@plan("usage_penalized", """WITH c AS (SELECT s_suppkey AS sample, code, abs(s_acctbal / 1000 - code * 2) AS cost FROM supplier, (SELECT unnest(range(0, 5)) AS code)),
    u AS (SELECT s_nationkey % 5 AS code, count(*) AS n FROM supplier GROUP BY 1), p AS (SELECT sample, c.code, cost + 0.3::DOUBLE * coalesce(n / (SELECT sum(n) FROM u), 0) AS price FROM c LEFT JOIN u ON u.code = c.code)
    SELECT sample, code::INTEGER AS code FROM p QUALIFY row_number() OVER (PARTITION BY sample ORDER BY price, code) = 1""")  # fmt: skip
def usage_penalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return c.usage_penalized(_costs(spark, sf_dir), usage, 0.3)


_TAXONOMY = "t AS (SELECT c_custkey, r_name, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


@plan(
    "taxonomy_codes",
    f"""WITH {_TAXONOMY}, a AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM (SELECT DISTINCT r_name FROM t)),
    b AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i FROM (SELECT DISTINCT r_name, n_name FROM t)),
    c AS (SELECT n_name, c_mktsegment, row_number() OVER (PARTITION BY n_name ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT n_name, c_mktsegment FROM t))
    SELECT c_custkey, a.i::VARCHAR || '/' || b.i::VARCHAR || '/' || c.i::VARCHAR AS path FROM t JOIN a USING (r_name) JOIN b USING (r_name, n_name) JOIN c USING (n_name, c_mktsegment)""",
)
def taxonomy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taxonomy(spark, sf_dir).select("c_custkey", F.array_join(F.col("indices").cast("array<string>"), "/").alias("path"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.taxonomy_codes(_labels(spark, sf_dir), ["r_name", "n_name", "c_mktsegment"], "c_custkey")


@plan(
    "code_tree",
    f"""WITH {_TAXONOMY}, a AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM (SELECT DISTINCT r_name FROM t)),
    b AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i FROM (SELECT DISTINCT r_name, n_name FROM t)),
    p AS (SELECT a.i::VARCHAR AS x, a.i::VARCHAR || '/' || b.i::VARCHAR AS y FROM t JOIN a USING (r_name) JOIN b USING (r_name, n_name))
    SELECT '' AS prefix, 0::INTEGER AS depth, count(*) AS skills FROM p UNION ALL SELECT x, 1, count(*) FROM p GROUP BY x UNION ALL SELECT y, 2, count(*) FROM p GROUP BY y""",
)
def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _taxonomy(spark, sf_dir).select(F.slice("indices", 1, 2).cast("array<string>").alias("tokens"))
    return documents.code_tree(codes, "tokens")


@plan(
    "prefix_table",
    """WITH p AS (SELECT DISTINCT [p_brand, p_type, p_size::VARCHAR] AS t FROM part), x AS (SELECT t, unnest(range(0, 3)) AS d FROM p)
    SELECT array_to_string(t[1:d], '/') AS prefix, count(DISTINCT t[d + 1])::INTEGER AS n_next, min(t[d + 1]) AS first_next FROM x GROUP BY 1""",
)
def prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "part").select(F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("tokens"))
    found = d.prefix_table(paths)
    return found.select(F.array_join("prefix", "/").alias("prefix"), F.size("allowed").alias("n_next"), F.get("allowed", F.lit(0)).alias("first_next"))


@plan(
    "parsed_sequences",
    """WITH s AS (SELECT l_orderkey AS q, list(p_brand || '/' || p_type ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT q, len(p)::INTEGER AS n_paths, (len(p) <= 4 AND len(list_distinct(p)) = len(p)) AS valid FROM s""",
)
def parsed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    text = lines.groupBy(F.col("l_orderkey").alias("q")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(" ", "p_brand", F.replace("p_type", F.lit(" "), F.lit("_"))).alias("p")))).alias("l")
    )
    known = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", F.replace("p_type", F.lit(" "), F.lit("_"))).alias("path")).distinct()
    return d.parsed_sequences(text.select("q", F.array_join(F.col("l.p"), " <sep> ").alias("text")), known, "q", 4)


@plan("beam_decoding")
def beam_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "part").select(F.array("p_brand", "p_type").alias("tokens"), "p_retailprice")
    steps = d.synthetic_scores(scores, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id")))
    return d.beam_decode(steps, 2, 4).withColumn("score", F.round("score", 6))


@plan("searched_catalog", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || chr(10) || p_brand || chr(10) || p_type), 'brand#12') ORDER BY p_name, p_partkey LIMIT 40")
def searched_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.catalog_search(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "Brand#12 ", ["p_name", "p_partkey"], 40)[0].select("p_partkey", "p_name")


@plan(
    "patched_catalog",
    """WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS name FROM supplier)
    SELECT p_partkey, coalesce(nullif(name, ''), p_name) AS p_name FROM part LEFT JOIN p ON k = p_partkey""",
)
def patched_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit(1).alias("seq"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise("").alias("p_name"))
    return documents.patched(table(spark, sf_dir, "part").select("p_partkey", "p_name"), patches, "p_partkey", ["p_name"])
