"""Plans of ranking metrics and ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import ranking as r
from routeloom.plans.registry import QRELS_SQL, plan, qrels, table

CUTOFFS = [1, 5, 10]

# Every order is ranked by the parts of its own lines and of the next order key, by price: half-right rankings.
_RANKED_SQL = f"""{QRELS_SQL},
cand AS (SELECT l_orderkey AS query_id, l_partkey AS skill_id, l_extendedprice AS score FROM lineitem
         UNION ALL SELECT l_orderkey - 1, l_partkey, l_extendedprice FROM lineitem),
best AS (SELECT query_id, skill_id, max(score) AS score FROM cand GROUP BY ALL),
ranked AS (SELECT query_id, skill_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, skill_id) - 1 AS rank FROM best),
rel AS (SELECT query_id, skill_id FROM qrels),
sizes AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
hits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS hit FROM ranked JOIN rel USING (query_id, skill_id) WHERE rank < 10),
ks AS (SELECT unnest([1, 5, 10]) AS k),
agg AS (SELECT s.query_id, k, n, count(h.rank) AS hits, coalesce(sum(1 / log2(h.rank + 2)), 0) AS dcg,
        coalesce(sum(h.hit / (h.rank + 1)), 0) AS ap, min(h.rank) AS first
        FROM sizes s CROSS JOIN ks LEFT JOIN hits h ON h.query_id = s.query_id AND h.rank < k GROUP BY ALL),
m AS (SELECT query_id, k, hits / n AS recall,
      dcg / list_sum(list_transform(range(0, least(n, k)), lambda i: 1 / log2(i + 2))) AS ndcg, ap / least(n, k) AS map,
      coalesce(1 / (first + 1), 0) AS mrr, CASE WHEN hits = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS completeness FROM agg)"""
_NAMES = ("recall", "ndcg", "map", "mrr", "completeness")


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("skill_id"), F.col("l_extendedprice").alias("score"))
    cand = lines.union(lines.withColumn("query_id", F.col("query_id") - 1))
    best = cand.groupBy("query_id", "skill_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "skill_id")) - 1
    rel = qrels(spark, sf_dir).select("query_id", "skill_id")
    return best.select("query_id", "skill_id", rank.alias("rank")), rel


@plan(
    "query_metrics",
    f"WITH {_RANKED_SQL} SELECT query_id, k::INTEGER AS k, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _NAMES)} FROM m",
)
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, rel = _ranked(spark, sf_dir)
    return r.query_metrics(ranked, rel, CUTOFFS).select("query_id", "k", *(F.round(c, 6).alias(c) for c in _NAMES))


@plan(
    "macro_metrics",
    f"WITH {_RANKED_SQL} SELECT k::INTEGER AS k, count(*) AS queries, {', '.join(f'round(avg({c}), 6)::DOUBLE AS {c}' for c in _NAMES)} FROM m GROUP BY k",
)
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, rel = _ranked(spark, sf_dir)
    return r.macro_average(r.query_metrics(ranked, rel, CUTOFFS)).select("k", "queries", *(F.round(c, 6).alias(c) for c in _NAMES))


@plan(
    "popularity_baseline",
    f"""WITH {QRELS_SQL},
    top AS (SELECT skill_id, row_number() OVER (ORDER BY count(*) DESC, skill_id) - 1 AS rank FROM qrels GROUP BY skill_id ORDER BY rank LIMIT 10),
    h AS (SELECT query_id, count(*) AS n, count(t.rank) FILTER (t.rank < 1) AS h1, count(t.rank) FILTER (t.rank < 10) AS h10
          FROM qrels q LEFT JOIN top t USING (skill_id) GROUP BY query_id)
    SELECT count(*) AS queries, round(avg(h1 / n), 6) AS recall_1, round(avg(h10 / n), 6) AS recall_10, round(10 / (SELECT count(*) FROM part), 6) AS random_10 FROM h""",
)
def popularity_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = qrels(spark, sf_dir)
    top = r.popularity_ranking(rel, 10)
    # the ranking is the same for all queries: ten rows, joined to the judgements instead of crossed with the queries
    hits = rel.join(F.broadcast(top), "skill_id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") < 1).alias("h1"), F.count_if(F.col("rank") < 10).alias("h10")
    )
    skills = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("skills"))
    mean = hits.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("h1") / F.col("n")).alias("a"), F.avg(F.col("h10") / F.col("n")).alias("b"))
    both = mean.crossJoin(skills)  # one row each
    return both.select("queries", F.round("a", 6).alias("recall_1"), F.round("b", 6).alias("recall_10"), F.round(F.least(F.lit(10), "skills") / F.col("skills"), 6).alias("random_10"))


@plan(
    "ranked_catalog",
    """WITH e AS (SELECT min(p_size) AS boundary FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 50)),
    c AS (SELECT p_partkey, p_size, p_retailprice, boundary, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS position
          FROM part, e WHERE p_size >= boundary)
    SELECT p_partkey, p_size, boundary, position::INTEGER AS position FROM c WHERE position <= 50""",
)
def ranked_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")]
    return r.tie_complete_top(table(spark, sf_dir, "part"), order, F.col("p_size"), 50).select("p_partkey", "p_size", "boundary", "position")


@plan(
    "top_three_per_group",
    """SELECT p_brand, p_partkey, position::INTEGER AS position FROM (SELECT p_brand, p_partkey,
       row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey DESC) AS position FROM part) WHERE position <= 3""",
)
def top_three_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("p_retailprice"), F.col("p_size"), F.desc("p_partkey")]
    return r.top_per_key(table(spark, sf_dir, "part"), ["p_brand"], order, 3).select("p_brand", "p_partkey", "position")


_PATHS_SQL = f"""{QRELS_SQL},
codes AS (SELECT p_partkey AS skill_id, p_brand || '/' || p_size AS path FROM part),
gold AS (SELECT query_id, skill_id, ord, path FROM qrels JOIN codes USING (skill_id)),
scored AS (SELECT l_orderkey AS query_id, path, max(l_extendedprice) AS score FROM lineitem JOIN codes ON skill_id = l_partkey WHERE l_discount < 0.06 GROUP BY ALL),
pred AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS path_rank FROM scored)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), F.concat_ws("/", "p_brand", "p_size").alias("path"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").filter("l_discount < 0.06").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("skill_id"), "l_extendedprice")
    # one shuffle by query serves the maximum and the ranks
    scored = lines.join(_codes(spark, sf_dir), "skill_id").repartition("query_id").groupBy("query_id", "path").agg(F.max("l_extendedprice").alias("score"))
    return scored.withColumn("path_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path")))


@plan(
    "bucket_candidates",
    f"""WITH {_PATHS_SQL},
    wide AS (SELECT query_id, skill_id, score, path_rank FROM pred JOIN codes USING (path)),
    best AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY query_id, skill_id ORDER BY score DESC, path_rank) = 1)
    SELECT query_id, skill_id, score, path_rank::INTEGER AS path_rank, position::INTEGER AS position FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path_rank, skill_id) AS position FROM best) WHERE position <= 8""",
)
def bucket_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = _codes(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))
    return r.bucket_candidates(_predicted(spark, sf_dir), buckets, 8).select("query_id", "skill_id", "score", "path_rank", "position")


_PATH_NAMES = ("code_recall", "bucket_recall", "bucket_completeness", "ordered_exact", "count_match", "count_error")


@plan(
    "path_metrics",
    f"""WITH {_PATHS_SQL},
    gp AS (SELECT query_id, list(path ORDER BY ord, path) AS gold_paths FROM (SELECT query_id, path, min(ord) AS ord FROM gold GROUP BY ALL) GROUP BY query_id),
    gs AS (SELECT query_id, count(DISTINCT skill_id) AS n FROM gold GROUP BY query_id),
    pl AS (SELECT query_id, list(path ORDER BY path_rank) AS paths FROM pred GROUP BY query_id),
    j AS (SELECT gp.query_id, gold_paths, n, coalesce(paths, []) AS paths, k FROM gp JOIN gs USING (query_id) LEFT JOIN pl USING (query_id) CROSS JOIN (SELECT unnest([1, 3]) AS k)),
    f AS (SELECT g.query_id, k, count(DISTINCT g.skill_id) AS found FROM (SELECT unnest([1, 3]) AS k) JOIN pred p ON path_rank <= k JOIN gold g ON g.query_id = p.query_id AND g.path = p.path GROUP BY ALL),
    m AS (SELECT j.query_id, j.k, len(list_intersect(gold_paths, paths[1:j.k])) / len(gold_paths) AS code_recall, coalesce(found, 0) / n AS bucket_recall,
      CASE WHEN coalesce(found, 0) = n THEN 1 ELSE 0 END AS bucket_completeness, CASE WHEN paths = gold_paths THEN 1 ELSE 0 END AS ordered_exact,
      CASE WHEN len(paths) = len(gold_paths) THEN 1 ELSE 0 END AS count_match, abs(len(paths) - len(gold_paths)) AS count_error
      FROM j LEFT JOIN f ON f.query_id = j.query_id AND f.k = j.k)
    SELECT k::INTEGER AS k, count(*) AS queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _PATH_NAMES)} FROM m GROUP BY k""",
)
def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("skill_id"), F.col("l_linenumber").alias("ord"))
    gold = lines.join(codes, "skill_id")  # pairs may repeat, the least place counts
    pred = _predicted(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("path_rank", "path"))).alias("p"))
    buckets = codes.groupBy("path").agg(F.collect_set("skill_id").alias("skills"))
    found = r.path_metrics(pred.select("query_id", F.col("p.path").alias("paths")), gold, [1, 3], buckets)
    return r.macro_average(found).select("k", "queries", *(F.round(c, 6).alias(c) for c in _PATH_NAMES))


@plan(
    "greedy_then_fill",
    """WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS k, min(l_linenumber) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    t AS (SELECT l_orderkey AS query_id, l_partkey AS k, max(l_quantity) AS o FROM lineitem GROUP BY ALL),
    a AS (SELECT query_id, k::VARCHAR AS path, 0 AS s, row_number() OVER (PARTITION BY query_id ORDER BY o, k) AS p FROM r),
    b AS (SELECT query_id, k::VARCHAR AS path, 1 AS s, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, k) AS p FROM t),
    u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY s, p) = 1)
    SELECT query_id, path, CASE WHEN s = 0 THEN 'greedy' ELSE 'beam' END AS source, position::INTEGER AS position FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, p) AS position FROM u) WHERE position <= 3""",
)
def greedy_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("part"), "l_linenumber", "l_quantity", "l_returnflag")
    a = lines.filter("l_returnflag = 'R'").groupBy("query_id", "part").agg(F.min("l_linenumber").alias("o"))
    a = a.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "part")))
    b = lines.groupBy("query_id", "part").agg(F.max("l_quantity").alias("o"))
    b = b.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o"), "part")))
    cut = lambda x: x.select("query_id", F.col("part").cast("string").alias("path"), "position")
    return r.greedy_then_fill(cut(a), cut(b), 3)
