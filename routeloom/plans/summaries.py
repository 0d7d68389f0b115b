"""Plans of aggregates and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import summaries as s
from routeloom.plans.registry import QRELS_SQL, plan, qrels, table


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("skill_id"),
        F.array((F.col("p_size") % 16), F.substring("p_brand", -1, 1).cast("int")).alias("indices"),
        F.concat_ws("/", F.col("p_size") % 16, F.substring("p_brand", -1, 1)).alias("path"),
    )


_CODES_SQL = "codes AS (SELECT p_partkey AS skill_id, p_size % 16 AS c1, right(p_brand, 1)::INTEGER AS c2, (p_size % 16)::VARCHAR || '/' || right(p_brand, 1) AS path FROM part)"


@plan(
    "positive_lists",
    """WITH f AS (SELECT l_orderkey AS query_id, l_partkey AS skill_id, min(l_linenumber) AS ord FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
    SELECT query_id, string_agg(skill_id::VARCHAR, ',' ORDER BY ord, skill_id) AS skills, count(*)::INTEGER AS n FROM f GROUP BY query_id""",
)
def positive_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("skill_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("relevance")
    )
    return s.positive_lists(lines).select("query_id", F.array_join(F.col("skills").cast("array<string>"), ",").alias("skills"), F.size("skills").alias("n"))


@plan("code_buckets", f"WITH {_CODES_SQL} SELECT path, string_agg(skill_id::VARCHAR, ',' ORDER BY skill_id) AS skills FROM codes GROUP BY path")
def code_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.buckets(_codes(spark, sf_dir)).withColumn("skills", F.array_join(F.col("skills").cast("array<string>"), ","))


_Q = ", ".join(f"round(quantile_cont(n, {q}), 6) AS {name}" for name, q in s.QUANTILES.items())


@plan("target_quantiles", f"WITH {QRELS_SQL}, f AS (SELECT skill_id, count(*)::DOUBLE AS n FROM qrels GROUP BY skill_id) SELECT {_Q} FROM f")
def target_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.quantiles(qrels(spark, sf_dir).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n")), "n")


@plan("price_quantiles_by_brand", "SELECT p_brand, " + _Q.replace("(n,", "(p_retailprice,") + " FROM part GROUP BY p_brand")
def price_quantiles_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.quantiles(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])


@plan("targets_histogram", f"WITH {QRELS_SQL}, f AS (SELECT query_id, count(*) AS targets FROM qrels GROUP BY query_id) SELECT targets, count(*) AS n FROM f GROUP BY targets")
def targets_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.histogram(qrels(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("targets")), "targets")


_LEVELS = """lv AS (SELECT 1 AS level, 16 AS size UNION ALL SELECT 2, 10), space AS (SELECT level, size, unnest(range(0, size)) AS code FROM lv),
used AS (SELECT 1 AS level, c1 AS code, count(*) AS n FROM codes GROUP BY ALL UNION ALL SELECT 2, c2, count(*) FROM codes GROUP BY ALL),
full_ AS (SELECT s.level, s.size, s.code, coalesce(n, 0) AS n FROM space s LEFT JOIN used u ON u.level = s.level AND u.code = s.code),
tot AS (SELECT level, sum(n)::DOUBLE AS t FROM full_ GROUP BY level)"""


@plan(
    "code_level_metrics",
    f"""WITH {_CODES_SQL}, {_LEVELS}
    SELECT level::INTEGER AS level, size::INTEGER AS size, count(*) FILTER (n > 0) AS used_codes, round(count(*) FILTER (n > 0) / size, 6) AS utilization,
    round(-sum(CASE WHEN n > 0 THEN n / t * ln(n / t) ELSE 0 END), 6) AS entropy, round(-sum(CASE WHEN n > 0 THEN n / t * ln(n / t) ELSE 0 END) / ln(size), 6) AS normalized_entropy,
    round(stddev_pop(n) / avg(n), 6) AS variation, min(n)::BIGINT AS min_usage, max(n)::BIGINT AS max_usage FROM full_ JOIN tot USING (level) GROUP BY level, size""",
)
def code_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.code_level_metrics(_codes(spark, sf_dir), [16, 10])
    rounded = {c: F.round(c, 6) for c in ("utilization", "entropy", "normalized_entropy", "variation")}
    return found.withColumns(rounded | {c: F.col(c).cast("long") for c in ("min_usage", "max_usage")})


_COLLISION = "b AS (SELECT path, count(*) AS n FROM codes GROUP BY path), m AS (SELECT sum(n)::BIGINT AS skills, count(*) AS paths, (sum(n) - count(*)) / sum(n) AS collision_rate, max(n) AS max_bucket, avg(n) AS mean_bucket, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS colliding_rate FROM b)"


@plan("collision_metrics", f"WITH {_CODES_SQL}, {_COLLISION} SELECT skills, paths, round(collision_rate, 6) AS collision_rate, max_bucket, round(mean_bucket, 6) AS mean_bucket, round(colliding_rate, 6) AS colliding_rate FROM m")
def collision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.collision_metrics(_codes(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("collision_rate", "mean_bucket", "colliding_rate")})


_LIMITS = [("collision_rate", "max", 0.05), ("max_bucket", "max", 1000.0), ("paths", "min", 10.0), ("mean_bucket", "max", 2.0)]


@plan(
    "code_quality_gate",
    f"WITH {_CODES_SQL}, {_COLLISION}, u AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::DOUBLE AS value, '{b}' AS bound, {x}::DOUBLE AS \"limit\" FROM m" for n, b, x in _LIMITS)
    + ") SELECT metric, round(value, 6) AS value, bound, \"limit\" FROM u WHERE (bound = 'max' AND value > \"limit\") OR (bound = 'min' AND value < \"limit\")",
)
def code_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.violations(s.collision_metrics(_codes(spark, sf_dir)), _LIMITS).withColumn("value", F.round("value", 6))


@plan(
    "popular_tokens",
    f"WITH {QRELS_SQL}, {_CODES_SQL} SELECT path, count(*) AS n FROM qrels JOIN codes USING (skill_id) GROUP BY path ORDER BY n DESC, path LIMIT 10",
)
def popular_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = qrels(spark, sf_dir).join(_codes(spark, sf_dir), "skill_id")
    return joined.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(10)


@plan(
    "train_token_entropy",
    f"""WITH {QRELS_SQL}, {_CODES_SQL}, c AS (SELECT path, count(*)::DOUBLE AS n FROM qrels JOIN codes USING (skill_id) GROUP BY path), t AS (SELECT sum(n) AS t FROM c)
    SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy, round(-sum(n / t * ln(n / t)) / ln(160), 6) AS normalized FROM c, t""",
)
def train_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = qrels(spark, sf_dir).join(_codes(spark, sf_dir), "skill_id").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return s.entropy(counts, "n", F.lit(160), 0.0).select(F.round("entropy", 6).alias("entropy"), F.round("normalized", 6).alias("normalized"))


@plan(
    "unseen_evaluation_targets",
    f"""WITH {QRELS_SQL} SELECT skill_id, count(*) AS n FROM qrels WHERE query_id % 10 = 0 AND skill_id NOT IN (SELECT skill_id FROM qrels WHERE query_id % 10 <> 0) GROUP BY skill_id""",
)
def unseen_evaluation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = qrels(spark, sf_dir)
    held, train = rel.filter("query_id % 10 = 0"), rel.filter("query_id % 10 <> 0")
    return held.join(train.select("skill_id"), "skill_id", "left_anti").groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "mean_review_scores",
    """SELECT key, round(avg(value), 6) AS mean, count(value) AS n FROM (SELECT 'quality' AS key, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels WHERE quality = 1) GROUP BY key""",
)
def mean_review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scores = F.when(F.col("quality") == 1, F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).otherwise(F.create_map(F.lit("quality"), "quality"))
    return s.mean_scores(labels.select(scores.alias("scores")), "scores").withColumn("mean", F.round("mean", 6))


@plan("positive_counts", "SELECT skill_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey // 2 AS source_id, l_partkey AS skill_id FROM lineitem) GROUP BY skill_id")
def positive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("source_id"), F.col("l_partkey").alias("skill_id")).distinct()
    return pairs.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "mode_counts",
    """SELECT o_orderpriority AS mode, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, round(avg(o_totalprice), 3) AS mean_price, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1""",
)
def mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.avg("o_totalprice"), 3).alias("mean_price"), F.countDistinct("o_custkey").alias("owners")
    )


@plan(
    "split_summary",
    f"""WITH {QRELS_SQL}, v AS (SELECT * FROM qrels WHERE query_id % 10 = 0), t AS (SELECT * FROM qrels WHERE query_id % 10 <> 0)
    SELECT count(DISTINCT query_id) AS examples, count(DISTINCT query_id // 20) AS groups, (SELECT max(n) FROM (SELECT count(*) AS n FROM v GROUP BY query_id))::INTEGER AS max_targets,
    count(DISTINCT skill_id) AS distinct_targets, (SELECT count(DISTINCT skill_id) FROM v WHERE skill_id NOT IN (SELECT skill_id FROM t)) AS unseen_targets FROM v""",
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qrels(spark, sf_dir).groupBy("query_id").agg(F.collect_list("skill_id").alias("targets")).withColumn("group_id", F.floor(F.col("query_id") / 20))
    return s.split_summary(rows.filter("query_id % 10 = 0"), rows.filter("query_id % 10 <> 0"))


@plan("supervision_gaps", f"WITH {QRELS_SQL} SELECT p_partkey AS skill_id FROM part WHERE p_partkey NOT IN (SELECT skill_id FROM qrels WHERE query_id % 7 = 0)")
def supervision_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qrels(spark, sf_dir).filter("query_id % 7 = 0").groupBy("query_id").agg(F.collect_list("skill_id").alias("targets"))
    return s.supervision(rows, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id")))[1]


@plan(
    "token_index",
    """WITH ns AS (SELECT '<SK_L1_' || i::VARCHAR || '>' AS token, i FROM (SELECT unnest(range(0, 60)) AS i))
    SELECT token, coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey), '') AS skills, count(p_partkey)::INTEGER AS n FROM ns LEFT JOIN part ON p_size = i GROUP BY token""",
)
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.format_string("<SK_L1_%d>", c)
    codes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), F.array(name(F.col("p_size"))).alias("tokens"))
    space = spark.range(60).select(name(F.col("id")).alias("token"))
    return s.inverted_index(codes, space).select("token", F.array_join(F.col("skills").cast("array<string>"), ",").alias("skills"), F.size("skills").alias("n"))


@plan(
    "length_summary",
    """WITH w AS (SELECT len(string_split_regex(trim(text), '[ \t\n\r]+')) AS n FROM documents WHERE trim(text) <> '')
    SELECT quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n)::INTEGER AS max, round(avg(CASE WHEN n > 512 THEN 1.0::DOUBLE ELSE 0 END), 6) AS truncation_rate FROM w""",
)
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").filter("trim(text) <> ''").select(F.size(F.split(F.trim("text"), "[ \t\n\r]+")).alias("n"))
    return s.length_summary(words, "n", 512).withColumns({"p95": F.round("p95", 6), "truncation_rate": F.round("truncation_rate", 6)})


@plan(
    "best_epoch",
    """WITH e AS (SELECT extract(day FROM ts)::INTEGER AS epoch, round(avg(value), 4) AS loss, round(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END), 2) AS collision_rate FROM events GROUP BY 1)
    SELECT collision_rate, loss, epoch FROM e ORDER BY collision_rate, loss, epoch LIMIT 1""",
)
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg("value"), 4).alias("loss"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 2).alias("collision_rate")
    )
    return s.best_epoch(log)


@plan(
    "categorized_accuracy",
    """WITH t AS (SELECT event_type, value, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM events),
    c AS (SELECT 'all' AS category, * FROM t UNION ALL SELECT event_type, * FROM t UNION ALL SELECT 'code', * FROM t WHERE event_type IN ('click', 'view'))
    SELECT category, count(*) AS tokens, round(avg(ok), 6) AS accuracy, round(avg(value), 4) AS nll FROM c GROUP BY category""",
)
def categorized_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_compact(F.array(F.lit("all"), F.col("event_type"), F.when(F.col("event_type").isin("click", "view"), "code")))
    tokens = table(spark, sf_dir, "events").select(kinds.alias("categories"), (F.col("value") > 50).alias("correct"), F.col("value").alias("nll"))
    return s.categorized_accuracy(tokens).withColumns({"accuracy": F.round("accuracy", 6), "nll": F.round("nll", 4)})


_RULES = [
    ("critical", "code_collisions", "collision_rate > 0.05"),
    ("high", "large_bucket", "max_bucket > 100"),
    ("high", "few_paths", "paths < 100"),
    ("medium", "mean_bucket", "mean_bucket > 5"),
]


@plan("findings", f"WITH {_CODES_SQL}, {_COLLISION} " + " UNION ALL ".join(f"SELECT '{a}' AS severity, '{b}' AS code FROM m WHERE {c}" for a, b, c in _RULES))
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.findings(s.collision_metrics(_codes(spark, sf_dir)), _RULES)


@plan(
    "prefix_recall",
    f"""WITH {QRELS_SQL}, {_CODES_SQL}, g AS (SELECT query_id, c1, c2 FROM qrels JOIN codes USING (skill_id)),
    p AS (SELECT o_orderkey AS query_id, 0 AS rank, (o_custkey % 16)::INTEGER AS c1, (o_custkey % 6)::INTEGER AS c2 FROM orders UNION ALL SELECT o_orderkey, 1, (o_orderkey % 16)::INTEGER, (o_orderkey % 6)::INTEGER FROM orders),
    gl AS (SELECT DISTINCT query_id, 1 AS level, c1::VARCHAR AS x FROM g UNION SELECT DISTINCT query_id, 2, c1::VARCHAR || '/' || c2::VARCHAR FROM g),
    pl AS (SELECT query_id, level, x, min(rank) AS rank FROM (SELECT query_id, 1 AS level, c1::VARCHAR AS x, rank FROM p UNION ALL SELECT query_id, 2, c1::VARCHAR || '/' || c2::VARCHAR, rank FROM p) GROUP BY ALL),
    q AS (SELECT query_id, level, avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS r, max(CASE WHEN rank = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t FROM gl LEFT JOIN pl USING (query_id, level, x) GROUP BY ALL)
    SELECT level::INTEGER AS level, round(avg(r), 6) AS recall, round(avg(t), 6) AS top1 FROM q GROUP BY level""",
)
def prefix_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = qrels(spark, sf_dir).join(_codes(spark, sf_dir), "skill_id").select("query_id", "indices")
    orders = table(spark, sf_dir, "orders")
    of = lambda c, r: orders.select(F.col("o_orderkey").alias("query_id"), F.lit(r).alias("rank"), F.array((F.col(c) % 16).cast("int"), (F.col(c) % 6).cast("int")).alias("indices"))
    found = s.prefix_recall(of("o_custkey", 0).union(of("o_orderkey", 1)), gold, 2)
    return found.select("level", F.round("recall", 6).alias("recall"), F.round("top1", 6).alias("top1"))
