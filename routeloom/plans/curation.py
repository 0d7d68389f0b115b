"""Plans of catalog and query curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import curation as c
from routeloom.plans.registry import QRELS_SQL, plan, qrels, table


@plan(
    "normalized_skills",
    """SELECT p_partkey::VARCHAR AS skill_id, CASE WHEN p_size > 5 THEN p_name ELSE '' END AS name, substr((CASE WHEN p_size > 5 THEN p_name ELSE '' END) || ' | ' || p_type || ' | ', 1, 18) AS text, p_brand AS domain
    FROM part WHERE p_size <> 9""",
)
def normalized_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") != 9, F.concat(F.lit(" "), F.col("p_partkey").cast("string")))
    rows = part.select(key.alias("id"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("domain"))
    return c.normalized_skills(rows, 18)[0].select("skill_id", "name", "text", F.col("hierarchy.domain").alias("domain"))


@plan(
    "normalized_queries",
    f"""WITH {QRELS_SQL} SELECT query_id::VARCHAR AS query_id, count(*)::INTEGER AS k, CASE WHEN query_id % 3 > 0 THEN (query_id - query_id % 3)::VARCHAR END AS source_query_id,
    (query_id % 3)::INTEGER AS target_order_variant FROM qrels GROUP BY query_id""",
)
def normalized_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = F.col("query_id") % 3
    rows = qrels(spark, sf_dir).groupBy("query_id").agg(F.collect_list("skill_id").alias("skill_ids"))
    rows = rows.select(
        F.when(variant == 0, F.col("query_id").cast("string")).otherwise("").alias("id"),
        "query_id",
        F.lit("text").alias("query"),
        "skill_ids",
        F.when(variant > 0, (F.col("query_id") - variant).cast("string")).otherwise("").alias("source_query_id"),
        variant.alias("target_order_variant"),
    )
    return c.normalized_queries(rows).select("query_id", "k", "source_query_id", "target_order_variant")


@plan(
    "incremental_query_violations",
    r"""WITH q AS (SELECT 'conv_' || (conv_id % 5)::VARCHAR AS skill_id, trim(regexp_replace(CASE WHEN turn = 0 THEN 'ask conv_' || (conv_id % 5)::VARCHAR || ' ' ELSE '' END || coalesce(text, ''), '\s+', ' ', 'g')) AS p FROM conversations)
    SELECT 'length' AS rule, skill_id AS key, length(p)::VARCHAR AS detail FROM q WHERE length(p) NOT BETWEEN 2 AND 180
    UNION ALL SELECT 'identifier leak', skill_id, '' FROM q WHERE contains(lower(p), skill_id)
    UNION ALL SELECT 'duplicate query', skill_id || '/' || lower(p), count(*)::VARCHAR FROM q GROUP BY skill_id, lower(p) HAVING count(*) > 1""",
)
def incremental_query_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    skill = F.concat(F.lit("conv_"), (F.col("conv_id") % 5).cast("string"))
    asked = F.when(F.col("turn") == 0, F.concat(F.lit("ask "), skill, F.lit(" "))).otherwise("")
    return c.incremental_query_violations(table(spark, sf_dir, "conversations").select(skill.alias("skill_id"), F.concat(asked, F.coalesce("text", F.lit(""))).alias("query")))


@plan("enriched_results", "SELECT l_orderkey, l_linenumber, p_partkey AS skill_id, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 40")
def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("skill_id"))
    catalog = table(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("skill_id"), "p_name", "p_brand")
    return c.enriched(results, catalog)[0]


@plan(
    "last_attempts",
    """SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS position FROM
    (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12)""",
)
def last_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return c.last_attempts(events, "user_id", ["ts", "event_id"]).drop("ts")


@plan("latest_versions", "SELECT o_custkey AS profile_id, o_orderkey AS version, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.latest_versions(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("version"), "o_orderstatus"))


@plan("newest_runs", "SELECT 'run-' || lpad(o_orderkey::VARCHAR, 9, '0') AS run_id FROM orders WHERE o_orderstatus <> 'F' ORDER BY run_id DESC LIMIT 200")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "old-").otherwise("run-")
    return c.newest_runs(table(spark, sf_dir, "orders").select(F.concat(kind, F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("run_id")), limit=1000)


@plan(
    "natural_token_order",
    """SELECT p_brand, (row_number() OVER (ORDER BY regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER))::INTEGER AS position FROM (SELECT DISTINCT p_brand FROM part)""",
)
def natural_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    brands = table(spark, sf_dir, "part").select("p_brand").distinct()  # the catalog's brands
    return brands.select("p_brand", F.row_number().over(Window.orderBy(c.natural_order(F.col("p_brand")))).alias("position"))


@plan(
    "alignment_needs",
    f"""WITH {QRELS_SQL}, p AS (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'composite' WHEN 1 THEN 'meta' END AS m, p_size % 2 AS a FROM part),
    w AS (SELECT k, 'any' AS r, 20 AS n FROM p UNION ALL SELECT k, 'native_followup', 1 FROM p UNION ALL SELECT k, 'identity_explicit', 1 FROM p WHERE a > 0
      UNION ALL SELECT k, 'composite_bundle', 2 FROM p WHERE m = 'composite' UNION ALL SELECT k, 'meta_task_context', 2 FROM p WHERE m = 'meta'),
    h AS (SELECT skill_id, CASE query_id % 40 WHEN 1 THEN 'native_followup' WHEN 2 THEN 'identity_explicit' WHEN 3 THEN 'composite_bundle' WHEN 4 THEN 'meta_task_context' ELSE 'core' END AS r FROM qrels),
    c AS (SELECT skill_id, r, count(*) AS have FROM h GROUP BY ALL UNION ALL SELECT skill_id, 'any', count(*) FROM h GROUP BY skill_id)
    SELECT k AS skill_id, w.r AS requirement, (n - coalesce(have, 0))::INTEGER AS need FROM w LEFT JOIN c ON skill_id = k AND c.r = w.r WHERE n > coalesce(have, 0)""",
)
def alignment_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    mode = F.when(size % 3 == 0, "composite").when(size % 3 == 1, "meta")
    profiles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), mode.alias("routing_mode"), (size % 2).alias("n_aliases"))
    names = ("native_followup", "identity_explicit", "composite_bundle", "meta_task_context")
    kinds = F.lit(None).cast("string")
    for i, name in enumerate(names, 1):
        kinds = F.when(F.col("query_id") % 40 == i, name).otherwise(kinds)
    passed = qrels(spark, sf_dir).select("skill_id", F.array_compact(F.array(kinds)).alias("requirements"))
    return c.alignment_needs(profiles, passed, 20)


@plan(
    "patched_targets",
    f"""WITH {QRELS_SQL}, bad AS (SELECT DISTINCT query_id FROM qrels JOIN part ON p_partkey = skill_id WHERE p_size = 7), cur AS (SELECT s_suppkey * 2 AS query_id FROM supplier)
    SELECT query_id, count(*)::INTEGER AS n, 'kept' AS origin FROM qrels WHERE query_id NOT IN (SELECT query_id FROM bad) AND query_id NOT IN (SELECT query_id FROM cur) GROUP BY query_id
    UNION ALL SELECT query_id, 1, 'curated' FROM cur""",
)
def patched_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qrels(spark, sf_dir).groupBy("query_id").agg(F.collect_list("skill_id").alias("skill_ids")).withColumn("origin", F.lit("kept"))
    replaced = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("skill_id"))
    curated = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("query_id"), F.array("s_suppkey").alias("skill_ids"), F.lit("curated").alias("origin"))
    return c.patched_targets(rows, replaced, curated).select("query_id", F.size("skill_ids").alias("n"), "origin")


@plan(
    "coverage_shortfall",
    f"WITH {QRELS_SQL}, n AS (SELECT p_partkey AS skill_id, count(query_id)::INTEGER AS have FROM part LEFT JOIN qrels ON skill_id = p_partkey GROUP BY 1) SELECT * FROM n WHERE have < 30",
)
def coverage_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qrels(spark, sf_dir).groupBy("query_id").agg(F.collect_list("skill_id").alias("skill_ids"))
    return c.coverage_shortfall(rows, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id")), 30)


@plan(
    "lineage_violations",
    """SELECT c_custkey AS name, CASE WHEN n_nationkey IS NULL THEN 'no manifest' ELSE 'unknown lineage' END AS reason FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30
    WHERE n_nationkey IS NULL OR c_nationkey NOT IN (n_nationkey, n_regionkey, n_regionkey + 5)""",
)
def lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 30).alias("name"), F.col("c_nationkey").cast("long").alias("trained_on"), "c_custkey")
    region = F.col("n_regionkey").cast("long")
    manifests = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("name"), F.col("n_nationkey").cast("long").alias("current"), F.array(region, region + 5).alias("ancestors"))
    keyed = artifacts.select(F.col("c_custkey").alias("name"), "trained_on")
    own = artifacts.select(F.col("c_custkey").alias("artifact"), "name").join(manifests, "name").select(F.col("artifact").alias("name"), "current", "ancestors")
    return c.lineage_violations(keyed, own)
