"""Plans of validation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import validation as v
from routeloom.plans.registry import QRELS_SQL, plan, qrels, table


@plan(
    "dataset_violations",
    """WITH s AS (SELECT p_partkey FROM part WHERE p_size <= 48), l AS (SELECT l_orderkey AS q, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL),
    w AS (SELECT q, list_sort(list(DISTINCT p)) AS want FROM l WHERE q % 50 <> 3 GROUP BY q), h AS (SELECT q, list_sort(list(DISTINCT p)) AS have FROM l GROUP BY q)
    SELECT 'duplicate judgement' AS rule, q::VARCHAR || '/' || p::VARCHAR AS key, n::VARCHAR AS detail FROM l WHERE n > 1
    UNION ALL SELECT 'unknown target', p::VARCHAR, '' FROM (SELECT DISTINCT p FROM l WHERE q % 50 <> 3) WHERE p NOT IN (SELECT p_partkey FROM s)
    UNION ALL SELECT 'unknown judged skill', p::VARCHAR, '' FROM (SELECT DISTINCT p FROM l) WHERE p NOT IN (SELECT p_partkey FROM s)
    UNION ALL SELECT 'judgements differ from targets', coalesce(w.q, h.q)::VARCHAR, '' FROM w FULL JOIN h ON w.q = h.q WHERE want IS DISTINCT FROM have
    UNION ALL SELECT 'query in two splits', q::VARCHAR, '' FROM w WHERE q % 200 = 7""",
)
def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("skill_id"))
    skills = table(spark, sf_dir, "part").filter("p_size <= 48").select(F.col("p_partkey").alias("skill_id"))
    queries = lines.filter("query_id % 50 <> 3").groupBy("query_id").agg(F.lit("text").alias("query"), F.collect_list("skill_id").alias("skill_ids"))
    return v.dataset_violations(skills, queries, lines, queries.filter("query_id % 200 = 7").select("query_id"))


@plan(
    "code_violations",
    """WITH c AS (SELECT p_partkey AS k, CASE WHEN p_size = 7 THEN [p_brand, p_brand] WHEN p_size = 9 THEN [p_brand] ELSE [p_brand, p_size::VARCHAR] END AS t FROM part)
    SELECT 'uneven length' AS rule, k::VARCHAR AS key, len(t)::VARCHAR AS detail FROM c WHERE len(t) <> (SELECT min(len(t)) FROM c)
    UNION ALL SELECT 'repeated token', k::VARCHAR, '' FROM c WHERE len(list_distinct(t)) <> len(t)""",
)
def code_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tokens = F.when(size == 7, F.array("p_brand", "p_brand")).when(size == 9, F.array("p_brand")).otherwise(F.array(F.col("p_brand"), size.cast("string")))
    return v.code_violations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), tokens.alias("tokens")))


@plan(
    "registry_violations",
    """WITH r AS (SELECT p_partkey AS k, p_brand AS b FROM part WHERE p_size <> 3), c AS (SELECT p_partkey AS k, CASE WHEN p_size = 4 THEN 'moved' ELSE p_brand END AS p FROM part WHERE p_size <> 5)
    SELECT 'registry differs from codes' AS rule, coalesce(r.k, c.k)::VARCHAR AS key, coalesce(b, '-') || ' <> ' || coalesce(p, '-') AS detail FROM r FULL JOIN c ON r.k = c.k WHERE b IS DISTINCT FROM p""",
)
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    registry = part.filter("p_size <> 3").groupBy(F.col("p_brand").alias("path")).agg(F.collect_list("p_partkey").alias("skills"))
    codes = part.filter("p_size <> 5").select(F.col("p_partkey").alias("skill_id"), F.when(F.col("p_size") == 4, "moved").otherwise(F.col("p_brand")).alias("path"))
    return v.registry_violations(registry, codes)


@plan(
    "closed_set_violations",
    f"""WITH {QRELS_SQL}, q AS (SELECT query_id, query_id // 3 AS w, CASE WHEN query_id % 30 < 27 THEN 'train' ELSE 'test' END AS s, list_sort(list(skill_id)) AS t FROM qrels GROUP BY query_id),
    p AS (SELECT w, count(DISTINCT s) AS a, count(DISTINCT t) AS b FROM q GROUP BY w)
    SELECT 'number of targets' AS rule, query_id::VARCHAR AS key, len(t)::VARCHAR AS detail FROM q WHERE len(t) NOT BETWEEN 2 AND 4
    UNION ALL SELECT 'evidence not in query', query_id::VARCHAR, 'span <' || t[1]::VARCHAR || '>' FROM q WHERE query_id % 9 = 0
    UNION ALL SELECT 'workflow in two splits', w::VARCHAR, '' FROM p WHERE a > 1
    UNION ALL SELECT 'targets differ in workflow', w::VARCHAR, '' FROM p WHERE b > 1""",
)
def closed_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = qrels(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("skill_id")).alias("skill_ids"))
    spans = F.transform("skill_ids", lambda s: F.concat(F.lit("span <"), s.cast("string"), F.lit(">")))
    shown = F.array_join(F.when(F.col("query_id") % 9 == 0, F.slice(spans, F.lit(2), F.greatest(F.lit(1), F.size(spans)))).otherwise(spans), " | ")
    rows = lists.select(
        "query_id",
        F.floor(F.col("query_id") / 3).alias("workflow_id"),
        F.when(F.col("query_id") % 30 < 27, "train").otherwise("test").alias("split"),
        F.concat(F.lit("use "), shown, F.lit(" |")).alias("query"),
        "skill_ids",
        F.map_from_arrays("skill_ids", F.transform(spans, lambda s: s)).alias("evidence"),
    )
    return v.closed_set_violations(rows)


@plan(
    "intent_violations",
    f"""WITH {QRELS_SQL}, q AS (SELECT query_id AS q, list_sort(list(skill_id)) AS t, query_id % 11 AS m FROM qrels GROUP BY query_id),
    i AS (SELECT q, t, m, CASE WHEN m = 1 THEN [t[1]] WHEN m = 2 THEN t WHEN m = 3 THEN [-1] WHEN m = 4 THEN [t[1]] ELSE [] END AS imp, CASE WHEN m IN (1, 2, 3, 5) THEN 'implicit' WHEN m = 6 THEN 'other' ELSE 'explicit' END AS mode FROM q)
    SELECT 'intent mode' AS rule, q::VARCHAR AS key, '' AS detail FROM i WHERE m = 6
    UNION ALL SELECT 'implicit skill is no target', q::VARCHAR, '' FROM i WHERE m = 3
    UNION ALL SELECT 'intents of other than the targets', q::VARCHAR, '' FROM i WHERE m = 7 AND len(t) > 1
    UNION ALL SELECT 'intents disagree with implicit skills', q::VARCHAR, '' FROM i WHERE m IN (1, 2, 4)
    UNION ALL SELECT 'rationales of other than the implicit skills', q::VARCHAR, '' FROM i WHERE m IN (3, 8)
    UNION ALL SELECT 'explicit query with implicit skills', q::VARCHAR, '' FROM i WHERE m = 4
    UNION ALL SELECT 'implicit query without both kinds', q::VARCHAR, '' FROM i WHERE mode = 'implicit' AND NOT len(imp) BETWEEN 1 AND len(t) - 1""",
)
def intent_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh query breaks another rule: see the twin; all stated intents are explicit."""
    rows = qrels(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("skill_id")).alias("skill_ids"))
    m, none, first = F.col("query_id") % 11, F.array().cast("array<bigint>"), F.slice("skill_ids", 1, 1)
    implicit = F.when(m.isin(1, 4), first).when(m == 2, F.col("skill_ids")).when(m == 3, F.array(F.lit(-1).cast("long"))).otherwise(none)
    stated = F.when(m == 7, first).otherwise(F.col("skill_ids"))
    reasoned = F.when(m == 3, none).when(m == 8, first).otherwise(implicit)
    of = lambda keys, value: F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit(value)))
    rows = rows.select(
        "query_id",
        "skill_ids",
        F.when(m.isin(1, 2, 3, 5), "implicit").when(m == 6, "other").when(m == 0, F.lit(None)).otherwise("explicit").alias("intent_mode"),
        implicit.alias("implicit_ids"),
        F.when(m != 9, of(stated, "explicit")).alias("target_intents"),
        of(reasoned, "because").alias("rationales"),
    )
    return v.intent_violations(rows)


@plan(
    "alignment_violations",
    """WITH q AS (SELECT o_orderkey AS q, CASE WHEN o_orderkey % 13 = 1 THEN 2 ELSE 1 END AS n, o_custkey AS s FROM orders), j AS (SELECT q, CASE WHEN q % 13 = 2 THEN s + 1 ELSE s END AS s, CASE WHEN q % 13 = 3 THEN 0 ELSE 1 END AS r FROM q WHERE q % 13 <> 4)
    SELECT 'number of targets' AS rule, q::VARCHAR AS key, '2' AS detail FROM q WHERE n = 2
    UNION ALL SELECT 'unknown target', s::VARCHAR, '' FROM (SELECT DISTINCT s FROM q WHERE n = 1) WHERE s NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'judgement isn''t positive', q::VARCHAR, '' FROM j WHERE r = 0
    UNION ALL SELECT 'judgement of no target', q::VARCHAR, '' FROM j WHERE r = 1 AND q % 13 IN (1, 2)
    UNION ALL SELECT 'target without judgement', q::VARCHAR, '' FROM q WHERE q % 13 IN (2, 3, 4)""",
)
def alignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = F.col("o_orderkey") % 13, F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    queries = orders.select(F.col("o_orderkey").alias("query_id"), F.when(m == 1, F.array(s, s + 1)).otherwise(F.array(s)).alias("skill_ids"))
    judged = orders.filter(m != 4).select(F.col("o_orderkey").alias("query_id"), F.when(m == 2, s + 1).otherwise(s).alias("skill_id"), F.when(m == 3, 0).otherwise(1).alias("relevance"))
    return v.alignment_violations(queries, judged, table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("skill_id")))


@plan(
    "manifest_counts",
    """WITH f AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT o_orderpriority AS k, count(*) FILTER (o_orderstatus <> 'P') AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT 'count differs from manifest' AS rule, f.k AS key, f.n::VARCHAR || ' <> ' || coalesce(m.n::VARCHAR, '-') AS detail FROM f LEFT JOIN m ON m.k = f.k WHERE m.n IS DISTINCT FROM f.n""",
)
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "name")
    said = orders.filter("name <> '5-LOW'").groupBy("name").agg(F.count(F.when(F.col("o_orderstatus") != "P", 1)).alias("n"))
    return v.count_violations(orders.groupBy("name").agg(F.count(F.lit(1)).alias("n")), said)


@plan(
    "underfed_skills",
    f"""WITH {QRELS_SQL}, s AS (SELECT DISTINCT query_id - query_id % 3 AS q, skill_id FROM qrels), a AS (SELECT s_suppkey AS skill_id FROM supplier),
    n AS (SELECT p_partkey AS k, count(x.skill_id) AS n FROM part LEFT JOIN (SELECT skill_id FROM s UNION ALL SELECT skill_id FROM a) x ON x.skill_id = p_partkey GROUP BY 1)
    SELECT 'too few positives' AS rule, k::VARCHAR AS key, n::VARCHAR AS detail FROM n WHERE n < 30""",
)
def underfed_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("query_id") % 3 > 0, F.col("query_id") - F.col("query_id") % 3).alias("source_query_id")
    train = qrels(spark, sf_dir).groupBy("query_id").agg(F.collect_list("skill_id").alias("skill_ids")).select("query_id", source, "skill_ids")
    alignment = table(spark, sf_dir, "supplier").select(F.array("s_suppkey").alias("skill_ids"))
    return v.underfed_skills(train, alignment, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id")), 30)


@plan(
    "text_violations",
    """SELECT 'length' AS rule, doc_id::VARCHAR AS key, length(text)::VARCHAR AS detail FROM documents WHERE length(text) < 40 OR length(text) > 8000
    UNION ALL SELECT 'banned phrase', doc_id::VARCHAR, '' FROM documents WHERE contains(text, 'tion the') OR contains(text, ' les ')
    UNION ALL SELECT 'identifier leak', doc_id::VARCHAR, '' FROM documents WHERE regexp_matches(text, '@[\\p{L}\\p{N}_.-]+/[\\p{L}\\p{N}_.-]+')""",
)
def text_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return v.text_violations(docs, "doc_id", "text", 40, 8000, 0, 0.0, ["tion the", " les "])


# Every score and every flag of a review takes its own bits of an order's key, so that each of them decides some row.
_SCORES = ("style", "complexity", "necessity", "coherence", "specificity", "relevance")
_FLAGS = ("missing", "redundant", "unsafe", "issues", "extra", "unsatisfied")


@plan(
    "review_passes",
    f"""WITH k AS (SELECT o_orderkey, (o_orderkey::BIGINT * 2654435761) % 4294967296 AS h FROM orders),
    r AS (SELECT o_orderkey, {", ".join(f"5 - (h // {4 ** (i + 1)} % 4) // 2 * (1 + h // {4 ** (i + 1)} % 2) AS {n}" for i, n in enumerate(_SCORES))},
      {", ".join(f"(h // {3 * 5 ** (i + 1)} % 16 = 0) AS {n}" for i, n in enumerate(_FLAGS))} FROM k)
    SELECT o_orderkey, (style >= 3 AND complexity >= 4 AND necessity >= 4 AND coherence >= 4 AND specificity >= 3 AND NOT missing AND NOT redundant AND NOT unsafe AND NOT issues) AS multi_pass,
      (style >= 3 AND relevance >= 4 AND specificity >= 3 AND coherence >= 4 AND NOT missing AND NOT extra AND NOT unsafe AND NOT unsatisfied) AS single_pass FROM r""",
)
def review_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 5, 5, 4 or 3 less one where 3 suffices: see the twin; flags are set in a sixteenth of the rows."""
    h = (F.col("o_orderkey").cast("long") * 2654435761) % 4294967296
    part = lambda n, m: F.floor(h / n) % m
    score = lambda i: (5 - F.floor(part(4 ** (i + 1), 4) / 2) * (1 + part(4 ** (i + 1), 2))).cast("int")
    scores = F.create_map(*(x for i, n in enumerate(_SCORES) for x in (F.lit(n), score(i))))
    flag = {n: part(3 * 5 ** (i + 1), 16) == 0 for i, n in enumerate(_FLAGS)}
    some = lambda n: F.when(flag[n], F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    multi = v.multi_target_pass(scores, some("missing"), some("redundant"), flag["unsafe"], some("issues"))
    single = v.single_target_pass(scores, ~flag["unsatisfied"], flag["missing"], flag["extra"], flag["unsafe"])
    return table(spark, sf_dir, "orders").select("o_orderkey", multi.alias("multi_pass"), single.alias("single_pass"))


@plan(
    "decode_map_violations",
    f"""WITH {QRELS_SQL}, c AS (SELECT p_partkey AS k, p_brand || '/' || p_type AS path FROM part WHERE p_size <> 2)
    SELECT 'skill without code' AS rule, p_partkey::VARCHAR AS key, '' AS detail FROM part WHERE p_size = 2
    UNION ALL SELECT 'path without code', p, '' FROM (SELECT DISTINCT p_brand || '/none' AS p FROM part)
    UNION ALL SELECT 'skill without supervision', p_partkey::VARCHAR, '' FROM part WHERE p_partkey NOT IN (SELECT skill_id FROM qrels WHERE query_id % 7 = 0)""",
)
def decode_map_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    codes = part.filter("p_size <> 2").select(F.col("p_partkey").alias("skill_id"), F.concat_ws("/", "p_brand", "p_type").alias("path"))
    paths = codes.select("path").union(part.select(F.concat(F.col("p_brand"), F.lit("/none")))).distinct()
    return v.decode_map_violations(part.select(F.col("p_partkey").alias("skill_id")), codes, paths, qrels(spark, sf_dir).filter("query_id % 7 = 0").select("skill_id"))
