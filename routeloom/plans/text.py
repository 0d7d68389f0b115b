"""Plans of scalar functions and projections over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import hashing as h
from routeloom.functions import text as t
from routeloom.functions import vectors as v
from routeloom.plans.registry import plan, table

_NORM = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


@plan("normalized_groups", f"SELECT doc_id, 'query-text:' || sha256({_NORM}) AS group_id FROM documents")
def normalized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", h.query_group(t.normalized(F.col("text"))).alias("group_id"))


@plan("stable_buckets", "SELECT o_orderkey, (('0x' || substr(sha256('7' || chr(31) || o_orderkey::VARCHAR), 1, 16))::UBIGINT % 20)::BIGINT AS bucket, substr(sha256(o_orderkey::VARCHAR), 1, 16) AS short_id FROM orders")
def stable_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (h.stable_hash(F.lit(7), F.col("o_orderkey")) % 20).cast("long").alias("bucket"), h.short_digest(F.col("o_orderkey").cast("string"), 16).alias("short_id")
    )


@plan("hash_sample", "SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(sha256('11' || chr(31) || o_orderkey::VARCHAR), 1, 16))::UBIGINT, o_orderkey LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(h.stable_hash(F.lit(11), F.col("o_orderkey")), "o_orderkey").limit(100)


@plan("skill_texts", "SELECT p_partkey, substr(trim(p_name) || ' | ' || trim(p_brand) || ' | ' || trim(p_type), 1, 30) AS skill_text FROM part")
def skill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.skill_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), 30).alias("skill_text"))


@plan("catalog_rows", "SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), CASE WHEN p_size > 10 THEN p_brand END, nullif(trim(p_type), '')) AS skill_text, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS label FROM part")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_size") > 10, F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.filled_text(F.col("p_name"), brand, F.col("p_type")).alias("skill_text"), t.first_filled(F.when(F.col("p_size") > 25, F.col("p_brand")), F.col("p_type")).alias("label")
    )


@plan(
    "gram_counts",
    r"""WITH c AS (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[^a-z0-9\x{3400}-\x{9fff}]+', '', 'g') AS s FROM documents)
    SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(1, length(s) - 2) + 1), lambda i: substr(s, i, 3))))::INTEGER AS grams FROM c""",
)
def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t.char_grams(F.col("text"))).alias("grams"))


@plan("word_features", r"SELECT doc_id, len(list_distinct(regexp_extract_all(" + _NORM + r", '[a-z0-9]+')))::INTEGER AS features FROM documents")
def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(t.word_features(F.col("text")))).alias("features"))


@plan(
    "script_ratio",
    r"""SELECT conv_id, turn, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]'))::INTEGER AS cjk, regexp_matches(text, '@[\w.-]+/[\w.-]+') AS leaks FROM conversations""",
)
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.cjk_count(F.col("text")).alias("cjk"), t.leaks_identifier(F.col("text")).alias("leaks"))


@plan("page_texts")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.page_text(F.col("html")).alias("text"))


@plan("exact_normal_forms")
def exact_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.normalized_exact(F.col("text")), 256).alias("digest"))


@plan("redacted_texts")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = t.redacted(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(shown, 256).alias("digest"), (shown != F.col("text")).alias("changed"))


@plan("token_namespace", "SELECT level::INTEGER AS level, code::INTEGER AS code, '<SK_L' || level::VARCHAR || '_' || code::VARCHAR || '>' AS token FROM (SELECT unnest(range(1, 4)) AS level), (SELECT unnest(range(0, 16)) AS code)")
def token_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = spark.range(48).select((F.floor(F.col("id") / 16) + 1).cast("int").alias("l"), (F.col("id") % 16).cast("int").alias("c"))
    token = space.select(t.token_name(F.col("l"), F.col("c")).alias("token"))
    return token.select(t.token_level(F.col("token")).alias("level"), t.token_index(F.col("token")).alias("code"), "token")


@plan("run_durations", "WITH r AS (SELECT user_id, floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT AS s FROM events GROUP BY user_id) SELECT user_id, CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR || 'd ' ELSE '' END || CASE WHEN s >= 3600 THEN (s % 86400 // 3600)::VARCHAR || 'h ' ELSE '' END || CASE WHEN s >= 60 THEN (s % 3600 // 60)::VARCHAR || 'm ' ELSE '' END || (s % 60)::VARCHAR || 's' AS duration FROM r")
def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return ends.select("user_id", t.duration_text(micros("b") - micros("a")).alias("duration"))


@plan("canonical_urls", "SELECT p_partkey, 'https://skills.example/' || url_encode(p_brand) || '/' || url_encode(p_name) AS url FROM part")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.canonical_url("https://skills.example", F.col("p_brand"), F.col("p_name")).alias("url"))


@plan(
    "json_numbers",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""",
)
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", t.finite_number(F.get_json_object("props", "$.k")).alias("k"))


@plan(
    "rendered_prompts",
    """SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id""",
)
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.operators.documents import rendered_prompts as render

    return render(table(spark, sf_dir, "conversations"))


@plan(
    "encoded_targets",
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS p, ['a' || (doc_id % 7)::VARCHAR, 'b', '<eos>'] AS t FROM documents)
    SELECT doc_id, len(list_concat(p[1:29], t))::INTEGER AS n_tokens, least(len(p), 29)::INTEGER AS masked, list_concat(p[1:29], t)[-3] AS first_target FROM w""",
)
def encoded_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.operators.documents import encoded_examples

    target = F.array(F.concat(F.lit("a"), (F.col("doc_id") % 7).cast("string")), F.lit("b"), F.lit("<eos>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("prompt"), target.alias("target"))
    found = encoded_examples(rows, 32)
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.filter("labels", lambda x: x == "-100")).alias("masked"), F.element_at("tokens", -3).alias("first_target"))


@plan("unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(v.norm(v.doubles(F.col("embedding"))), 5).alias("length"))


@plan(
    "fused_features",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e[1:32] AS a, e[33:64] AS b FROM e),
    u AS (SELECT vec_id, a, b, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb FROM n)
    SELECT vec_id, round(a[1] / na * sqrt(0.7::DOUBLE), 5) AS first_value, round(b[1] / nb * sqrt(0.3::DOUBLE), 5) AS other_value, len(a) + len(b) AS size FROM u""",
)
def fused_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.doubles(F.col("embedding"))
    fused = table(spark, sf_dir, "embeddings").select("vec_id", v.fused(F.slice(e, 1, 32), F.slice(e, 33, 32), 0.3).alias("f"))
    return fused.select("vec_id", F.round(F.element_at("f", 1), 5).alias("first_value"), F.round(F.element_at("f", 33), 5).alias("other_value"), F.size("f").cast("long").alias("size"))
