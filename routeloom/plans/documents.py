"""Plans over documents: near-duplicate queries and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import text as t
from routeloom.functions.hashing import stable_hash
from routeloom.operators import documents as d
from routeloom.operators import similarity
from routeloom.operators import splits
from routeloom.plans.registry import plan, table


@plan("near_duplicate_names")
def near_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy near-duplicate removal over distinct catalog descriptions, at the threshold that query sets use."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")).withColumn("grams", t.char_grams(F.col("text")))
    first = splits.exact_unique(rows, F.col("text"), [F.col("id")])
    pairs = similarity.banded_pairs(first, 0.86)
    return splits.near_duplicates(pairs, first, "id", [-F.length("text"), F.col("id")])


@plan(
    "training_rows",
    """SELECT p_partkey AS skill_id, 'memorization' AS phase, p_name AS input_text, p_brand AS target_text FROM part
    UNION ALL SELECT p_partkey, 'retrieval', 'order ' || l_orderkey::VARCHAR, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("text"), F.col("p_brand").alias("path"))
    queries = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("skill_id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("query"))
    return d.memorization_and_retrieval(skills, queries)


@plan(
    "role_order",
    """WITH p AS (SELECT p_partkey, p_brand, CASE right(p_brand, 1) WHEN '1' THEN 3 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 99 END AS o FROM part)
    SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY o, p_partkey) AS ordered FROM p GROUP BY p_brand""",
)
def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = {"1": 3, "2": 1, "3": 2}
    ranks = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.coalesce(F.try_element_at(ranks, F.substring("p_brand", -1, 1)), F.lit(99)).alias("o"))
    lists = rows.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("o", "p_partkey"))).alias("l"))
    return lists.select("p_brand", F.array_join(F.col("l.p_partkey").cast("array<string>"), ",").alias("ordered"))


@plan(
    "pool_shortlist",
    """SELECT p_partkey, position::INTEGER AS position FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size, (p_partkey * 1103515245 + 7 + 3 * 97) & 65535, p_partkey) AS position FROM part) WHERE position <= 256""",
)
def pool_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    jitter = (F.col("p_partkey") * F.lit(1103515245) + F.lit(7 + 3 * 97)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    cut = table(spark, sf_dir, "part").select("p_partkey", "p_size", jitter.alias("j")).orderBy("p_size", "j", "p_partkey").limit(256)
    return d.batch_export(cut, "pool", [F.col("p_size"), F.col("j"), F.col("p_partkey")]).select("p_partkey", "position")


@plan("split_hash_parity", "SELECT doc_id, CASE WHEN ('0x' || substr(sha256('3' || chr(31) || doc_id::VARCHAR), 1, 16))::UBIGINT % 2 = 0 THEN 'validation' ELSE 'test' END AS split FROM documents")
def split_hash_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(stable_hash(F.lit(3), F.col("doc_id")) % 2 == 0, "validation").otherwise("test").alias("split"))
