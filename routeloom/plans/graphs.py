"""Plans over co-use graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import graphs as g
from routeloom.plans.registry import QRELS_SQL, plan, qrels

_EDGES_SQL = f"""{QRELS_SQL},
freq AS (SELECT skill_id, count(DISTINCT query_id) AS f FROM qrels GROUP BY skill_id),
edges AS (SELECT a.skill_id AS src, b.skill_id AS dst, count(*) AS pair_count
          FROM qrels a JOIN qrels b ON a.query_id = b.query_id AND a.skill_id < b.skill_id GROUP BY ALL),
weighted AS (SELECT src, dst, pair_count, pair_count / sqrt(fa.f::DOUBLE * fb.f) AS weight
             FROM edges JOIN freq fa ON fa.skill_id = src JOIN freq fb ON fb.skill_id = dst)"""


@plan("couse_edges", f"WITH {_EDGES_SQL} SELECT src, dst, pair_count, round(weight, 6) AS weight FROM weighted")
def couse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.couse_edges(qrels(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@plan(
    "coalesced_edges",
    """SELECT l_partkey AS src, l_suppkey AS dst, round(sum(l_quantity * (1 - l_discount)), 3) AS weight FROM lineitem
       WHERE l_partkey <> l_suppkey AND l_quantity * (1 - l_discount) > 0 GROUP BY ALL""",
)
def coalesced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    weight = F.col("l_quantity") * (1 - F.col("l_discount"))
    edges = lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), weight.alias("weight"))
    return g.coalesced_edges(edges).withColumn("weight", F.round("weight", 3))


@plan(
    "weighted_adjacency",
    f"""WITH {_EDGES_SQL}, sides AS (SELECT src AS node, dst AS to_node, weight FROM weighted UNION ALL SELECT dst, src, weight FROM weighted)
        SELECT node, count(*) AS degree, string_agg(to_node::VARCHAR, ',' ORDER BY to_node) AS neighbours, round(sum(weight), 4) AS strength
        FROM sides GROUP BY node""",
)
def weighted_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = g.adjacency(g.couse_edges(qrels(spark, sf_dir)))
    return lists.select(
        "node",
        F.size("neighbours").cast("long").alias("degree"),
        F.array_join(F.col("neighbours.to").cast("array<string>"), ",").alias("neighbours"),
        F.round(F.aggregate("neighbours.weight", F.lit(0.0), lambda s, x: s + x), 4).alias("strength"),
    )


@plan(
    "induced_edges",
    f"WITH {_EDGES_SQL} SELECT src, dst, round(weight, 6) AS weight FROM weighted WHERE src % 3 = 0 AND dst % 3 = 0",
)
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g.couse_edges(qrels(spark, sf_dir))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"))
    return g.induced_edges(edges, nodes).withColumn("weight", F.round("weight", 6))


@plan("edge_aware_batches")
def edge_aware_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g.couse_edges(qrels(spark, sf_dir))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"))
    return g.edge_aware_batches(edges, nodes, 64, 7)
