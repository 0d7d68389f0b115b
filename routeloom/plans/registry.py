"""Where plans register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan, with its SQL twin if SQL can express it."""

    def add(f: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"two plans are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, skill_id, ord``: distinct pairs of order and part, in the order of their first line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("skill_id"), "l_linenumber")
    return lines.groupBy("query_id", "skill_id").agg(F.min("l_linenumber").alias("ord"))


#: The same in SQL, to stand before a query.
QRELS_SQL = "qrels AS (SELECT l_orderkey AS query_id, l_partkey AS skill_id, min(l_linenumber) AS ord FROM lineitem GROUP BY ALL)"
