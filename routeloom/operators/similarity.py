"""Similarity of query texts: one-value minwise bands over character grams, confirmed by exact Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators.joins import jaccard


def banded_pairs(rows: DataFrame, threshold: float, bands: int = 4) -> DataFrame:
    """``a, b, score``: pairs that share the minwise value of a band and reach the threshold. ``rows(id, grams)``.

    Rows are expected to be distinct as texts, so a band groups only texts that differ; identical texts are dropped
    before by ``exact_unique``.
    """
    minima = F.array(*(F.array_min(F.transform("grams", lambda g, k=k: F.xxhash64(F.lit(k), g))) for k in range(bands)))
    keyed = rows.select("id", F.posexplode(minima).alias("band", "value"))
    other = keyed.withColumnRenamed("id", "b")
    pairs = keyed.withColumnRenamed("id", "a").join(other, ["band", "value"]).filter("a < b").select("a", "b").distinct()
    wide = pairs.join(rows.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(rows.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return wide.withColumn("score", jaccard(F.col("ga"), F.col("gb"))).filter(F.col("score") >= threshold).select("a", "b", "score")
