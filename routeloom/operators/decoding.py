"""Constrained decoding over code paths: prefix tables, the multi-path grammar and beams over a score table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_table(paths: DataFrame) -> DataFrame:
    """``prefix, allowed``: the tokens that may follow each prefix of the paths ``tokens``; a full path has no row."""
    wide = paths.select("tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("d"))
    return wide.groupBy(F.expr("slice(tokens, 1, d)").alias("prefix")).agg(F.array_sort(F.collect_set(F.expr("tokens[d]"))).alias("allowed"))


def parsed_sequences(rows: DataFrame, known: DataFrame, id_col: str, most: int, separator: str = "<sep>") -> DataFrame:
    """``id_col, n_paths, valid``: texts of paths between separators. Valid: known paths, none twice, at most ``most``."""
    paths = F.transform(F.split("text", separator), lambda p: F.trim(p))
    split = rows.select(id_col, paths.alias("paths"))
    each = split.select(id_col, F.explode("paths").alias("path")).join(known.select("path", F.lit(True).alias("ok")), "path", "left")
    good = each.groupBy(id_col).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_known"))
    n = F.size("paths")
    valid = F.col("all_known") & (n <= most) & (F.size(F.array_distinct("paths")) == n)
    return split.join(good, id_col).select(id_col, n.alias("n_paths"), valid.alias("valid"))


def synthetic_scores(paths: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, prefix, token, logp`` for every allowed step: a stand-in for a model, by hash."""
    steps = prefix_table(paths).select("prefix", F.explode("allowed").alias("token"))
    u = (F.pmod(F.xxhash64("query_id", "prefix", "token"), F.lit(1 << 20)) + 1) / float((1 << 20) + 1)
    return queries.crossJoin(F.broadcast(steps)).select("query_id", "prefix", "token", F.log(u).alias("logp"))  # a stated query set


def beam_decode(scores: DataFrame, levels: int, beam: int) -> DataFrame:
    """``query_id, rank, path, score``: the best paths by total log-probability, pruned to the beam at each level.

    ``scores(query_id, prefix, token, logp)`` holds allowed steps only, so every beam stays within the paths.
    """
    beams = scores.select("query_id").distinct().select("query_id", F.array().cast("array<string>").alias("path"), F.lit(0.0).alias("score"))
    for _ in range(levels):
        wide = beams.join(scores.withColumnRenamed("prefix", "path"), ["query_id", "path"])
        wide = wide.select("query_id", F.array_append("path", F.col("token")).alias("path"), (F.col("score") + F.col("logp")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
        beams = wide.withColumn("rank", rank).filter(F.col("rank") <= beam)
    return beams.select("query_id", "rank", F.array_join("path", "/").alias("path"), "score")
