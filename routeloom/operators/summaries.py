"""Aggregates over judgements, codes and reviews: distributions, quantiles, entropy, collisions, gates and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = {"min": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "max": 1.0}


def positive_lists(qrels: DataFrame) -> DataFrame:
    """``query_id, skills``: distinct positive skills in the order in which the judgements name them first."""
    firsts = qrels.filter("relevance > 0").groupBy("query_id", "skill_id").agg(F.min("ord").alias("ord"))
    lists = firsts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "skill_id"))).alias("s"))
    return lists.select("query_id", F.col("s.skill_id").alias("skills"))


def buckets(codes: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """``path, skills``: sorted members of each code, of active skills only if a list is given."""
    rows = codes if active is None else codes.join(active.select("skill_id"), "skill_id", "left_semi")
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))


def quantiles(rows: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Exact quantiles with linear interpolation, rounded to six digits; a column for each."""
    q = rows.groupBy(*by).agg(F.percentile(value, list(QUANTILES.values())).alias("q"))
    return q.select(*by, *(F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(QUANTILES)))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, n: str, size: Column, one: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``entropy`` in nats and ``normalized`` by ln(size); ``one`` is the normalized value where size is 1 or less.

    ln of the total minus the mean of ln n is the same sum, and needs one pass.
    """
    c = F.col(n).cast("double")
    total = counts.filter(F.col(n) > 0).groupBy(*by).agg(F.sum(c).alias("t"), F.sum(c * F.log(c)).alias("l"), F.first(size).alias("size"))
    h = F.greatest(F.lit(0.0), F.log("t") - F.col("l") / F.col("t"))
    return total.select(*by, h.alias("entropy"), F.when(F.col("size") > 1, h / F.log("size")).otherwise(one).alias("normalized"))


def code_level_metrics(codes: DataFrame, sizes: list[int]) -> DataFrame:
    """Per level: used codes, utilization, entropy, variation and extremes of usage, counting unused codes as 0.

    ``codes(skill_id, indices)``. The namespace is bounded by the sizes of the codebooks.
    """
    spark = codes.sparkSession
    space = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "level int, size int")
    space = space.select("level", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("code"))
    used = codes.select(F.posexplode("indices").alias("at", "code")).groupBy((F.col("at") + 1).alias("level"), "code").agg(F.count(F.lit(1)).alias("n"))
    full = space.join(used, ["level", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n").cast("double")
    per = full.groupBy("level", "size").agg(
        F.count_if(F.col("n") > 0).alias("used_codes"), F.sum(n).alias("t"), F.sum(F.when(n > 0, n * F.log(n)).otherwise(0.0)).alias("l"),
        F.stddev_pop(n).alias("sd"), F.avg(n).alias("mean"), F.min("n").alias("min_usage"), F.max("n").alias("max_usage"),
    )
    h = F.when(F.col("t") > 0, F.greatest(F.lit(0.0), F.log("t") - F.col("l") / F.col("t"))).otherwise(0.0)
    return per.select(
        "level", "size", "used_codes", (F.col("used_codes") / F.col("size")).alias("utilization"), h.alias("entropy"),
        F.when(F.col("size") > 1, h / F.log("size")).otherwise(1.0).alias("normalized_entropy"),
        F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0).alias("variation"), "min_usage", "max_usage",
    )


def collision_metrics(codes: DataFrame) -> DataFrame:
    """One row: skills, distinct paths, collision rate, largest and mean bucket, and the share of skills in shared buckets."""
    per = codes.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    one = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("skills"), F.count(F.lit(1)).alias("paths"), F.max("n").alias("max_bucket"),
        F.avg("n").alias("mean_bucket"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding"),
    )
    rate = lambda x: F.when(F.col("skills") > 0, x / F.col("skills")).otherwise(0.0)
    return one.select(
        "skills", "paths", rate(F.col("skills") - F.col("paths")).alias("collision_rate"), "max_bucket", "mean_bucket", rate(F.col("colliding")).alias("colliding_rate")
    )


def violations(metrics: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """``metric, value, bound, limit``: the metrics of one row that are above their ``max`` or below their ``min``."""
    cases = [
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), F.lit(bound).alias("bound"), F.lit(float(limit)).alias("limit"))
        for name, bound, limit in limits
    ]
    broken = F.when(F.col("c.bound") == "max", F.col("c.value") > F.col("c.limit")).otherwise(F.col("c.value") < F.col("c.limit"))
    return metrics.select(F.explode(F.array(*cases)).alias("c")).filter(broken).select("c.*")


def mean_scores(reviews: DataFrame, scores: str) -> DataFrame:
    """Mean of each key of a map over the rows that hold it."""
    return reviews.select(F.explode(scores).alias("key", "value")).groupBy("key").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def supervision(rows: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that name each skill, counted once for each row, and the skills without any. ``rows(targets)``."""
    counts = rows.select(F.explode(F.array_distinct("targets")).alias("skill_id")).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    return counts, skills.select("skill_id").join(counts, "skill_id", "left_anti")


def inverted_index(codes: DataFrame, tokens: DataFrame) -> DataFrame:
    """``token, skills`` for every token of the namespace; unused tokens have an empty list. ``codes(skill_id, tokens)``."""
    used = codes.select("skill_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.array_sort(F.collect_list("skill_id")).alias("skills"))
    none = F.array().cast(used.schema["skills"].dataType)
    return tokens.select("token").join(used, "token", "left").withColumn("skills", F.coalesce("skills", none))


def split_summary(rows: DataFrame, train: DataFrame) -> DataFrame:
    """One row on a split ``(group_id, targets)``: rows, groups, distinct targets, those that train lacks, most targets."""
    targets = rows.select(F.explode("targets").alias("t"))
    unseen = targets.distinct().join(train.select(F.explode("targets").alias("t")), "t", "left_anti").agg(F.count(F.lit(1)).alias("unseen_targets"))
    own = rows.agg(F.count(F.lit(1)).alias("examples"), F.countDistinct("group_id").alias("groups"), F.max(F.size("targets")).alias("max_targets"))
    return own.crossJoin(targets.agg(F.countDistinct("t").alias("distinct_targets"))).crossJoin(unseen)  # one row each


def length_summary(rows: DataFrame, tokens: str, limit: int) -> DataFrame:
    """Median, 95th percentile and largest token count, and the share above the limit."""
    return rows.agg(
        F.percentile(tokens, 0.5).alias("median"), F.percentile(tokens, 0.95).alias("p95"), F.max(tokens).alias("max"), F.avg((F.col(tokens) > limit).cast("double")).alias("truncation_rate")
    )


def best_epoch(log: DataFrame) -> DataFrame:
    """The row of the least (collision_rate, loss, epoch)."""
    return log.agg(F.min(F.struct("collision_rate", "loss", "epoch")).alias("b")).select("b.*")


def categorized_accuracy(tokens: DataFrame) -> DataFrame:
    """``category, tokens, accuracy, nll`` of teacher-forced tokens ``(categories, correct, nll)``; a token may count in several."""
    return tokens.select(F.explode("categories").alias("category"), "correct", "nll").groupBy("category").agg(
        F.count(F.lit(1)).alias("tokens"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("nll").alias("nll")
    )


def findings(report: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``severity, code`` of the rules (severity, code, condition) that hold on a report of one row."""
    cases = F.array(*(F.when(F.expr(cond), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, cond in rules))
    return report.select(F.explode(F.array_compact(cases)).alias("f")).select("f.*")


def prefix_recall(predicted: DataFrame, gold: DataFrame, levels: int) -> DataFrame:
    """``level, recall, top1``: gold prefixes of each length that any prediction has, and queries whose first one is right.

    ``predicted(query_id, rank, indices)``, ``gold(query_id, indices)``.
    """
    depth = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
    cut = lambda d: d.withColumn("prefix", F.expr("slice(indices, 1, level)"))
    g = cut(gold.select("query_id", "indices", depth)).select("query_id", "level", "prefix").distinct()
    p = cut(predicted.select("query_id", "rank", "indices", depth)).groupBy("query_id", "level", "prefix").agg(F.min("rank").alias("rank"))
    hit = g.join(p, ["query_id", "level", "prefix"], "left")
    per = hit.groupBy("query_id", "level").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("r"), F.max(F.coalesce(F.col("rank") == 0, F.lit(False)).cast("double")).alias("t"))
    return per.groupBy("level").agg(F.avg("r").alias("recall"), F.avg("t").alias("top1"))
