"""Prompts, training examples, catalog search and code trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendered_prompts(turns: DataFrame) -> DataFrame:
    """``conv_id, prompt``: lines ``Role: text`` in the order of turns; a null text is empty."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lists.select("conv_id", F.array_join(F.col("l.line"), "\n").alias("prompt"))


def encoded_examples(rows: DataFrame, limit: int, ignored: str = "-100") -> DataFrame:
    """``tokens`` and ``labels``: the target whole, the prompt cut on the right to fit, its labels ignored.

    A target longer than the limit is an error.
    """
    room = F.lit(limit) - F.size("target")
    kept = F.slice("prompt", F.lit(1), F.when(room < 0, F.raise_error(F.lit("a target is longer than the limit")).cast("int")).otherwise(room))
    fields = [c for c in rows.columns if c not in ("prompt", "target")]
    wide = rows.withColumn("kept", kept)
    return wide.select(*fields, F.concat("kept", "target").alias("tokens"), F.concat(F.array_repeat(F.lit(ignored), F.size("kept")), "target").alias("labels"))


def catalog_search(catalog: DataFrame, fields: list[str], query: str, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose fields contain the query whatever its case, in order and cut at the limit; and their total."""
    text = F.lower(F.concat_ws("\n", *fields))
    found = catalog.filter(text.contains(query.strip().lower())) if query.strip() else catalog
    return found.orderBy(*order).limit(limit), found.agg(F.count(F.lit(1)).alias("total"))


def code_tree(codes: DataFrame, tokens: str) -> DataFrame:
    """``prefix, depth, skills``: how many skills stand under each prefix of their codes; depth 0 is the root."""
    depth = F.explode(F.sequence(F.lit(0), F.size(tokens))).alias("depth")
    wide = codes.select(F.col(tokens).alias("t"), depth)
    prefix = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.expr("slice(t, 1, depth)"), "/"))
    return wide.groupBy(prefix.alias("prefix"), "depth").agg(F.count(F.lit(1)).alias("skills"))


def patched(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with the non-blank patch values of allowed fields; the last patch of a key wins for each field.

    ``patches`` has the key, ``seq`` and the fields.
    """
    last = [F.max_by(F.when(F.trim(F.col(f).cast("string")) != "", F.col(f)), F.when(F.trim(F.col(f).cast("string")) != "", F.col("seq"))).alias(f"__{f}") for f in fields]
    news = patches.groupBy(key).agg(*last)
    joined = base.join(news, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def memorization_and_retrieval(skills: DataFrame, queries: DataFrame) -> DataFrame:
    """``skill_id, phase, input_text, target_text`` of new skills: one row from the catalog and one for each query."""
    memory = skills.select("skill_id", F.lit("memorization").alias("phase"), F.col("text").alias("input_text"), F.col("path").alias("target_text"))
    asked = queries.join(skills.select("skill_id", "path"), "skill_id").select("skill_id", F.lit("retrieval").alias("phase"), F.col("query").alias("input_text"), F.col("path").alias("target_text"))
    return memory.union(asked)


def candidate_list(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``skill_id, name, rank`` of a candidate list whose id defaults to the name."""
    ident = F.coalesce(F.nullif(F.trim("skill_id"), F.lit("")), F.col("name"))
    return rows.select(ident.alias("skill_id"), "name", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), done * 100.0 / total)))


def batch_export(rows: DataFrame, request: str, order: list[Column]) -> DataFrame:
    """Rows with ``request`` and their ``position`` from 1."""
    return rows.withColumn("request", F.lit(request)).withColumn("position", F.row_number().over(Window.orderBy(*order)))
