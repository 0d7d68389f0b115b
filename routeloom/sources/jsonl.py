"""Line-oriented sources and sinks: JSON lines, token lists, query lists, counts and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` with line numbers from 1 in each file.

    A file is read as one record, so that its numbers need no global order; files of a dataset are read in parallel.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("i", "line"))
    return lines.select("path", (F.col("i") + 1).alias("line_no"), "line")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines dataset and its rejects ``path, line_no, line, reason``.

    Blank lines are skipped; a line that isn't an object, or that doesn't parse, is rejected with its place.
    """
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    ddl = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    parsed = lines.withColumn("row", F.from_json("line", f"{ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    is_object = F.trim("line").startswith("{")
    good = is_object & F.col("row._bad").isNull()
    rejects = lines_rejected(parsed.filter(~good), is_object)
    names = [f.name for f in parsed.schema["row"].dataType.fields if f.name != "_bad"]
    return parsed.filter(good).select("path", "line_no", *(F.col(f"row.{n}").alias(n) for n in names)), rejects


def lines_rejected(bad: DataFrame, is_object) -> DataFrame:
    return bad.select("path", "line_no", "line", F.when(is_object, "invalid JSON").otherwise("not an object").alias("reason"))


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write rows as JSON lines by Spark's committer, which shows a dataset only when it is whole; returns their number."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def count_lines(spark: SparkSession, path: str) -> int:
    """Number of lines that aren't blank; splits of a large file are counted in parallel."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def query_lines(spark: SparkSession, path: str, longest: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """``query_id, query`` of the lines that aren't blank, and rejects ``path, line_no, n_chars`` of longer lines.

    Ids are ``line-%06d`` of the line in the file. A query is never cut: a caller that wants all or nothing, as the
    upload form does, refuses the file when there are rejects.
    """
    lines = numbered_lines(spark, path).withColumn("query", F.trim("line")).filter(F.col("query") != "")
    whole = lines.filter(F.length("query") <= longest).select(F.format_string("line-%06d", "line_no").alias("query_id"), "query")
    return whole, lines.filter(F.length("query") > longest).select("path", "line_no", F.length("query").alias("n_chars"))


def token_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``ord, token`` of a list with one token on each line, and violations: blank, with white space, or repeated."""
    lines = numbered_lines(spark, path).select((F.col("line_no") - 1).alias("ord"), F.col("line").alias("token"))
    repeats = lines.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("n > 1")
    bad = lines.filter((F.col("token") == "") | F.col("token").rlike(r"\s"))
    why = lambda d, r: d.select("ord", "token", F.lit(r).alias("reason"))
    return lines, why(bad, "blank or white space").union(why(repeats, "repeated"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``name, reason`` of manifest entries ``(name, sha256)`` without a file or with another digest."""
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    joined = manifest.join(own, "name", "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.lower("sha256") != F.col("found"), "different")
    return joined.withColumn("reason", reason).filter("reason is not null").select("name", "reason")
