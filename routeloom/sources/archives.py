"""ZIP archives as a source: safe members, wrapper folders, catalog rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import text as t

MEMBERS = "path string, member string, size long, content binary, error string"


def safe_name(name: str) -> bool:
    """Relative, without parent steps, drive letters or backslashes."""
    p = PurePosixPath(name)
    return bool(name) and not p.is_absolute() and ".." not in p.parts and "\\" not in name and ":" not in name and "\0" not in name


def members_of(path: str, content: bytes, most_members: int, most_bytes: int) -> Iterator[tuple]:
    """Rows of one archive; an archive that breaks a limit gives a single row with the error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > most_members:
                raise ValueError("too many members")
            if sum(i.file_size for i in infos) > most_bytes:
                raise ValueError("expands too far")
            for i in infos:
                if not safe_name(i.filename):
                    raise ValueError(f"unsafe member {i.filename!r}")
                if i.external_attr >> 28 == 0xA:
                    raise ValueError(f"link {i.filename!r}")
            rows = [(path, i.filename, i.file_size, z.read(i), None) for i in infos]
    except (ValueError, zipfile.BadZipFile, RuntimeError) as e:
        rows = [(path, None, None, None, str(e))]
    yield from rows


def read_archives(spark: SparkSession, path: str, most_members: int = 10_000, most_bytes: int = 200 << 20) -> DataFrame:
    """``path, member, size, content, error`` of all members of all archives; one archive is held at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(list(members_of(p, content, most_members, most_bytes)), columns=["path", "member", "size", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MEMBERS)


def without_wrapper(members: DataFrame) -> DataFrame:
    """Members without the folder that all of an archive's members stand in, if there is one."""
    top = F.substring_index("member", "/", 1)
    per = members.groupBy("path").agg(F.count_distinct(top).alias("n"), F.min(top).alias("top"), F.bool_and(F.contains("member", F.lit("/"))).alias("nested"))
    joined = members.join(per, "path")
    inner = F.expr("substring(member, length(top) + 2)")
    return joined.withColumn("member", F.when((F.col("n") == 1) & F.col("nested"), inner).otherwise(F.col("member"))).drop("n", "top", "nested")


def subtree(members: DataFrame, root: str) -> DataFrame:
    """Members below a folder, named relative to it."""
    prefix = root.strip("/") + "/"
    return members.filter(F.col("member").startswith(prefix)).withColumn("member", F.expr(f"substring(member, {len(prefix) + 1})"))


def catalog_rows(members: DataFrame, limit: int = 4000) -> DataFrame:
    """``path, name, description, text`` of each archive from its shallowest ``SKILL.md``, else ``README.md``."""
    name = F.lower(t.base_name(F.col("member")))
    wanted = members.filter(name.isin("skill.md", "readme.md")).withColumn("order", F.struct((name != "skill.md").alias("a"), t.path_depth(F.col("member")).alias("b"), F.col("member").alias("c")))
    best = wanted.groupBy("path").agg(F.min_by("content", "order").alias("content"))
    raw = best.select("path", F.decode("content", "UTF-8").alias("raw")).withColumn("front", t.front_matter(F.col("raw")))
    body = F.regexp_replace("raw", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    return raw.select(
        "path",
        F.coalesce(F.try_element_at("front", F.lit("name")), F.regexp_extract("raw", r"(?m)^#\s+(.+)$", 1)).alias("name"),
        F.coalesce(F.try_element_at("front", F.lit("description")), F.lit("")).alias("description"),
        t.cleaned_markup(body, limit).alias("text"),
    )
