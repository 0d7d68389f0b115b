"""Line deduplication by site-relative frequency, in DataFrame functions only.

The pages of a host that contain a line are counted and divided by the host's page total; a line on more than
``ratio`` of the pages, and on at least ``min_pages``, is boilerplate of that host and dropped from its pages.

Lines are compared after trimming spaces, by two 64-bit hashes of host and line, which is a partial aggregate before
the shuffle, so a line on a third of all pages arrives as one row per map task. A host has at most
(lines per page) / ``ratio`` boilerplate lines, whatever its size, so the list of a host is bounded. Lists are sorted,
and a line is looked up in its host's by binary search. The join with the lists is broadcast only when the written list is below the session's broadcast threshold, and else a sort-merge join on the
host that adaptive execution may split.

Defined cases: a text of any length or number of lines is one page; a null text stays null with no lines; blank lines are never dropped; a line that repeats within a page
counts that page once and is dropped everywhere in it; a null host is a host of its own; repeated rows are pages each;
an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.expressions import let, ranked_in
from routeloom.storage import materialize


def _line_key(site: Column, line: Column) -> Column:
    return F.struct(F.xxhash64(site, F.isnull(site), line).alias("a"), F.xxhash64(line, F.lit(11), site, F.isnull(site)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 4) -> DataFrame:
    """``site, keys``: the boilerplate line keys of each host that has any."""
    site = F.col("site")
    pages = docs.select(F.col(site_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text"))
    trimmed = F.array_distinct(F.transform(_lines(F.col("text")), lambda s: F.trim(s)))
    per_page = pages.select("site", F.explode(F.filter(trimmed, lambda s: s != "")).alias("line"))
    counts = per_page.select("site", _line_key(site, F.col("line")).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    often = counts.filter(F.col("pages") >= min_pages)
    found = often.join(totals, often["site"].eqNullSafe(totals["site"])).filter(F.col("pages") > F.col("total") * ratio)
    return found.groupBy(often["site"].alias("site")).agg(F.sort_array(F.collect_list("key")).alias("keys"))


def line_dedup(
    docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 4
) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and ``n_lines`` and ``n_dropped`` appended.

    The appended columns take the place of input columns of the same names.
    """
    boiler = materialize(boilerplate_lines(docs, site_col, text_col, ratio, min_pages), "boilerplate")
    boiler = boiler.select(F.col("site").alias("__site"), F.col("keys").alias("__keys"))
    site, text = F.col(site_col).cast("string"), F.col(text_col).cast("string")
    joined = docs.join(boiler, site.eqNullSafe(F.col("__site")), "left")
    keys = F.col("__keys")

    def without(rank):
        listed = lambda key: F.coalesce(F.get(keys, rank(key) - 1) == key, F.lit(False))
        return F.filter(_lines(text), lambda s: (F.trim(s) == "") | ~let(_line_key(site, F.trim(s)), listed))

    kept = F.when(keys.isNull(), _lines(text)).otherwise(ranked_in(keys, without))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    n_kept = F.when(text.isNull(), 0).otherwise(F.size("__kept"))
    out = joined.withColumn("__kept", kept).withColumn("__n", n_lines)
    out = out.withColumn("__dropped", F.col("__n") - n_kept)
    new_text = F.when(F.col("__dropped") == 0, text).otherwise(F.array_join("__kept", "\n")).alias(text_col)
    own = [new_text if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, F.col("__n").alias("n_lines"), F.col("__dropped").alias("n_dropped"))
