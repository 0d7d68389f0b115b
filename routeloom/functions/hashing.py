"""Stable hashes as column expressions, equal to those that other tools compute from the same bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(*values: Column) -> Column:
    """Unsigned 64-bit hash, as decimal(20,0): the first 8 bytes, big-endian, of sha256 over values joined by 0x1F."""
    joined = F.concat_ws("\x1f", *(v.cast("string") for v in values))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def short_digest(value: Column, n: int) -> Column:
    """The first n hex digits of sha256."""
    return F.substring(F.sha2(value, 256), 1, n)


def query_group(normalized: Column) -> Column:
    """Group id of a normalized query text."""
    return F.concat(F.lit("query-text:"), F.sha2(normalized, 256))


def ordered_ids_digest(ids: Column) -> Column:
    """sha256 of ids in order, a line end after each. ``ids`` is an array of strings."""
    return F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256)
