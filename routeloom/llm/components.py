"""Connected components of a graph of links: forests of parts of the links, then a distributed loop of star operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.workers import tidy
from routeloom.storage import materialize

#: Links that one task joins; its table of nodes takes some 100 MB at most.
PART = 250_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars_of_parts(edges: DataFrame) -> DataFrame:
    """``u, v``: every node of a partition of the edges, and the least node that the edges of that partition link it to."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x, y = find(u), find(v)
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        for at in range(0, len(nodes), 50_000):
            some = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], schema=out)

    return edges.mapInArrow(tidy(run), "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b", part: int = PART) -> DataFrame:
    """``node, component``: every node with a link, and the least node that it reaches.

    Each task first joins the links of a part of up to about ``part`` of them, without a shuffle; if one part holds
    all, that is the result. Else large and small stars alternate over what the parts have left until the edges stay
    the same, which takes a number of rounds that grows with the logarithm of the graph. Each round is written to the
    shared folder, so the lineage stays short and a lost executor costs one round. Self-links and repeated links are
    allowed; null ends are ignored. ``links`` are counted and then read: they had better be a written table.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    parts = -(-edges.count() // part)
    edges = materialize(_stars_of_parts(edges.coalesce(max(1, parts))), "stars")
    if parts <= 1:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = materialize(_small_star(edges.filter("u <> v")), "stars")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = mark(edges)
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.union(roots)
