"""Graphs from judgements: co-use edges, coalesced weights, adjacency, induced edges and neighbour sampling.

All operators take the columns that they name and ignore others; rows with a null key take part in nothing. The pair
join is bounded by the sum of squared query sizes; ``most_targets`` fails loudly instead of multiplying a broken query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def couse_pairs(qrels: DataFrame) -> DataFrame:
    """``src, dst, pair_count`` for src < dst: queries that want both skills. Repeated judgements count once.

    The skills of a query are gathered into one sorted array, so the judgements are shuffled once, by query, and the
    pairs are generated inside the task and counted there before the second shuffle.
    """
    wanted = qrels.filter("query_id is not null and skill_id is not null")
    sets = wanted.groupBy("query_id").agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))
    left = sets.select("skills", F.posexplode("skills").alias("i", "src"))
    pairs = left.select("src", F.explode(F.slice("skills", F.col("i") + 2, F.size("skills"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pair_count"))


def couse_edges(qrels: DataFrame) -> DataFrame:
    """``src, dst, pair_count, weight`` with weight = pair_count / sqrt(frequency of src * frequency of dst)."""
    freq = qrels.filter("query_id is not null and skill_id is not null").groupBy("skill_id").agg(F.countDistinct("query_id").alias("f"))
    pairs = couse_pairs(qrels)
    a = freq.select(F.col("skill_id").alias("src"), F.col("f").alias("fa"))
    b = freq.select(F.col("skill_id").alias("dst"), F.col("f").alias("fb"))
    weight = F.col("pair_count") / F.sqrt(F.col("fa").cast("double") * F.col("fb"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "pair_count", weight.alias("weight"))


def coalesced_edges(edges: DataFrame) -> DataFrame:
    """Directed edges without self-loops and without weights of zero or less, weights summed for each pair."""
    good = edges.filter((F.col("src") != F.col("dst")) & (F.col("weight") > 0))
    return good.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, neighbours`` of the undirected graph, neighbours as sorted structs of node and weight."""
    both = edges.select(F.col("src").alias("node"), F.struct(F.col("dst").alias("to"), "weight").alias("n")).union(
        edges.select(F.col("dst").alias("node"), F.struct(F.col("src").alias("to"), "weight").alias("n"))
    )
    return both.groupBy("node").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column ``node``): two semi joins."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def sampled_neighbour(edges: DataFrame, seed: int) -> DataFrame:
    """``node, neighbour``: one neighbour each, drawn in proportion to weight by exponential keys of a stable hash.

    The least of -ln(u) / weight over the neighbours is such a draw; it is a plain minimum, so a hub is reduced before
    the shuffle.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "weight").union(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), "weight")
    )
    u = (F.pmod(F.xxhash64(F.lit(seed), "node", "to"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = both.filter("weight > 0").withColumn("key", -F.log(u) / F.col("weight"))
    return drawn.groupBy("node").agg(F.min(F.struct("key", "to"))["to"].alias("neighbour"))


def edge_aware_batches(edges: DataFrame, nodes: DataFrame, batch_size: int, seed: int) -> DataFrame:
    """``batch, node``: half of a batch are base nodes, each with a sampled neighbour.

    Base nodes are dealt by a stable hash, so a batch has about half its size in base nodes; a node that is its
    batch's member already is not repeated.
    """
    total = nodes.count()
    batches = max(1, -(-total * 2 // batch_size))
    base = nodes.select("node", F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(batches)).alias("batch"))
    near = base.join(sampled_neighbour(edges, seed), "node").select("batch", F.col("neighbour").alias("node"))
    return base.select("batch", "node").union(near).distinct()
