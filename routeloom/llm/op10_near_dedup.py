"""Near-duplicate detection by a chosen-path set similarity join.

A document is the set of its five-word shingles. Documents of the same set are one class, so exact copies cost one
row each and nothing more. Class representatives are branched recursively: a node of the forest holds the documents
that share the minwise tokens chosen along its path. The root of each of ``trees`` independent trees branches on one
minwise coordinate; nodes of up to ``leaf`` documents are compared exhaustively inside one task.

A similar pair shares most of its roots, so a document with ``enough`` roots of up to ``leaf`` documents meets its near
copies there, and leaves its larger roots. What remains in larger roots are documents most of whose roots are large:
those of big groups of near copies, or of pages that are mostly template. Such a node first compares all its members
with one pivot, the most central member; those that link to it, confirmed on full sets, are done with as members of the
pivot's component. The rest, if still more than ``leaf``, branches on into the children of ``per_step`` further coordinates, in expectation
``(1 / branching) ** per_step`` of them, drawn from the path itself; branching is the threshold unless given, so that
a pair at the threshold is expected in one child. So a group of a million near copies is joined by its pivot and not
multiplied by branching.

In a leaf documents are compared by 256 packed minwise values; a pair is a candidate unless its estimate is more than
``slack`` standard deviations below the threshold. A first pass takes only the maximum spanning forest of a leaf's
candidates, and confirms those pairs on the full sets. A second pass takes the documents of a leaf that still have a
candidate in another component, compares their full sets inside the leaf, and gives a spanning forest of the links.
Hence a group of g near copies gives about g pairs and not g * g, while no link that joins two components is passed
over.

Branching alone would lose pairs of a large root, so the second pass also takes every pair of such a root whose ends
are of two components by then, also what is left after ``max_steps``: documents outside of the root's largest component
meet all others in blocks of about ``leaf``. That costs the number of documents outside times the root's, and nothing
for a root that the pivots have joined into one component.

Recall: a pair of similarity s is missed by the roots with probability (1 - s) ** trees, and by the small roots of a
document that left its larger ones with at most (1 - s) ** enough: 1.3e-5 at 0.80 and 1.7e-6 at 0.85 for the defaults.
The candidate test misses a pair at the threshold with 2.3e-4, less above it. Both are chances of one pair; a group
stays in one piece if any path of links does.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing; a text of fewer than five
words has one shingle, the whole sequence; a text of any length is one set; repeated rows of one id are one document if
their texts agree, and else each is linked by its own text, so that they may end in different components; rows with a
null id are kept and linked with nothing; an empty table gives an empty result; only the named columns are read, and in
``near_dedup`` all columns pass through.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.components import components
from routeloom.llm.op03_byte_bpe import slices
from routeloom.llm.wordhash import minwise, mix, shingle_sets
from routeloom.llm.workers import tidy
from routeloom.storage import broadcast_if_small, discard, materialize, release

COORDINATES = 256


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_digests(docs: DataFrame, trees: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, sig, roots``: size and 128-bit digest of each set, the low 16 bits of its minwise
    values, and the first ``trees`` of them whole."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("roots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 1000, 1_000_000) for b in batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            values = [minwise(s) for s in sets]
            columns = [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([v.astype(np.uint16).tobytes() for v in values], pa.binary()),
                pa.array([v[:trees].tobytes() for v in values], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, sig binary, roots binary")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, shingles``: the distinct shingle hashes of each text, and the digest of the set."""
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 1000, 1_000_000) for b in batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            columns = [batch.column("doc_id"), pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, digest binary, shingles array<bigint>")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)


def _roots(reps: DataFrame, trees: int) -> DataFrame:
    """``node, doc_id``: the first node of each document in each tree."""
    out = pa.schema([("node", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(1, trees + 1, dtype=np.uint64)
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column("roots").to_pylist()), dtype=np.uint64).reshape(-1, trees)
                nodes = mix(mix(tree)[None, :] + values)  # one coordinate for each tree, all different
                ids = np.repeat(batch.column("doc_id").to_numpy(), trees)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(ids)], schema=out)

    return reps.select("doc_id", "roots").mapInArrow(tidy(run), "node long, doc_id long")


def _children(members: DataFrame, per_step: int, branching: float) -> DataFrame:
    """``node, doc_id``: the children that documents of large nodes go to."""
    out = pa.schema([("node", pa.int64()), ("doc_id", pa.int64())])
    expected = (1 / branching) ** per_step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column("sig")).astype(np.uint64)
            node = batch.column("node").to_numpy().view(np.uint64)
            ids = batch.column("doc_id").to_numpy()
            rows = np.arange(len(node))
            for child in range(int(np.ceil(expected))):
                path = mix(node + np.uint64(child * 7919 + 13))
                # the last child exists with the fractional part of the expectation, the same for all of a node
                there = path % np.uint64(1 << 20) < np.uint64(int(min(1.0, expected - child) * (1 << 20)))
                key = path
                for step in range(per_step):
                    which = mix(path + np.uint64(step + 1)) % np.uint64(COORDINATES)
                    key = mix(key + sig[rows, which] + (which << np.uint64(20)))
                yield pa.RecordBatch.from_arrays([pa.array(key[there].view(np.int64)), pa.array(ids[there])], schema=out)

    return members.select("node", "doc_id", "sig").mapInArrow(tidy(run), "node long, doc_id long")


def _modal_signatures(members: DataFrame, sample: int) -> DataFrame:
    """``node, modal``: the most frequent value of each coordinate among about ``sample`` members of each node."""
    out = pa.schema([("node", pa.int64()), ("modal", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _nodes(batches):
            sig = np.sort(_signatures(t.column("sig")), axis=0)
            modal, most, many = sig[0].copy(), np.ones(COORDINATES, int), np.ones(COORDINATES, int)
            for above, here in itertools.pairwise(sig):
                many = np.where(above == here, many + 1, 1)
                modal, most = np.where(many > most, here, modal), np.maximum(many, most)
            yield pa.RecordBatch.from_arrays([t.column("node").combine_chunks()[:1], pa.array([modal.tobytes()], pa.binary())], schema=out)

    drawn = members.filter(F.pmod(F.xxhash64("node", "doc_id"), F.col("size")) < sample).select("node", "sig")
    return _dealt(drawn).mapInArrow(tidy(run), "node long, modal binary")


def _pivots(members: DataFrame, reps: DataFrame, sample: int) -> DataFrame:
    """``node, pivot, pivot_n, pivot_sig``: the member of each node that agrees most with the node's modal signature."""
    out = pa.schema([("node", pa.int64()), ("agreeing", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            equal = (_signatures(batch.column("sig")) == _signatures(batch.column("modal"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(equal.astype(np.int64)), batch.column("doc_id")], schema=out)

    modal = broadcast_if_small(materialize(_modal_signatures(members, sample), "modal"), 20_000)
    agreeing = members.join(modal, "node").select("node", "doc_id", "sig", "modal").mapInArrow(tidy(run), "node long, agreeing long, doc_id long")
    best = agreeing.groupBy("node").agg(F.max(F.struct("agreeing", (-F.col("doc_id")).alias("least"))).alias("p"))
    best = best.select("node", (-F.col("p.least")).alias("pivot"))
    own = reps.select(F.col("doc_id").alias("pivot"), F.col("n_shingles").alias("pivot_n"), F.col("sig").alias("pivot_sig"))
    return best.join(own, "pivot").select("node", "pivot", "pivot_n", "pivot_sig")


def pivot_pairs(members: DataFrame, reps: DataFrame, threshold: float, slack: float, sample: int = 64) -> DataFrame:
    """Distinct ``a, b``: a the pivot of a node, b a member that may be similar to it; of ``node, size, doc_id, n_shingles, sig``.

    The pivot is the most central member: in a group of copies that were edited independently it is the one with the
    fewest edits, which more of the others link to than to any other.
    """
    bar = _bar(threshold, slack)
    pivots = materialize(_pivots(members, reps, sample), "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            size, pivot_size = batch.column("n_shingles").to_numpy(), batch.column("pivot_n").to_numpy()
            fits = np.minimum(size, pivot_size) >= threshold * np.maximum(size, pivot_size) - 1e-9
            equal = (_signatures(batch.column("sig")) == _signatures(batch.column("pivot_sig"))).sum(axis=1)
            other = batch.column("pivot").to_numpy() != batch.column("doc_id").to_numpy()
            rows = pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("doc_id")], schema=_PAIR)
            yield rows.filter(pa.array(fits & other & (equal >= bar)))

    both = members.join(broadcast_if_small(pivots, 20_000), "node").select("doc_id", "n_shingles", "sig", "pivot", "pivot_n", "pivot_sig")
    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def chosen_path_leaves(
    reps: DataFrame, texts: DataFrame, percent: int, trees: int, enough: int, leaf: int, per_step: int, branching: float, slack: float, max_steps: int
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``node, doc_id`` of all nodes that are to be compared exhaustively; of the roots that were branched; and the links to pivots."""
    nodes = materialize(_roots(reps, trees), "nodes")
    sizes = lambda rows: materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "node-sizes")
    counts = sizes(nodes)
    leaves = nodes.join(counts.filter(F.col("size") <= leaf).select("node"), "node")
    if not counts.filter(F.col("size") > leaf).limit(1).count():
        return leaves, None, None
    large = nodes.join(counts.filter(F.col("size") > leaf).select("node"), "node")
    # a document with enough small roots meets its near copies there
    bound = large.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > trees - enough).select("doc_id")
    nodes = materialize(large.join(bound, "doc_id").select("node", "doc_id"), "nodes")
    branched, links = None, None
    for step in range(max_steps + 1):
        counts = sizes(nodes)
        leaves = leaves.union(nodes.join(counts.filter(F.col("size") <= leaf).select("node"), "node"))
        if not counts.filter(F.col("size") > leaf).limit(1).count():
            break
        large = nodes.join(counts.filter(F.col("size") > leaf), "node")
        if branched is None:
            large = materialize(large, "branched-roots")
            branched = large.select("node", "doc_id")
        if step == max_steps:
            break  # what is left meets in the blocks of its root
        members = materialize(large.join(reps.drop("roots"), "doc_id"), "large-nodes")
        found = materialize(confirmed(materialize(pivot_pairs(members, reps, percent / 100, slack), "pivot-pairs"), texts, percent, hubs=True), "pivot-links")
        links = found if links is None else links.union(found)
        joined = found.select(F.col("b").alias("doc_id"))
        rest = materialize(members.join(broadcast_if_small(joined), "doc_id", "left_anti"), "rest")
        discard(members)
        counts = sizes(rest)
        leaves = leaves.union(rest.join(counts.filter(F.col("size") <= leaf).select("node"), "node").select("node", "doc_id"))
        open_nodes = rest.join(counts.filter(F.col("size") > leaf).select("node"), "node")
        nodes = materialize(_children(open_nodes, per_step, branching), "nodes")
    return leaves, branched, links


def across_components(branched: DataFrame, first: DataFrame, reps: DataFrame, leaf: int) -> DataFrame:
    """``node, doc_id, n_shingles, sig, component``: blocks in which all pairs of a branched root meet that are of two components.

    The component that most documents of a root belong to is dealt into blocks by a hash of the id, and so is the rest;
    every block of the rest meets every block, those of the main component do not meet each other.
    """
    rows = branched.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = materialize(rows.select("node", "doc_id", F.coalesce("component", "doc_id").alias("component")), "branched")
    sizes = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("node").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("total")).filter("total > main.n")
    half = max(1, leaf // 2)
    blocks = lambda n: F.ceil(n / half).cast("int")
    main = main.select(
        "node", F.col("main.component").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("total") - F.col("main.n")).alias("rests")
    )
    rows = rows.join(broadcast_if_small(materialize(main, "main-components")), "node").join(reps.drop("roots"), "doc_id")
    is_main = F.col("component") == F.col("main")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    own = F.col("own")
    met = lambda n, kind, pair: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda j: F.xxhash64("node", F.lit(kind), *pair(j)))
    with_rest = met("rests", 0, lambda j: (F.least(own, j), F.greatest(own, j)))
    nodes = F.when(is_main, met("rests", 1, lambda j: (j, own))).otherwise(F.concat(with_rest, met("mains", 1, lambda j: (own, j))))
    return rows.select(F.explode(nodes).alias("node"), "doc_id", "n_shingles", "sig", "component")


def _near(ids: np.ndarray, size: np.ndarray, sig: np.ndarray, comp: np.ndarray | None, threshold: float, bar: float):
    """Places and agreement of the candidate pairs of one leaf; with ``comp`` only of those that join two components."""
    found = []
    for i in range(len(ids) - 1):
        fits = np.minimum(size[i], size[i + 1 :]) >= threshold * np.maximum(size[i], size[i + 1 :]) - 1e-9
        if comp is not None:
            fits &= comp[i + 1 :] != comp[i]
        js = np.flatnonzero(fits) + i + 1
        if len(js):
            equal = (sig[js] == sig[i]).sum(axis=1)
            near = equal >= bar
            if near.any():
                found.append((np.full(int(near.sum()), i), js[near], equal[near]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> list[int]:
    """Which of the edges form a maximum spanning forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k in np.argsort(-weight, kind="stable").tolist():
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each node, from rows that arrive sorted by node; a node may span batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
        if rest and rest[-1].column("node")[0].as_py() != node[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for lo, hi in zip([0, *cuts], [*cuts, len(node)], strict=True):
            rest.append(batch.slice(lo, hi - lo))
            if hi < len(node):
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition("node").sortWithinPartitions("node")


def _bar(threshold: float, slack: float) -> float:
    """Equal minwise values that a candidate needs."""
    return COORDINATES * (threshold - slack * (threshold * (1 - threshold) / COORDINATES) ** 0.5)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], schema=_PAIR)


def forest_pairs(members: DataFrame, threshold: float, slack: float) -> DataFrame:
    """Distinct ``a, b`` with a < b of the spanning forests of all leaves ``node, doc_id, n_shingles, sig``."""
    bar = _bar(threshold, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for t in _nodes(batches):
            ids = t.column("doc_id").to_numpy()
            a, b, w = _near(ids, t.column("n_shingles").to_numpy(), _signatures(t.column("sig")), None, threshold, bar)
            for k in _forest(len(ids), a, b, w):
                x, y = int(ids[a[k]]), int(ids[b[k]])
                found.add((min(x, y), max(x, y)))
            if len(found) > 50_000:
                yield _pairs(found)
                found.clear()
        yield _pairs(found)

    return _dealt(members).mapInArrow(tidy(run), "a long, b long").distinct()


def undecided_members(members: DataFrame, threshold: float, slack: float) -> DataFrame:
    """``node, doc_id, component`` of the documents of a leaf that have a candidate in another component."""
    bar = _bar(threshold, slack)
    out = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("component", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _nodes(batches):
            ids, comp = t.column("doc_id").to_numpy(), t.column("component").to_numpy()
            if (comp == comp[0]).all():
                continue
            a, b, _ = _near(ids, t.column("n_shingles").to_numpy(), _signatures(t.column("sig")), comp, threshold, bar)
            at = np.unique(np.concatenate([a, b]))
            if len(at):
                yield pa.RecordBatch.from_arrays([t.column("node").combine_chunks().take(pa.array(at)), pa.array(ids[at]), pa.array(comp[at])], schema=out)

    return _dealt(members).mapInArrow(tidy(run), "node long, doc_id long, component long")


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """Distinct ``a, b``: of each leaf ``node, doc_id, component, shingles`` a forest of the links between components.

    All intersections of a leaf come from one product of its membership matrix, over the shingles that two or more of
    its documents have; sums of ones are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for t in _nodes(batches):
            ids, comp = t.column("doc_id").to_numpy(), t.column("component").to_numpy()
            lists = t.column("shingles").combine_chunks()
            flat = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(ids)), size)
            _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
            shared = many[column] > 1
            row, column = row[shared], column[shared]
            common = np.zeros((len(ids), len(ids)), dtype=np.float32)
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            width = 8192
            starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, np.int64)
            dense = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
            for lo in range(0, len(starts), width):
                part = (dense >= lo) & (dense < lo + width)
                x = np.zeros((len(ids), min(width, len(starts) - lo)), dtype=np.float32)
                x[row[part], dense[part] - lo] = 1
                common += x @ x.T
            inter = np.rint(common).astype(np.int64)
            union = size[:, None] + size[None, :] - inter
            a, b = np.nonzero(np.triu(100 * inter >= percent * union, 1) & (comp[:, None] != comp[None, :]))
            for k in _forest(len(ids), a, b, inter[a, b] / union[a, b]):
                x, y = int(ids[a[k]]), int(ids[b[k]])
                found.add((min(x, y), max(x, y)))
            if len(found) > 50_000:
                yield _pairs(found)
                found.clear()
        yield _pairs(found)

    return _dealt(members).mapInArrow(tidy(run), "a long, b long").distinct()


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Full sets of the nodes with the given ids, which may repeat; their texts are shuffled only if the ids are very many.

    ``texts`` has ``doc_id, text``, and where rows repeat an id also ``node, set_digest``: which node a row stands for
    if its set has that digest.
    """
    if ids.count() > 1_000_000:
        ids = materialize(ids.distinct(), "ids")
    ids = broadcast_if_small(ids)
    if "node" not in texts.columns:
        return full_sets(texts.join(ids, "doc_id", "left_semi")).select("doc_id", "shingles")
    wanted = texts.select("doc_id", "node", "set_digest").join(ids.select(F.col("doc_id").alias("node")), "node").distinct()
    sets = full_sets(texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
    named = sets.join(wanted, (sets["doc_id"] == wanted["doc_id"]) & (sets["digest"] == wanted["set_digest"]))
    return named.select(F.col("node").alias("doc_id"), "shingles").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, hubs: bool = False) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union of their full sets.

    With ``hubs`` few documents are the first of many pairs; their sets are a table of its own, whose size decides
    whether they are broadcast.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    sets = materialize(_sets_of(texts, ids), "sets")
    of_a = sets
    if hubs:
        of_a = materialize(sets.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi"), "hub-sets")
    left = pairs.join(of_a.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _classes(digests: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``digest, rep, node, n_shingles, sig, roots`` of each set that is not empty: its least id and its node number;
    and the texts that nodes are read from.

    A node has the number of its representative, unless rows repeat an id, of which some may have different sets: then
    of the sets with one representative that of the least digest has its number, and each other one a hash of digest
    and id.
    """
    least = F.min(F.struct("doc_id", "n_shingles", "sig", "roots")).alias("least")
    classes = digests.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(least)
    classes = classes.select("digest", F.col("least.doc_id").alias("rep"), "least.n_shingles", "least.sig", "least.roots")
    repeated = digests.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.limit(1).count():
        return materialize(classes.withColumn("node", F.col("rep")), "classes"), texts
    classes = materialize(classes, "classes")
    first = classes.groupBy("rep").agg(F.min("digest").alias("least"))
    node = F.when(F.col("digest") == F.col("least"), F.col("rep")).otherwise(F.xxhash64("digest", "rep"))
    classes = materialize(classes.join(first, "rep").withColumn("node", node).drop("least"), "classes")
    own = classes.select(F.col("rep").alias("doc_id"), "node", F.col("digest").alias("set_digest"))
    return classes, texts.join(own, "doc_id")


def similarity_classes(
    docs: DataFrame,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = 10,
    enough: int = 7,
    leaf: int = 1000,
    per_step: int = 4,
    branching: float | None = None,
    slack: float = 3.5,
    max_steps: int = 12,
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row for each row of ``docs``; the least id that its links reach."""
    texts = _texts(docs, id_col, text_col)
    digests = materialize(set_digests(texts, trees), "digests")
    classes, texts = _classes(digests, texts)
    reps = classes.select(F.col("node").alias("doc_id"), "n_shingles", "sig", "roots")
    threshold = percent / 100
    leaves, branched, to_pivots = chosen_path_leaves(
        reps, texts, percent, trees, min(enough, trees), leaf, per_step, branching or threshold, slack, max_steps
    )
    members = materialize(leaves.join(reps.drop("roots"), "doc_id"), "members")
    release(docs.sparkSession)
    links = confirmed(materialize(forest_pairs(members, threshold, slack), "pairs"), texts, percent)
    links = materialize(links if to_pivots is None else links.union(to_pivots), "links")
    first = materialize(components(links), "components")
    release(docs.sparkSession)
    with_component = members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    with_component = with_component.withColumn("component", F.coalesce("component", "doc_id"))
    if branched is not None:
        with_component = with_component.unionByName(across_components(branched, first, reps, leaf))
    open_members = materialize(undecided_members(with_component, threshold, slack), "undecided")
    discard(members)
    sets = _sets_of(texts, open_members.select("doc_id"))
    more = materialize(exact_links(open_members.join(sets, "doc_id"), percent), "links")
    last = first
    if more.limit(1).count():
        stars = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
        last = materialize(components(stars.union(more)), "components")
    by_class = classes.join(last, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component_id"))
    if "node" in texts.columns:  # the least node of a component need not have its least id
        least = by_class.groupBy(F.col("component_id").alias("component")).agg(F.min("rep").alias("least"))
        by_class = by_class.join(least, F.col("component_id") == F.col("component")).select("digest", F.col("least").alias("component_id"))
    found = digests.drop("sig", "roots").join(by_class.select("digest", "component_id"), "digest", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one of the least id; all columns pass through.

    Rows whose text has no words, and rows with a null id, stay. Of rows that repeat an id all stay, or
    none if each is a copy of a lesser id.
    """
    found = similarity_classes(docs, percent, id_col, text_col, **options)
    gone = found.groupBy(F.col("doc_id").alias("__gone")).agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("all")).filter("all").select("__gone")
    return docs.join(broadcast_if_small(materialize(gone, "gone")), F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
