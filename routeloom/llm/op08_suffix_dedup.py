"""Removal of repeated byte strings by suffix arrays that linear grouping builds.

Every byte is removed that a string of ``length`` bytes covers which also starts earlier: in a document of smaller id,
or further left in the same one. Texts are UTF-8 bytes, and matches never cross documents.

1. Texts that equal an earlier text, by SHA-256, are copies. All of a copy of ``length`` bytes or more repeats; it goes
   no further.
2. Each remaining text is winnowed: of the hashes of its 32-byte strings the least in every window of ``length`` bytes
   is an anchor. Equal windows have equal anchors at equal places, so a window can repeat only if its anchor does.
3. An anchor that occurs once is done with. For the others the context is digested, all bytes of any window that the
   anchor may stand for. Contexts of equal 128-bit BLAKE2b digest are merged; all but the earliest repeat throughout.
4. What is left are different contexts of one anchor, whose bytes are cut out now. They are laid end to end and sorted
   by their suffixes (see suffix_grouping), a slice of many anchors at once; windows that are neighbours in that order
   and have equal bytes repeat, but for the earliest. Where there are two contexts, only what agrees around the anchor
   is sorted.
5. An anchor with more than ``leaf`` different contexts, as at the edge of a passage that a third of all documents
   share, is split by longer strings first: its contexts are winnowed again by strings of 56, 80 and at last ``length``
   bytes, with steps 3 and 4 for what each of these anchors brings together. Contexts that differ part where they
   differ, and those that don't are merged, so no anchor keeps many.
6. The repeated windows of a document are joined with its text once and their union is cut out.

Each step is a shuffle on an evenly spread hash or on the document, and is counted before it is shuffled where the
rows of one key can be many. What a document adds is in proportion to its bytes. Texts of more than a megabyte are
winnowed in overlapping pieces, so their length is bounded by what a row can hold only.

Defined cases: a null text is an empty text; texts shorter than ``length`` lose nothing; rows that repeat an id are
ordered by a hash of their texts, equal rows count as one document and get the same result; rows with a null id come
before all others; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.op03_byte_bpe import slices
from routeloom.llm.suffix_grouping import suffix_arrays
from routeloom.llm.wordhash import mix, powers
from routeloom.llm.workers import tidy
from routeloom.storage import discard, materialize, release

GRAM, LONGER = 32, (56, 80)
_PIECE = 1_000_000
_LOW = np.uint64((1 << 24) - 1)


def _hashes(data: np.ndarray, length: int, salt: int = 1) -> np.ndarray:
    """Hash of the ``length`` bytes from every position; shorter at the end of the data."""
    n = len(data)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(salt)) * p[:n], dtype=np.uint64, out=sums[1:])
    last = np.minimum(np.arange(n) + length, n)
    return mix((sums[last] - sums[:-1]) * q[:n])


def anchors_of(raws: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, and start and end of the context of every anchor of texts laid end to end.

    A context is all bytes of the windows that have the anchor; these windows follow one another. What a window's anchor
    is depends on the window's bytes only. Places must fit 24 bits, see ``_winnowed``.
    """
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    edges = np.cumsum([0, *map(len, raws)])
    whole = np.zeros(len(data) + 1, dtype=np.int8)  # windows that lie within one text
    fit = np.diff(edges) >= length
    np.add.at(whole, edges[:-1][fit], 1)
    np.add.at(whole, edges[1:][fit] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    h = _hashes(data, gram)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    width, reach = 1, length - gram + 1
    while width * 2 <= reach:
        least[:-width] = np.minimum(least[:-width], least[width:])  # at the end there is nothing to compare with
        width *= 2
    if reach > width:
        least[: width - reach] = np.minimum(least[: width - reach], least[reach - width :])
    at = (least[windows] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    text = np.searchsorted(edges, windows[first], side="right") - 1
    return text, h[at[first]], windows[first] - edges[text], windows[last] + length - edges[text]


def _winnowed(raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors_of``, a long text by pieces that share ``length - 1`` bytes, so that each window lies in one of them.

    A context that crosses an edge comes as two, of the same anchor.
    """
    if sum(map(len, raws)) <= 4 * _PIECE:
        return anchors_of(raws, length)
    found = []
    for i, raw in enumerate(raws):
        for base in range(0, max(1, len(raw) - length + 1), _PIECE):
            _, h, start, end = anchors_of([raw[base : base + _PIECE + length - 1]], length)
            found.append((np.full(len(h), i), h, start + base, end + base))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    fields = [("anchor", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 2000, 800_000) for b in batches):
            text, h, start, end = _winnowed([(t or "").encode() for t in batch.column("text").to_pylist()], length)
            owner = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "tie")]
            ends = [pa.array(x.astype(np.int32)) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *owner, *ends], schema=out)

    return texts.select("doc_id", "tie", "text").mapInArrow(tidy(run), "anchor long, doc_id long, tie long, start int, end int")


def _packed(rows: DataFrame) -> DataFrame:
    """``doc_id, tie, text`` with the text compressed to binary, for the shuffles that it has to go through."""
    out = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in chain.from_iterable(slices(b, 2000, 4_000_000) for b in batches):
            small = [compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(small, pa.binary())], schema=out)

    return rows.select("doc_id", "tie", "text").mapInArrow(tidy(run), "doc_id long, tie long, text binary")


def _digests(parts: list[bytes]) -> list[pa.Array]:
    """Both halves of the 128-bit digest of each byte string."""
    joined = b"".join([blake2b(p, digest_size=16).digest() for p in parts])
    halves = np.frombuffer(joined, dtype=np.int64).reshape(-1, 2)
    return [pa.array(halves[:, k]) for k in (0, 1)]


def _context_keys(found: DataFrame) -> DataFrame:
    """``anchor, k1, k2, doc_id, tie, start, end``: the context of each repeated anchor, with a digest of its bytes."""
    names = ("anchor", "k1", "k2", "doc_id", "tie")
    out = pa.schema([*((c, pa.int64()) for c in names), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in chain.from_iterable(slices(b, 2000, 700_000) for b in batches):
            lists = batch.column("places")
            places = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            take = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            start, end = places.field("start").to_pylist(), places.field("end").to_pylist()
            parts, i = [], 0
            for text, k in zip(batch.column("text").to_pylist(), counts.tolist(), strict=True):
                raw = unpack(text)
                parts += [raw[a:b] for a, b in zip(start[i : i + k], end[i : i + k], strict=True)]
                i += k
            owner = [batch.column(c).take(take) for c in ("doc_id", "tie")]
            yield pa.RecordBatch.from_arrays([places.field("anchor"), *_digests(parts), *owner, places.field("start"), places.field("end")], schema=out)

    return found.mapInArrow(tidy(run), "anchor long, k1 long, k2 long, doc_id long, tie long, start int, end int")


def _context_bytes(found: DataFrame) -> DataFrame:
    """``anchor, doc_id, tie, start, n, ctx`` from packed texts with a list ``places`` of contexts."""
    out = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int64()), ("ctx", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in chain.from_iterable(slices(b, 500, 700_000) for b in batches):
            lists = batch.column("places")
            places = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            take = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            start, end = places.field("start").to_pylist(), places.field("end").to_pylist()
            ctx, i = [], 0
            for text, k in zip(batch.column("text").to_pylist(), counts.tolist(), strict=True):
                raw = unpack(text)
                for _ in range(k):
                    ctx.append(raw[start[i] : end[i]])
                    i += 1
            columns = [places.field("anchor"), batch.column("doc_id").take(take), batch.column("tie").take(take), places.field("start"), places.field("n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ctx, pa.binary())], schema=out)

    return found.mapInArrow(tidy(run), "anchor long, doc_id long, tie long, start int, n long, ctx binary")


_SPANS = "doc_id long, tie long, start int, end int"


def _span_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def repeated_windows(anchor: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, ctx: list[bytes], length: int):
    """Row number and first place of every repeated window of rows sorted by anchor."""
    sizes = np.array([len(c) for c in ctx], dtype=np.int64)
    change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    last_of = np.concatenate([change[1:], [True]])
    parts = []
    for c, last in zip(ctx, last_of, strict=True):
        parts.append(c + b"\x00")
        if last:
            parts.append(b"\x00")
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    row_size = sizes + 1 + last_of
    row_start = np.concatenate([[0], np.cumsum(row_size)])
    row = np.repeat(np.arange(len(ctx)), row_size)
    offset = np.arange(len(raw)) - row_start[row]
    symbols = raw.astype(np.int64) + 2
    symbols[offset == sizes[row]] = 1  # between contexts
    ends = row_start[1:][last_of] - 1
    symbols[ends] = 0  # after the last context of an anchor
    starts = np.concatenate([[0], ends + 1])
    order = suffix_arrays(symbols, starts)
    order = order[offset[order] + length <= sizes[row[order]]]  # whole windows
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _hashes(raw, length)
    group = np.cumsum(change)[row[order]]
    differs = (h[order[1:]] != h[order[:-1]]) | (group[1:] != group[:-1])
    equal = np.flatnonzero(~differs)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    for i in range(0, len(equal), 20_000):  # the hash proposes, the bytes decide
        k = equal[i : i + 20_000]
        differs[k] = (view[order[k]] != view[order[k + 1]]).any(axis=1)
    run = np.concatenate([[0], np.cumsum(differs)])
    r = row[order]
    place = start[r] + offset[order]
    by = np.lexsort((place, tie[r], doc[r], run))
    run, r, place = run[by], r[by], place[by]
    head = np.concatenate([[True], run[1:] != run[:-1]])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc[r] != doc[r[lead]]) | (tie[r] != tie[r[lead]]) | (place != place[lead])
    return r[later], place[later]


def trimmed_pairs(anchor: np.ndarray, start: np.ndarray, ctx: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of anchors with two contexts each, in rows 2i and 2i + 1: which rows to sort, and their starts and bytes.

    Equal windows have their anchor at equal places, so what two contexts can have in common is one run of equal bytes
    around it. Contexts are cut to that run, and left out if it is shorter than a window.
    """
    data = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    sizes = np.array([len(c) for c in ctx], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(ctx)), sizes)
    places = np.flatnonzero(_hashes(data, GRAM) == anchor.view(np.uint64)[row])
    places = places[places + GRAM <= (begin + sizes)[row[places]]]
    found, first = np.unique(row[places], return_index=True)
    if len(found) < len(ctx):
        return np.arange(len(ctx)), start, ctx
    at = places[first] - begin
    reach = length - GRAM
    step = np.arange(-reach, GRAM + reach)
    left = np.minimum(at[::2], at[1::2])
    right = np.minimum((sizes - at)[::2], (sizes - at)[1::2])  # from the anchor's first byte on
    inside = (step >= -left[:, None]) & (step < right[:, None])
    side = lambda k: data[np.clip(places[first][k::2][:, None] + step, 0, len(data) - 1)]
    differs = ~(inside & (side(0) == side(1)))
    before, after = differs[:, :reach][:, ::-1], differs[:, reach + GRAM :]
    n_left = np.where(before.any(axis=1), before.argmax(axis=1), reach)
    n_right = np.where(after.any(axis=1), after.argmax(axis=1), reach)
    kept = np.flatnonzero(~differs[:, reach : reach + GRAM].any(axis=1) & (n_left + GRAM + n_right >= length))
    rows = np.repeat(2 * kept, 2) + np.tile([0, 1], len(kept))
    low, high = at[rows] - n_left[rows // 2], at[rows] + GRAM + n_right[rows // 2]
    return rows, start[rows] + low, [ctx[r][a:b] for r, a, b in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True)]


def _joined_spans(doc: np.ndarray, tie: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of the windows' bytes, consecutive windows of a text joined."""
    by = np.lexsort((place, tie, doc))
    doc, tie, place = doc[by], tie[by], place[by]
    cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (place[1:] > place[:-1] + length)]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    columns = [doc[first], tie[first], place[first].astype(np.int32), (place[last] + length).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_span_schema())


def _sorted_by_suffix(contexts: DataFrame, length: int, trim: bool, most_bytes: int = 1_200_000) -> DataFrame:
    """Repeated spans among different contexts of one anchor; rows of an anchor meet in one task, a bounded number.

    With ``trim``, for anchors that are hashes of ``GRAM`` bytes, pairs of contexts are cut to what they have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(table: pa.Table) -> pa.RecordBatch:
            """Anchors of alike numbers of contexts go in step together: a step costs the same for few and for many."""
            anchor = table.column("anchor").to_numpy()
            change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            first = np.flatnonzero(change)
            many = np.repeat(np.diff(np.append(first, len(anchor))), np.diff(np.append(first, len(anchor))))
            found = []
            for low, high in itertools.pairwise((0, 2, 4, 10, 30, 1 << 62)):
                part = table.filter(pa.array((many > low) & (many <= high)))
                if part.num_rows:
                    own, doc, tie, start = (part.column(c).to_numpy() for c in ("anchor", "doc_id", "tie", "start"))
                    ctx = part.column("ctx").to_pylist()
                    if trim and high == 2 and len(ctx) % 2 == 0 and (own[::2] == own[1::2]).all():
                        rows, start, ctx = trimmed_pairs(own, start, ctx, length)
                        own, doc, tie = own[rows], doc[rows], tie[rows]
                        if not ctx:
                            continue
                    r, place = repeated_windows(own, doc, tie, start, ctx, length)
                    found.append((doc[r], tie[r], place))
            if not found:
                return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _span_schema()], schema=_span_schema())
            return _joined_spans(*(np.concatenate(x) for x in zip(*found, strict=True)), length)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > most_bytes:  # all but the last anchor, which may go on in the next batch
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                n = int(np.searchsorted(anchor, anchor[-1], side="left"))
                if n:
                    yield solve(table.slice(0, n))
                held = table.slice(n).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held) if len(held[0]) * length < most_bytes else 0
        if held:
            yield solve(pa.Table.from_batches(held))

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(run), _SPANS)


def _refined(contexts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Contexts winnowed again by longer strings: repeated spans, and ``anchor, doc_id, tie, start, n, ctx`` of what is left.

    What is left are the earliest of equal contexts, of anchors that have n > 1 different ones.
    """
    names = ("anchor", "k1", "k2", "doc_id", "tie")
    out = pa.schema([*((c, pa.int64()) for c in names), ("start", pa.int32()), ("ctx", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4000) for b in batches for i in range(0, b.num_rows, 4000)):
            raws = batch.column("ctx").to_pylist()
            row, h, start, end = anchors_of(raws, length, gram)
            take = pa.array(row)
            finer = mix(batch.column("anchor").to_numpy().view(np.uint64)[row] + mix(h + np.uint64(gram)))
            parts = [raws[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
            owner = [batch.column(c).take(take) for c in ("doc_id", "tie")]
            at = pa.array((batch.column("start").to_numpy()[row] + start).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), *_digests(parts), *owner, at, pa.array(parts, pa.binary())], schema=out)

    rows = contexts.select("anchor", "doc_id", "tie", "start", "ctx")
    rows = materialize(rows.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names) + ", start int, ctx binary"), "finer-contexts")
    place, key = F.struct("doc_id", "tie", "start"), ["anchor", "k1", "k2"]
    distinct = materialize(rows.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")), "finer-distinct")
    several = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "finer-several")
    ends = rows.select(*key, "doc_id", "tie", "start", (F.col("start") + F.octet_length("ctx")).alias("end"))
    again = ends.join(distinct.filter("rows > 1").select(*key, "first"), key).filter(place != F.col("first"))
    spans = again.select("doc_id", "tie", "start", "end")
    firsts = distinct.join(several, "anchor").select("anchor", "k1", "k2", "first.*", "n")
    left = firsts.join(rows, [*key, "doc_id", "tie", "start"]).select("anchor", "doc_id", "tie", "start", "n", "ctx")
    return spans, left.dropDuplicates(["anchor", "doc_id", "tie", "start"])


def _cut_out(rows: DataFrame) -> DataFrame:
    """``doc_id, tie, kept, n_bytes, n_removed, n_spans`` from rows with the text and its repeated spans, if any."""
    out = pa.schema(
        [("doc_id", pa.int64()), ("tie", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in chain.from_iterable(slices(b, 2000, 2_000_000) for b in batches):
            kept, sizes, removed, runs = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = unpack(text)
                parts, at, n = [], 0, 0
                end = -1
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if a > end:
                        parts.append(raw[at:a])
                        n += 1
                        end = b
                    else:
                        end = max(end, b)
                    at = end
                parts.append(raw[at:])
                rest = b"".join(parts)
                kept.append(rest)
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                runs.append(n)
            columns = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *columns], schema=out)

    return rows.mapInArrow(tidy(run), "doc_id long, tie long, kept binary, n_bytes long, n_removed long, n_spans long")


def suffix_dedup(docs: DataFrame, length: int = 100, leaf: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept binary, n_bytes, n_removed, n_spans``: each text without the bytes that repeat."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(own.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    narrow = materialize(rows.select("doc_id", digest, F.octet_length("text").alias("n")), "texts")
    again = bool(narrow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count())
    tie = lambda h: (h if again else F.lit(0).cast("long")).alias("tie")
    rows = rows.withColumn("tie", tie(F.xxhash64(F.unhex(F.sha2("text", 256)))))
    keyed = narrow.filter(F.col("n") >= length).select("doc_id", tie(F.xxhash64("digest")), "digest", "n")
    first = keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    copies = keyed.join(first, "digest").filter(F.struct("doc_id", "tie") != F.col("first"))
    copies = materialize(copies.select("doc_id", "tie", "n").distinct(), "copies")
    discard(narrow)
    texts = rows.filter(F.octet_length("text") >= length).join(copies, ["doc_id", "tie"], "left_anti")
    if again:
        texts = texts.dropDuplicates(["doc_id", "tie"])

    anchors = materialize(_anchors(texts, length), "all-anchors")
    repeated = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    repeated = materialize(repeated, "anchors")
    release(docs.sparkSession)
    places = anchors.join(repeated, "anchor").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "start", "end")).alias("places"))
    contexts = materialize(_context_keys(_packed(texts).join(places, ["doc_id", "tie"])), "contexts")
    discard(anchors, repeated)
    release(docs.sparkSession)

    key, place = ["k1", "k2"], F.struct("doc_id", "tie", "start")
    distinct = contexts.groupBy(*key).agg(F.min(place).alias("first"), F.first("anchor").alias("anchor"))  # equal contexts have equal anchors
    distinct = materialize(distinct, "distinct-contexts")
    release(docs.sparkSession)
    several = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    marked = contexts.drop("anchor").join(distinct, key).select("*", (place == F.col("first")).alias("is_first")).drop("first", *key)
    marked = materialize(marked, "marked")
    discard(contexts, distinct)
    release(docs.sparkSession)
    spans = marked.filter("not is_first").select("doc_id", "tie", "start", "end")
    firsts = marked.filter("is_first").drop("is_first").dropDuplicates(["anchor", "doc_id", "tie", "start", "end"]).join(several, "anchor")
    wanted = firsts.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "start", "end", "n")).alias("places"))
    firsts = materialize(_context_bytes(_packed(texts).join(wanted, ["doc_id", "tie"])), "first-contexts")
    release(docs.sparkSession)
    hot, used = firsts.filter(F.col("n") > leaf), [firsts, marked, several]
    spans = spans.union(_sorted_by_suffix(firsts.filter(F.col("n") <= leaf).drop("n"), length, trim=True))
    for gram in [*(g for g in LONGER if g < length), length]:
        if not hot.limit(1).count():
            break
        more, left = _refined(hot, length, gram)
        left = materialize(left, "finer-firsts")
        used.append(left)
        # anchors of whole windows have one context each, but for collisions of their hashes
        few = F.lit(True) if gram == length else F.col("n") <= leaf
        spans = spans.union(more).union(_sorted_by_suffix(left.filter(few).drop("n"), length, trim=False))
        hot = left.filter(~few)
    spans = spans.union(copies.select("doc_id", "tie", F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    per_text = materialize(spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(*used)
    release(docs.sparkSession)
    found = _cut_out(_packed(rows).join(per_text, ["doc_id", "tie"], "left").select("doc_id", "tie", "text", "spans"))
    null_id = F.col("doc_id") == F.lit(-(1 << 63))
    return found.select(F.when(~null_id, F.col("doc_id")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")
