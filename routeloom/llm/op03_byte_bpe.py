"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte spans. Every adjacent pair whose bytes have a merge rank waits in the
bucket of that rank; a two-level bitmap over the ranks finds the lowest non-empty bucket by find-first-set. A popped
position is stale when its pair has changed since it was queued, and is skipped. Each merge costs a constant number
of bitmap operations, so a pre-token of a million bytes is as cheap per byte as a short one.

Defined cases: a null text is an empty text (no ids); an empty table gives an empty result; repeated rows are encoded
each for itself; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.workers import tidy

#: The longest pre-token whose ids a worker remembers.
CACHE_LENGTH = 48


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from the lines of a ``.tiktoken`` file: base64 of the token's bytes, a space, the rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f)


class RankQueue:
    """Positions by merge rank; ``pop`` gives the leftmost position of the lowest rank.

    A rank with one waiting position, which is nearly every one, has the bare position as its bucket.
    """

    __slots__ = ("blocks", "buckets", "top")

    def __init__(self) -> None:
        self.top = 0
        self.blocks: dict[int, int] = {}
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = at
            block = rank >> 8
            self.blocks[block] = self.blocks.get(block, 0) | 1 << (rank & 255)
            self.top |= 1 << block
        elif bucket.__class__ is int:
            self.buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        bits = self.blocks[block]
        low = bits & -bits
        rank = (block << 8) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if bucket.__class__ is not int:
            at = heappop(bucket)
            if bucket:
                return rank, at
        else:
            at = bucket
        del self.buckets[rank]
        self.blocks[block] = bits = bits ^ low
        if not bits:
            self.top = top ^ (1 << block)
        return rank, at


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # end[i]: where the span that starts at i ends; 0 once i was merged away
    before = list(range(-1, n - 1))
    waiting = [-1] * n  # the rank under which the pair that starts at i was queued last
    queue = RankQueue()
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            waiting[i] = rank
            queue.push(rank, i)
    push, pop = queue.push, queue.pop
    while (found := pop()) is not None:
        rank, i = found
        if waiting[i] != rank:
            continue
        j = end[i]
        after = end[j]
        end[i], end[j], waiting[j] = after, 0, -1
        if after < n:
            before[after] = i
            r = get(piece[i : end[after]])
            if r is None:
                waiting[i] = -1
            else:
                waiting[i] = r
                push(r, i)
        else:
            waiting[i] = -1
        p = before[i]
        if p >= 0:
            r = get(piece[p:after])
            if r is None:
                waiting[p] = -1
            else:
                waiting[p] = r
                push(r, p)
    ids, i = [], 0
    while i < n:
        j = end[i]
        ids.append(ranks[piece[i:j]])
        i = j
    return tuple(ids)


class Encoder(dict):
    """Ids by pre-token, packed as 32-bit integers, computed when missing; holds two generations of a bounded number
    of short pre-tokens.

    The ids of a text are the packed ids of its pre-tokens end to end: no id of a known pre-token becomes a Python
    object, neither here nor when all ids of a batch are decoded at once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = 300_000) -> None:
        super().__init__()
        self.ranks, self.old, self.entries = ranks, {}, entries
        self.find = regex.compile(pattern).findall
        by_rank = {r: t for t, r in ranks.items()}
        self.tokens = pa.array([by_rank.get(r) for r in range(max(by_rank, default=-1) + 1)], pa.binary())

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", encode_piece(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.fromiter(ids, np.int32)
        return self.decoded(ids, np.array([0, len(ids)]))[0].as_py()

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each row of ids; ``offsets`` has where each row starts, and the end."""
        if not len(ids):
            return pa.array([b""] * (len(offsets) - 1), pa.binary())
        _, ends, data = self.tokens.take(pa.array(ids)).buffers()
        ends = np.frombuffer(ends, np.int32)[offsets]
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), data])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str, entries: int) -> Encoder:
    """One encoder for each vocabulary and worker process; it keeps what it remembers between tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    _encoders[path, pattern].entries = entries
    return _encoders[path, pattern]


def slices(batch: pa.RecordBatch, most_rows: int = 1000, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a bounded number of rows and, but for a single row, of bytes."""
    lengths = [0 if t is None else t for t in pa.compute.binary_length(batch.column("text")).to_pylist()]
    at = size = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= most_rows or size + n > most_bytes):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield batch.slice(at)


def bpe_encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
    remembered: int = 300_000,
) -> DataFrame:
    """``doc_id``, ``ids`` array<int> and, if asked for, ``decoded`` binary: the bytes that those ids decode to.

    ``ranks_path`` names a vocabulary file that every executor has. The whole text is encoded, each match of
    ``pattern`` separately, without special tokens. One narrow pass; nothing is shuffled. A worker remembers the ids
    of twice ``remembered`` short pre-tokens, at about 250 bytes each.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.binary())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern, remembered)
        for batch in chain.from_iterable(map(slices, batches)):
            packed = [enc.packed(text) if text else b"" for text in batch.column("text").to_pylist()]
            ids = np.frombuffer(b"".join(packed), np.int32)
            offsets = np.cumsum([0, *map(len, packed)]) // 4
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
            if decoded:
                columns.append(enc.decoded(ids, offsets))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` binary of rows of ids; a null list decodes to no bytes, an unknown id is an error."""
    out = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {r: t for t, r in load_ranks(ranks_path).items()}
        for batch in batches:
            plain = [b"".join(bytes_of[i] for i in ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(plain, pa.binary())], schema=out)

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(run), "doc_id long, decoded binary")
