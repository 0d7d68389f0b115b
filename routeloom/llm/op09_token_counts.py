"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a batch are inserted in a trie of bytes. The forward score of a node is the best
log-probability of any segmentation of its prefix, so it is computed once for all pre-tokens that share the prefix;
a terminal node stores the number of pieces on its best path. A document's count is the sum over its pre-tokens.

The trie is walked in byte order: the path from the root to the last inserted pre-token is a stack, and the next
pre-token reuses the part of the stack that both share. Memory is the longest pre-token plus the distinct ones of a
batch of bounded size.

Defined cases: a null or empty text counts 0 tokens; ties between segmentations go to the one with fewer pieces;
bytes that no piece covers count as one piece each at ``unknown`` log-probability; repeated rows are counted each for
itself; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.op03_byte_bpe import load_ranks, slices
from routeloom.llm.workers import tidy

#: Counts of short pre-tokens that a worker remembers, in each of two generations.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 48


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of a ranked vocabulary by Zipf's law: p proportional to 1 / (rank + 2.7)."""
    norm = math.log(sum(1 / (r + 2.7) for r in ranks.values()))
    return {t: -math.log(r + 2.7) - norm for t, r in ranks.items()}


def trie_counts(pieces: Iterable[bytes], scores: dict[bytes, float], longest: int, unknown: float = -30.0) -> dict[bytes, int]:
    """Number of vocabulary pieces on the best path of each distinct pre-token."""
    counts: dict[bytes, int] = {}
    best, used = [0.0], [0]  # the stack: forward score and number of pieces at each depth of the current path
    last = b""
    get = scores.get
    for piece in sorted(set(pieces)):
        n, shared = len(piece), 0
        most = min(n, len(last))
        if piece[:most] == last[:most]:
            shared = most
        else:
            while piece[shared] == last[shared]:
                shared += 1
        del best[shared + 1 :], used[shared + 1 :]
        for d in range(shared + 1, n + 1):
            top, steps = best[d - 1] + unknown, used[d - 1] + 1
            for start in range(d - 1, max(0, d - longest) - 1, -1):
                s = get(piece[start:d])
                if s is not None:
                    s += best[start]
                    if s > top or (s == top and used[start] < steps - 1):
                        top, steps = s, used[start] + 1
            best.append(top)
            used.append(steps)
        counts[piece] = used[n]
        last = piece
    return counts


class Counter(dict):
    """Counts by pre-token, with the trie pass for those that are new in a batch."""

    def __init__(self, scores: dict[bytes, float], pattern: str) -> None:
        super().__init__()
        self.scores, self.longest, self.old = scores, max(map(len, scores), default=1), {}
        self.find = regex.compile(pattern).findall

    def count(self, texts: list[str | None]) -> list[int]:
        found = [self.find(t) if t else [] for t in texts]
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        new = set(chain.from_iterable(found)).difference(self)
        for p in new.intersection(self.old):
            self[p] = self.old[p]
        new.difference_update(self.old)
        by_bytes = {p.encode(): p for p in new}
        self.update((by_bytes[b], n) for b, n in trie_counts(by_bytes, self.scores, self.longest).items())
        get = self.__getitem__
        totals = [sum(map(get, pieces)) for pieces in found]
        for p in new:
            if len(p) > CACHE_LENGTH:
                del self[p]
        return totals


_counters: dict[tuple[str, str], Counter] = {}


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` long and ``n_bytes`` long of every whole text. One narrow pass; nothing is shuffled."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (ranks_path, pattern) not in _counters:
            _counters[ranks_path, pattern] = Counter(zipf_scores(load_ranks(ranks_path)), pattern)
        counter = _counters[ranks_path, pattern]
        for batch in chain.from_iterable(map(slices, batches)):
            texts = batch.column("text").to_pylist()
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counter.count(texts), pa.int64()), sizes], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_bytes long")
