"""Toxicity by a linear-chain conditional random field over tokens.

The field has two tags, clean and toxic. A token's potential is the sum of the weights of its features: the word, its
prefixes and its suffix, all in lower case and without surrounding punctuation. Forward-backward gives the marginal of
the toxic tag at every token; tokens of marginal 0.5 or more are the offending ones, and a logistic regression over
their aggregate gives the document score.

Labels exist for documents only, so the labelled tokens are derived: a token of a toxic document is tagged toxic when
one of its features is significantly more frequent in toxic documents than in clean ones. Everything is learned from a
bounded sample: the first ``max_toxic`` toxic and ``max_clean`` clean labelled documents by a hash of their id, and of
each at most ``max_tokens`` tokens, centred on the first tagged one. Scoring covers whole texts and all rows.

The chain is evaluated for many documents at once. A text is cut into segments of 512 tokens; each step advances all
segments of a slice by one token. Segment products link the segments of a text exactly, so a text of any length costs
the same number of steps, and memory is bounded by the slice.

Defined cases: null, empty and blank texts have no tokens and get the score of a text without toxic tokens; without
any toxic or without any clean labelled document every score is the share of toxic labels (0 if there are no labels);
rows without a label, or whose labels disagree, teach nothing; repeated rows are scored each for itself; texts of any
length are scored whole; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.op03_byte_bpe import slices
from routeloom.llm.workers import tidy
from routeloom.storage import materialize

_SEGMENT, _CACHE = 512, 250_000
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…"


def features(word: str) -> list[str]:
    """Features of a lower-case token: the bare word, prefixes of two to six letters, a suffix of three."""
    w = word.strip(_EDGE)
    if not w:
        return ["#"]
    n = len(w)
    return ["w" + w, *("p" + w[:k] for k in range(2, 7) if k < n), *(["s" + w[-3:]] if n > 3 else [])]


@dataclass
class Field:
    """Weights of the toxic tag by feature, log-potentials of tag pairs, and the document regression."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    bias: float = 0.0
    document: np.ndarray | None = None
    prior: float = 0.0
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"} | {"cache": {}}

    def potential(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            get = self.weights.get
            found = self.bias + sum(get(f, 0.0) for f in features(word))
            found = min(30.0, max(-30.0, found))
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            if len(word) <= 40:
                self.cache[word] = found
        return found


def marginals(potentials: list[np.ndarray], pairs: np.ndarray, start: float) -> list[np.ndarray]:
    """Marginal of the toxic tag at every token of every sequence, and exact for sequences of any length."""
    lengths = np.array([len(p) for p in potentials], dtype=np.int64)
    if not lengths.sum():
        return [np.zeros(0) for _ in potentials]
    pieces = [(d, s) for d, n in enumerate(lengths) for s in range(0, int(n), _SEGMENT)]
    size = np.array([min(_SEGMENT, int(lengths[d]) - s) for d, s in pieces])
    order = np.argsort(-size, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    active = np.searchsorted(-size[order], -np.arange(_SEGMENT), side="left")  # segments longer than t
    e = np.zeros((int(size.max()), len(pieces)))
    for i, (d, s) in enumerate(pieces):
        e[: size[i], rank[i]] = potentials[d][s : s + _SEGMENT]
    e = np.exp(e)
    a = np.exp(pairs)
    # products of a segment's step matrices, one row vector for each tag that may precede it
    first = np.array([s == 0 for _, s in pieces])[order]
    prod = np.empty((2, 2, len(pieces)))
    for tag in (0, 1):
        prod[tag, 0] = np.where(first, 1.0, a[tag, 0])
        prod[tag, 1] = np.where(first, np.exp(start), a[tag, 1]) * e[0]
    for t in range(1, len(e)):
        n = active[t]
        x0, x1 = prod[:, 0, :n], prod[:, 1, :n]
        y0, y1 = x0 * a[0, 0] + x1 * a[1, 0], (x0 * a[0, 1] + x1 * a[1, 1]) * e[t, :n]
        z = y0[0] + y1[0] + y0[1] + y1[1]
        prod[:, 0, :n], prod[:, 1, :n] = y0 / z, y1 / z
    # what enters each segment from the left, and from the right
    left, right = np.ones((2, len(pieces))), np.ones((2, len(pieces)))
    for i, (_, s) in enumerate(pieces):
        if s:
            b = rank[i - 1]
            v = prod[:, :, b].T @ left[:, b]
            left[:, rank[i]] = v / v.sum()
        else:
            left[:, rank[i]] = (1.0, 0.0)
    for i in range(len(pieces) - 1, 0, -1):
        if pieces[i][1]:
            b = rank[i]
            v = prod[:, :, b] @ right[:, b]
            right[:, rank[i - 1]] = v / v.sum()
    forward = np.empty((len(e), 2, len(pieces)))
    f0 = np.where(first, 1.0, left[0] * a[0, 0] + left[1] * a[1, 0])
    f1 = np.where(first, np.exp(start), left[0] * a[0, 1] + left[1] * a[1, 1]) * e[0]
    for t in range(len(e)):
        n = active[t]
        if t:
            f0, f1 = f0[:n], f1[:n]
            f0, f1 = f0 * a[0, 0] + f1 * a[1, 0], (f0 * a[0, 1] + f1 * a[1, 1]) * e[t, :n]
        z = f0 + f1
        f0, f1 = f0 / z, f1 / z
        forward[t, 0, :n], forward[t, 1, :n] = f0, f1
    tagged = np.zeros_like(e)
    b0, b1 = right[0].copy(), right[1].copy()
    for t in range(len(e) - 1, -1, -1):
        n = active[t]
        g0, g1 = forward[t, 0, :n] * b0[:n], forward[t, 1, :n] * b1[:n]
        tagged[t, :n] = g1 / (g0 + g1)
        if t:
            h1 = e[t, :n] * b1[:n]
            c0, c1 = a[0, 0] * b0[:n] + a[0, 1] * h1, a[1, 0] * b0[:n] + a[1, 1] * h1
            z = c0 + c1
            b0[:n], b1[:n] = c0 / z, c1 / z
    out = [np.zeros(int(n)) for n in lengths]
    for i, (d, s) in enumerate(pieces):
        out[d][s : s + _SEGMENT] = tagged[: size[i], rank[i]]
    return out


def chain_statistics(potentials: list[np.ndarray], pairs: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """What the gradient needs of short sequences: marginals laid end to end, expected tag pairs, expected toxic first tags."""
    lengths = np.array([len(p) for p in potentials])
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")  # sequences longer than t
    e = np.zeros((len(active), len(potentials)))
    for i, k in enumerate(order):
        e[: lengths[k], i] = potentials[k]
    e, a = np.exp(e), np.exp(pairs)
    forward = np.zeros((len(e), 2, len(potentials)))
    f0, f1 = np.ones(len(potentials)), np.exp(start) * e[0]
    for t, n in enumerate(active):
        if t:
            f0, f1 = f0[:n], f1[:n]
            f0, f1 = f0 * a[0, 0] + f1 * a[1, 0], (f0 * a[0, 1] + f1 * a[1, 1]) * e[t, :n]
        z = f0 + f1
        f0, f1 = f0 / z, f1 / z
        forward[t, 0, :n], forward[t, 1, :n] = f0, f1
    tagged, both = np.zeros_like(e), np.zeros((2, 2))
    b0, b1 = np.ones(len(potentials)), np.ones(len(potentials))
    for t in range(len(e) - 1, -1, -1):
        n = active[t]
        g0, g1 = forward[t, 0, :n] * b0[:n], forward[t, 1, :n] * b1[:n]
        tagged[t, :n] = g1 / (g0 + g1)
        if t:
            h0, h1 = b0[:n], e[t, :n] * b1[:n]
            p, q = forward[t - 1, 0, :n], forward[t - 1, 1, :n]
            joint = np.array([[p * a[0, 0] * h0, p * a[0, 1] * h1], [q * a[1, 0] * h0, q * a[1, 1] * h1]])
            both += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
            c0, c1 = a[0, 0] * h0 + a[0, 1] * h1, a[1, 0] * h0 + a[1, 1] * h1
            z = c0 + c1
            b0[:n], b1[:n] = c0 / z, c1 / z
    out = [np.zeros(0)] * len(potentials)
    for i, k in enumerate(order):
        out[k] = tagged[: lengths[k], i]
    return np.concatenate(out), both, float(tagged[0].sum())


def document_features(m: np.ndarray) -> tuple[float, float, float]:
    """Aggregate of a document's marginals: the largest, and the expected number and share of toxic tokens.

    Number and share count offending tokens only, so that the small marginals of a very long clean text don't add up.
    """
    if not len(m):
        return 0.0, 0.0, 0.0
    total = float(m[m >= 0.5].sum())
    return float(m.max()), float(np.log1p(total)), float(np.sqrt(total / len(m)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Regression by Newton's method; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _surprise(k: int, n: int, p: float) -> float:
    """Twice the log-likelihood ratio of k of n against a share p, for shares above p; else 0."""
    if k <= n * p:
        return 0.0
    rest = (n - k) * np.log((n - k) / (n * (1 - p))) if k < n else 0.0
    return 2 * float(k * np.log(k / (n * p)) + rest)


def tag_tokens(texts: list[list[str]], labels: list[int], least_surprise: float = 30.0, least_ratio: float = 8.0) -> list[np.ndarray]:
    """Token tags from document labels: which tokens of toxic documents carry a feature that marks those documents.

    A feature marks them when its places are in toxic documents far more often than all places are, by likelihood
    ratio and by the ratio of its rates in both kinds. A place is a token with both neighbours, counted once however
    often it is repeated, so that the ordinary words of a toxic text that was copied many times mark nothing.
    """
    seen: list[Counter] = [Counter(), Counter()]
    places: list[set[int]] = [set(), set()]
    for words, y in zip(texts, labels, strict=True):
        own, fresh = places[y], []
        for p, w, q in zip(["", *words], words, [*words[1:], ""], strict=False):
            k = hash((p, w, q))
            if k not in own:
                own.add(k)
                fresh.append(w)
        for w, c in Counter(fresh).items():
            for f in set(features(w)):
                seen[y][f] += c
    n = [max(1, len(places[0])), max(1, len(places[1]))]
    share = n[1] / (n[0] + n[1])
    marks = {
        f
        for f, c in seen[1].items()
        if _surprise(c, c + seen[0][f], share) >= least_surprise and (c + 0.5) / n[1] >= least_ratio * (seen[0][f] + 0.5) / n[0]
    }
    tags = []
    for words, y in zip(texts, labels, strict=True):
        tags.append(np.array([float(y == 1 and any(f in marks for f in features(w))) for w in words]))
    return tags


def fit(texts: list[str], labels: list[int], max_tokens: int = 200, steps: int = 30) -> Field:
    """Field and document regression from labelled texts.

    The weights of features, tag pairs and the first tag all go up their gradient, observed minus expected counts; pairs
    begin at their log counts.
    """
    model = Field(prior=float(np.mean(labels)) if labels else 0.0)
    if len(set(labels)) < 2:
        return model
    words = [(t or "").lower().split() for t in texts]
    tags = tag_tokens(words, labels)
    cut_words, cut_tags = [], []
    for w, g in zip(words, tags, strict=True):
        at = max(0, int(g.argmax()) - max_tokens // 2) if len(g) and g.any() else 0
        if len(w[at : at + max_tokens]):
            cut_words.append(w[at : at + max_tokens])
            cut_tags.append(g[at : at + max_tokens])
    y = np.concatenate(cut_tags)
    common = Counter(chain.from_iterable(map(features, chain.from_iterable(cut_words))))
    ids = {f: i for i, f in enumerate(f for f, c in common.items() if c >= 2)}
    by_word: dict[str, list[int]] = {}
    flat, owner = [], []
    for i, w in enumerate(chain.from_iterable(cut_words)):
        own = by_word.get(w)
        if own is None:
            own = by_word[w] = [ids[f] for f in features(w) if f in ids]
        flat.extend(own)
        owner.extend([i] * len(own))
    flat, owner = np.array(flat, dtype=np.int32), np.array(owner, dtype=np.int32)
    bounds = np.cumsum([0, *map(len, cut_tags)])
    seen_pairs = np.zeros((2, 2))
    for g in cut_tags:
        if len(g) > 1:
            np.add.at(seen_pairs, (g[:-1].astype(int), g[1:].astype(int)), 1)
    begun = np.log((seen_pairs + 1.0) / (seen_pairs + 1.0).sum(axis=1, keepdims=True))
    w, bias = np.zeros(len(ids)), 0.0
    # clean-clean stays 0: the other pairs, and the first tag, are relative to it
    chain_w = np.append((begun - begun[0, 0]).ravel()[1:], 0.0)
    first_tags = float(sum(g[0] for g in cut_tags))
    seen_chain = np.append(seen_pairs.ravel()[1:], first_tags)
    speed_w, speed_b, speed_c = np.full(len(ids), 1e-2), 1e-2, np.full(4, 1e-2)
    observed = np.bincount(flat, weights=y[owner], minlength=len(ids))
    for _ in range(steps):
        scores = np.clip(bias + np.bincount(owner, weights=w[flat], minlength=len(y)), -30, 30)
        pairs = np.append(0.0, chain_w[:3]).reshape(2, 2)
        m, both, firsts = chain_statistics([scores[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pairs, chain_w[3])
        g = observed - np.bincount(flat, weights=m[owner], minlength=len(ids)) - 0.05 * w
        speed_w += g * g
        w += 0.5 * g / np.sqrt(speed_w)
        gb = float(y.sum() - m.sum())
        speed_b += gb * gb
        bias += 0.5 * gb / np.sqrt(speed_b)
        gc = seen_chain - np.append(both.ravel()[1:], firsts) - 0.05 * chain_w
        speed_c += gc * gc
        chain_w += 0.5 * gc / np.sqrt(speed_c)
    model.bias, model.pairs, model.start = bias, np.append(0.0, chain_w[:3]).reshape(2, 2), float(chain_w[3])
    model.weights = {f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 0.02}
    whole = marginals([np.array([model.potential(x) for x in t]) for t in words], model.pairs, model.start)
    model.document = _logistic(np.array([document_features(m) for m in whole]), np.array(labels, dtype=float))
    model.cache.clear()
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = 1000,
    max_clean: int = 2000,
    max_chars: int = 6000,
    max_tokens: int = 200,
) -> Field:
    """Fit on a bounded sample: texts of up to ``max_chars`` first; of a longer one so many characters are learned from.

    The sample is drawn from narrow rows of id, label and length, and each task gives at most the sample's size. Its
    ids, whose number the parameters bound, are broadcast, and only the texts that they name reach the driver, one for
    each id: of rows that repeat an id the first text in order. Ids whose labels disagree teach nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    y = F.col(label_col).cast("int").alias("y")
    known = labels.select(F.col(id_col).alias("doc_id"), y).filter(F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    lengths = rows.filter("text is not null").groupBy("doc_id").agg(F.bool_or(F.length("text") > max_chars).alias("long")).join(known, "doc_id")
    narrow = materialize(lengths, "labelled")
    wanted: dict[int, int] = {}
    for value, most in ((1, max_toxic), (0, max_clean)):
        own = narrow.filter(F.col("y") == value).orderBy("long", F.xxhash64("doc_id"), "doc_id").limit(most)
        wanted |= {r["doc_id"]: value for r in own.select("doc_id").collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.substring("text", 1, max_chars)).alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] for r in found], [wanted[r["doc_id"]] for r in found], max_tokens)


def score_texts(model: Field, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int]]]]:
    """Score and offending character spans of each text."""
    words = [(t or "").lower().split() for t in texts]
    potential, cache = model.potential, model.cache
    rows = [np.array([cache[w] if w in cache else potential(w) for w in t]) for t in words]
    for text, m in zip(texts, marginals(rows, model.pairs, model.start), strict=True):
        if model.document is None:
            yield model.prior, []
            continue
        z = float(np.dot(model.document[:-1], document_features(m)) + model.document[-1])
        bad = np.flatnonzero(m >= 0.5)
        spans = []
        if len(bad):
            found = [x.span() for x in re.finditer(r"\S+", text)]
            spans = [found[i] for i in bad if i < len(found)]
        yield 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))), spans


def toxicity(docs: DataFrame, model: Field, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, spans`` for every whole text. One narrow pass; nothing is shuffled."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 2000, 3_000_000) for b in batches):
            found = list(score_texts(model, batch.column("text").to_pylist()))
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in found]
            columns = [
                batch.column("doc_id"),
                pa.array([s for s, _ in found], pa.float64()),
                pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                pa.array(spans, out.field(3).type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def reject_toxic(docs: DataFrame, model: Field, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns pass through one narrow pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            keep: list[bool] = []
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 2000, 3_000_000):
                keep += [s < threshold for s, _ in score_texts(model, part.column(0).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
