"""Language id, toxicity, byte-level BPE and token counts."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import regex
import tiktoken
import zstandard
from pyspark.sql import functions as F

from routeloom.llm import op01_language_id as op1
from routeloom.llm import op02_toxicity as op2
from routeloom.llm import op03_byte_bpe as op3
from routeloom.llm import op09_token_counts as op9
from routeloom.llm import registry
from tests.compare import DATA

ODD = [(1, None, "x"), (2, "", "x"), (3, "  \n\t ", "x"), (4, "12 !! 34", "x"), (5, "word " * 60_000, "x"), (6, "a" * 70_000, "x"), (7, "Ünïcødé 字🎉\x00", "x"), (7, "Ünïcødé 字🎉\x00", "x")]
SCHEMA = "doc_id long, text string, score string"  # score clashes with a column of some results


@pytest.fixture(scope="module")
def vocabulary():
    return registry.vocabulary()


@pytest.fixture(scope="module")
def theirs(vocabulary):
    path, pattern = vocabulary
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op3.load_ranks(path), special_tokens={})


def test_rank_queue_gives_the_lowest_rank_leftmost():
    q, r = op3.RankQueue(), random.Random(1)
    items = [(r.choice([0, 3, 255, 256, 50_000]), i) for i in range(200)]
    for rank, i in r.sample(items, len(items)):
        q.push(rank, i)
    assert [q.pop() for _ in items] == sorted(items) and q.pop() is None


def test_bpe_equals_the_library(vocabulary, theirs):
    path, pattern = vocabulary
    ours, r = op3.Encoder(op3.load_ranks(path), pattern), random.Random(2)
    for _ in range(1500):
        text = "".join(r.choice("ab aAéñ\n\t 1234,.!'s字🎉\u00a0") for _ in range(r.randint(0, 50)))
        assert ours.encode(text) == theirs.encode_ordinary(text)
        assert ours.decode(ours.encode(text)) == text.encode()
    long = "ab" * 30_000 + "a" * 20_000
    assert ours.encode(long) == theirs.encode_ordinary(long)


def test_packed_ids_of_a_batch_decode_at_once():
    path, pattern = registry.vocabulary()
    enc = op3.Encoder(op3.load_ranks(path), pattern)
    texts = ["", "one two  three\n", "", "", "\U0001f600\u5b57x" * 70, "a", ""]
    packed = [enc.packed(t) for t in texts]
    ids, offsets = np.frombuffer(b"".join(packed), np.int32), np.cumsum([0, *map(len, packed)]) // 4
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [enc.encode(t) for t in texts]
    assert enc.decoded(ids, offsets).to_pylist() == [t.encode() for t in texts]
    assert enc.decoded(ids[:0], np.zeros(3, np.int64)).to_pylist() == [b"", b""]
    assert enc.decoded(ids[:0], np.zeros(1, np.int64)).to_pylist() == []


def test_bpe_query_over_the_whole_table(spark, theirs):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = registry.op3_byte_bpe(spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(spark, vocabulary):
    path, pattern = vocabulary
    frame = spark.createDataFrame(ODD, SCHEMA)
    coded = op3.bpe_encode(frame, path, pattern)
    assert coded.count() == len(ODD) and coded.filter("doc_id in (1, 2)").select(F.sum(F.size("ids"))).first()[0] == 0
    back = {r.doc_id: bytes(r.decoded) for r in op3.bpe_decode(coded, path).collect()}
    assert all(back[i] == (t or "").encode() for i, t, _ in ODD)
    assert op3.bpe_encode(frame.limit(0), path, pattern).count() == 0


def _fewest(piece: bytes, scores: dict[bytes, float], unknown: float) -> int:
    """Pieces of the best segmentation, by plain recursion over all of them."""
    best = {0: (0.0, 0)}
    for end in range(1, len(piece) + 1):
        options = [(best[end - 1][0] + unknown, best[end - 1][1] + 1)]
        for start in range(end):
            s = scores.get(piece[start:end])
            if s is not None:
                options.append((best[start][0] + s, best[start][1] + 1))
        top = max(o[0] for o in options)
        best[end] = (top, min(o[1] for o in options if o[0] == top and o[1] > 0))
    return best[len(piece)][1]


def test_trie_counts_equal_plain_dynamic_programming():
    r = random.Random(3)
    scores = {bytes(p): -r.random() * 5 for n in (1, 2, 3) for p in itertools.product(b"abc", repeat=n) if n == 1 or r.random() < 0.5}
    pieces = [bytes(r.choice(b"abcd") for _ in range(r.randint(1, 12))) for _ in range(400)]
    found = op9.trie_counts(pieces, scores, 3)
    assert all(found[p] == _fewest(p, scores, -30.0) for p in pieces)


def test_token_counts_add_up(spark, vocabulary):
    path, pattern = vocabulary
    frame = spark.createDataFrame(ODD, SCHEMA)
    found = {r.doc_id: r for r in op9.token_counts(frame, path, pattern).collect()}
    assert found[1].n_tokens == 0 and found[2].n_tokens == 0 and found[1].n_bytes == 0
    assert found[5].n_tokens >= 60_000 and found[6].n_bytes == 70_000
    assert op9.token_counts(frame.limit(0), path, pattern).count() == 0
    whole = registry.op9_token_counts(spark, DATA)
    assert whole.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_token_counts_of_the_table_equal_plain_dynamic_programming(spark, vocabulary):
    path, pattern = vocabulary
    scores = op9.zipf_scores(op9.load_ranks(path))
    longest, counts = max(map(len, scores)), {}

    def count(piece):
        best = [(0.0, 0)]
        for end in range(1, len(piece) + 1):
            options = [(best[end - 1][0] - 30.0, -best[end - 1][1] - 1)]
            for start in range(max(0, end - longest), end):
                if piece[start:end] in scores:
                    options.append((best[start][0] + scores[piece[start:end]], -best[start][1] - 1))
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    found = {r.doc_id: r for r in registry.op9_token_counts(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        pieces = [p.encode() for p in regex.findall(pattern, r.text or "")]
        for p in set(pieces) - counts.keys():
            counts[p] = count(p)
        assert (found[r.doc_id].n_tokens, found[r.doc_id].n_bytes) == (sum(counts[p] for p in pieces), len((r.text or "").encode()))


def test_language_of_held_out_texts(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    found = registry.op1_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    held = found.join(truth, "doc_id").filter("held_out and lang is not null and n > 40")
    good, all_ = held.filter("lang = lang_pred").count(), held.count()
    assert good / all_ > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect())


def test_language_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    model = {"en": b"the and of to in is that", "fr": b"le la les et de un une"}
    found = {r.doc_id: r for r in op1.language_id(frame, model).collect()}
    assert all((found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3, 4))
    assert found[5].lang_pred in model and 0 <= found[5].score <= 1
    assert {r.lang_pred for r in op1.language_id(frame, {}).collect()} == {"und"}
    assert op1.train_dictionaries(frame.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert op1.language_id(frame.limit(0), model).count() == 0
    narrow = op1.CompressionClassifier(model).predict("xyz", margin=0.99)
    assert narrow[3] and narrow[0] in model


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    pairs, start = np.array([[0.0, -1.5], [0.3, 1.0]]), 0.4
    for n in (1, 2, 5, 8):
        e, z, m = rng.normal(size=n), 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            s = sum(e[i] for i in range(n) if tags[i]) + sum(pairs[a, b] for a, b in itertools.pairwise(tags)) + start * tags[0]
            z, m = z + np.exp(s), m + np.exp(s) * np.array(tags)
        assert np.allclose(op2.marginals([e, rng.normal(size=1200)], pairs, start)[0], m / z)


def test_marginals_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=k) for k in (1500, 3, 700, 0, 512, 513)]
    pairs = np.array([[0.0, -1.0], [0.2, 0.5]])
    a = op2.marginals(rows, pairs, 0.1)
    monkeypatch.setattr(op2, "_SEGMENT", 5000)
    b = op2.marginals(rows, pairs, 0.1)
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))


def test_chain_statistics_equal_enumeration():
    rng = np.random.default_rng(2)
    pairs, start = np.array([[0.0, -1.5], [0.3, 1.0]]), -0.4
    rows = [rng.normal(size=n) for n in (3, 1, 6, 2, 6)]
    want_m, want_pairs, want_first = [], np.zeros((2, 2)), 0.0
    for e in rows:
        z, m, both, first = 0.0, np.zeros(len(e)), np.zeros((2, 2)), 0.0
        for tags in itertools.product((0, 1), repeat=len(e)):
            p = np.exp(sum(e[i] for i in range(len(e)) if tags[i]) + sum(pairs[a, b] for a, b in itertools.pairwise(tags)) + start * tags[0])
            z, m, first = z + p, m + p * np.array(tags), first + p * tags[0]
            for a, b in itertools.pairwise(tags):
                both[a, b] += p
        want_m.append(m / z)
        want_pairs += both / z
        want_first += first / z
    m, both, first = op2.chain_statistics(rows, pairs, start)
    assert np.allclose(m, np.concatenate(want_m)) and np.allclose(both, want_pairs) and np.isclose(first, want_first)


def test_pair_and_start_weights_are_learned():
    """Toxic words come in runs and never first: the learned chain prefers staying over starting."""
    r = random.Random(6)
    plain = [" ".join(r.choices(["alpha", "beta", "gamma"], k=30)) for _ in range(40)]
    toxic = [" ".join([*r.choices(["alpha", "beta"], k=10), *["vilewort"] * 4, *r.choices(["beta", "gamma"], k=10)]) for _ in range(40)]
    model = op2.fit(plain + toxic, [0] * 40 + [1] * 40)
    assert model.start < 0 and model.pairs[1, 1] > model.pairs[0, 1] and model.pairs[0, 0] == 0


def test_toxicity_of_the_table_equals_a_plain_forward_backward(spark):
    model = registry.train_toxicity(spark, DATA)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {r.doc_id: r for r in registry.op2_toxicity(spark, DATA).collect()}
    a = np.exp(model.pairs)
    for k, text in texts.items():
        e = [(1.0, float(np.exp(model.potential(w)))) for w in text.lower().split()]
        forward, v = [], None
        for t, x in enumerate(e):
            v = np.array([1.0, np.exp(model.start)]) * x if not t else (v @ a) * x
            v = v / v.sum()
            forward.append(v)
        m, b = np.zeros(len(e)), np.ones(2)
        for t in range(len(e) - 1, -1, -1):
            g = forward[t] * b
            m[t] = g[1] / g.sum()
            b = a @ (np.array(e[t]) * b)
            b = b / b.sum()
        z = float(np.dot(model.document[:-1], op2.document_features(m)) + model.document[-1])
        assert np.isclose(found[k].score, 1 / (1 + np.exp(-np.clip(z, -30, 30))), atol=1e-6)
        places = [x.span() for x in re.finditer(r"\S+", text)]
        sure = [places[i] for i in np.flatnonzero(m >= 0.5 + 1e-9) if i < len(places)]
        assert set(sure) <= {(s.start, s.end) for s in found[k].spans} and len(found[k].spans) <= int((m >= 0.5 - 1e-9).sum())


def test_training_takes_one_text_of_an_id_and_no_doubtful_label(spark):
    docs = spark.createDataFrame([(i, f"alpha {'vilewort' if i % 2 else 'beta'} gamma", "x") for i in range(200)] + [(1, "aaa other", "x")] * 50, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 1), (5, 0)], "doc_id long, toxic int")
    seen = []
    keep = op2.fit
    try:
        op2.fit = lambda texts, y, *a: seen.extend(zip(texts, y, strict=True)) or keep(texts, y, *a)
        op2.train(docs, labels)
    finally:
        op2.fit = keep
    assert len(seen) == 198 and ("aaa other", 1) in seen


def test_language_of_the_table_equals_plain_compression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op1.train_dictionaries(docs.filter(~registry.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.op1_language_id(spark, DATA).collect():
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = {}
        for lang, content in model.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=5)
            c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = len(c.compress(op1.normalized(text)))
        assert r.lang_pred == min(model, key=lambda x: (sizes[x], list(model).index(x))) and 1 / len(model) - 1e-9 <= r.score <= 1
        best, second = sorted(sizes.values())[:2]
        assert np.isclose(r.margin, (second - best) / second) and r.rejected == (r.margin < 0.02)


def test_toxicity_of_held_out_texts(spark):
    sf = DATA.replace("sf0.001", "sf0.1")
    found = registry.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    hit, said, toxic = (found.filter(c).count() for c in ("predicted = 1 and toxic = 1", "predicted = 1", "toxic = 1"))
    assert hit / said > 0.95 and hit / toxic > 0.85
    assert found.filter("not score between 0 and 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_toxicity_spans_and_odd_rows(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    plain = [" ".join(r.choices(words, k=30)) for _ in range(60)]
    toxic = [" ".join(r.sample(r.choices(words, k=30) + ["vilewort"], 31)) for _ in range(60)]
    model = op2.fit(plain + toxic, [0] * 60 + [1] * 60)
    [(score, spans)] = op2.score_texts(model, ["alpha vilewort, beta"])
    assert score >= 0.7 and spans == [(6, 15)]
    frame = spark.createDataFrame(ODD, SCHEMA)
    found = {x.doc_id: x for x in op2.toxicity(frame, model).collect()}
    assert found[1].score == found[2].score == found[3].score < 0.5 and found[5].predicted == 0
    kept = op2.reject_toxic(frame.union(spark.createDataFrame([(9, "a vilewort vilewort", "x")], SCHEMA)), model)
    assert kept.columns == frame.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 7]
    assert op2.toxicity(frame.limit(0), model).count() == 0
    [(same, _)] = op2.score_texts(op2.fit(plain, [0] * 60), ["anything"])
    assert same == 0.0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert op2.train(frame, none).document is None
