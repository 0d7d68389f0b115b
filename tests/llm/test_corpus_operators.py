"""Fingerprints, decontamination, URL filters, line dedup, suffix dedup and near dedup against brute force."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import components, registry
from routeloom.llm import op04_fingerprints as op4
from routeloom.llm import op05_decontamination as op5
from routeloom.llm import op06_url_filters as op6
from routeloom.llm import op07_line_dedup as op7
from routeloom.llm import op08_suffix_dedup as op8
from routeloom.llm import op10_near_dedup as op10
from routeloom.llm.suffix_grouping import suffix_arrays
from routeloom.llm.wordhash import shingle_sets
from tests.compare import DATA, canonical, views

DOCS = "doc_id long, text string, source string, n_lines string"  # n_lines clashes with a result's column


def words(r, n, vocabulary=4000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def texts_of(spark, sf=DATA):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# fingerprints


def test_fingerprints_estimate_jaccard(spark):
    texts = texts_of(spark)
    ids = sorted(texts)
    found = {r.doc_id: r for r in registry.op4_fingerprints(spark, DATA).collect()}
    assert sorted(found) == ids
    errors = []
    for i, k in enumerate(ids):
        text, following = texts[k], texts[ids[(i + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert found[k].n_chars == len(text) and found[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(following)
        errors += [found[k].near_edited - len(a & b) / max(1, len(a | b)), found[k].near_next - len(a & c) / max(1, len(a | c))]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    by_text = {}
    for k in ids:
        assert by_text.setdefault(texts[k], found[k].fingerprint) == found[k].fingerprint


def test_fingerprints_of_short_texts_agree_with_their_sets(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        w = words(r, r.randint(1, 30))
        rows.append((2 * i, " ".join(w)))
        rows.append((2 * i + 1, " ".join(w[: max(1, len(w) - 2)])))
    sig = {x.doc_id: x.signature for x in op4.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    errors = []
    for i in range(60):
        a, b = shingles(text[2 * i]), shingles(text[2 * i + 1])
        differ = sum(bin(d | d >> 1 | d >> 2 | d >> 3).count("1") if False else sum((d >> 4 * k & 15) != 0 for k in range(16)) for d in ((x ^ y) & (1 << 64) - 1 for x, y in zip(sig[2 * i], sig[2 * i + 1], strict=True)))
        errors.append(max(0, (1 - differ / 256 - 1 / 16) * 16 / 15) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03


def test_fingerprint_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c", "s", "x"), (5, None, "s", "x"), (7, "", "s", "x"), (7, "p q r s t u v", "s", "x"), (900, "z " * 30_000, "s", "x")], DOCS)
    found = op4.edited_likeness(frame).collect()
    assert len(found) == 5 and {r.fingerprint for r in found if r.n_chars == 0} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    one = op4.edited_likeness(frame.filter("doc_id = 900")).first()
    assert one.near_next == 1.0 and one.n_chars == 60_000
    assert op4.edited_likeness(frame.limit(0)).count() == 0


def test_next_crosses_ranges(spark):
    ids = sorted(random.Random(6).sample(range(100_000), 3000))
    frame = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    found = {r.doc_id: r.next.text for r in op4.with_next(frame, ["text"], per_range=7).collect()}
    assert found == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


@pytest.mark.parametrize("outliers", [[1 << 50], [-(1 << 62), 1 << 62], [-(1 << 63), (1 << 63) - 1], []])
def test_ranges_hold_equal_numbers_of_rows_whatever_the_ids(spark, outliers):
    ids = sorted([*range(5_000, 25_000), *outliers])
    frame = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    for most in (1000, 8):  # one level of cuts, and two
        numbered = op4._ranges(frame.select("doc_id"), 512, most)(frame)
        sizes = [r["count"] for r in numbered.groupBy("bucket").count().collect()]
        assert len(sizes) >= 36 and max(sizes) <= 2 * 512
        by_id = [r.bucket for r in numbered.orderBy("doc_id").collect()]
        assert by_id == sorted(by_id)
    found = {r.doc_id: r.next.text for r in op4.with_next(frame, ["text"], per_range=512).collect()}
    assert found == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_fingerprints_equal_their_definition(spark):
    """Bins, densification and packing, recomputed from the shingle hashes of a text."""
    r = random.Random(16)
    texts = [" ".join(words(r, n)) for n in (1, 4, 5, 6, 12, 60, 400, 3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.fingerprint for x in op4.fingerprints(frame).collect()}
    for k, text in enumerate(texts):
        w = text.split()
        grams = [w[i : i + 5] for i in range(max(1, len(w) - 4))]
        hashed = spark.createDataFrame([(g,) for g in grams], "g array<string>").select(F.xxhash64("g").alias("h")).collect()
        minima: dict[int, int] = {}
        for x in hashed:  # the upper eight bits choose the bin, in signed order, which keeps the least hash
            b = (x.h >> 56) + 128
            minima[b] = min(minima.get(b, x.h), x.h)
        empty = [b for b in range(256) if b not in minima]
        probes = {
            x.b: list(x.p)
            for x in spark.createDataFrame([(b,) for b in empty] or [(0,)], "b int")
            .select("b", F.array(*(F.pmod(F.xxhash64("b", F.lit(j)), F.lit(256)).cast("int") for j in range(4))).alias("p"))
            .collect()
        }
        full = sorted(minima)
        pairs = [(b, f) for b in empty for f in full]
        last = {}
        for x in spark.createDataFrame(pairs or [(0, 0)], "b int, f long").withColumn("h", F.xxhash64("b", F.col("f") - 128, F.lit(4))).collect():
            last[x.b] = min(last.get(x.b, (x.h, x.f)), (x.h, x.f))
        bins = [minima[b] if b in minima else next((minima[p] for p in probes[b] if p in minima), minima.get(last[b][1]) if b in last else None) for b in range(256)]
        digits = ["0123456789ABCDEF"[v & 15] for v in bins]
        want = "".join("".join(reversed(digits[16 * i : 16 * i + 16])) for i in range(16))
        assert found[k] == want


# decontamination


def test_masks_are_lossless_for_two_substitutions():
    for errors in itertools.combinations(range(13), 2):
        assert any(
            all(o + k not in errors for k, bit in enumerate(mask) if bit == "1") for mask in op5.MASKS for o in range(13 - len(mask) + 1)
        )


def test_decontamination_finds_substituted_passages(spark):
    r = random.Random(7)
    items = [(i, " ".join(words(r, 40))) for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        w = words(r, r.randint(20, 200))
        if d % 4 == 0:
            src = items[d % 20][1].split()
            at = r.randrange(len(src) - 13)
            part = src[at : at + 13]
            for k in r.sample(range(13), d % 3):
                part[k] = "other"
            place = r.randrange(len(w))
            w[place:place] = part
            want.add((d, d % 20))
        docs.append((d, ", ".join(w).upper() if d % 8 == 0 else " ".join(w), "s", "x"))
    frame = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in op5.contaminated_pairs(frame, bench).collect()}
    assert found == want
    beyond = {(x.doc_id, x.item_id) for x in op5.contaminated_pairs(frame, bench, broadcast_seeds=0).collect()}
    assert beyond == want
    left = op5.decontaminate(frame, bench)
    assert left.columns == frame.columns and {x.doc_id for x in left.collect()} == {d for d in range(200)} - {d for d, _ in want}


@pytest.mark.parametrize("n", range(1, 13))
def test_masks_of_short_items_are_lossless(n):
    masks = op5.masks_of(n, 13, 0.8)
    assert all(len(m) == n for m in masks)
    k = n - -(-8 * n // 10) if n >= 8 else 0
    for errors in itertools.combinations(range(n), k):
        assert any(all(bit == "0" or i not in errors for i, bit in enumerate(m)) for m in masks)


def test_decontamination_of_items_of_every_length(spark):
    """Items of 1 to 16 words with as many substitutions as are allowed, and one more; also of a script without spaces."""
    r = random.Random(17)
    items, docs, want = [], [], set()
    for n in range(1, 17):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        w = min(n, 13)
        k = 0 if n < 8 else w - -(-8 * w // 10)
        for more in (0, 1):
            for trial in range(6):
                part = list(item[:w])
                for at in r.sample(range(w), min(w, k + more)):
                    part[at] = "other"
                docs.append((len(docs), " ".join([*words(r, trial), *part, *words(r, 3)]), "s", "x"))
                if not more:
                    want.add((docs[-1][0], n))
    items += [(50, "測試用的問題"), (51, "คำถาม")]
    docs += [(1000, "前文測試用的問題後文", "s", "x"), (1001, "測試用的", "s", "x"), (1002, "นี่คือคำถามนะ", "s", "x")]
    want |= {(1000, 50), (1002, 51)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in op5.contaminated_pairs(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert found == want


def test_decontamination_of_a_passage_in_a_thousand_items(spark):
    r = random.Random(18)
    passage = words(r, 20)
    bench = spark.createDataFrame([(i, " ".join([*words(r, 6), *passage, *words(r, 6)])) for i in range(1000)] + [(2000, "to be " * 400)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join([*words(r, 30), *passage, *words(r, 30)]), "s", "x") for i in range(30)] + [(99, "to be " * 3000, "s", "x")], DOCS)
    found = {x.doc_id: (x.n_items, x.overlap) for x in op5.contaminated_documents(docs, bench).collect()}
    assert found == {**{i: (1000, 13) for i in range(30)}, 99: (1, 13)}
    contexts, _, _ = op5.benchmark_contexts(bench.filter("item_id = 2000").select("item_id", op5.words_of(F.col("text")).alias("words")), 13, 0.8)
    assert contexts.count() <= 40  # of 793 places of the repetitive item
    assert op5.decontaminate(docs, bench).count() == 0


def test_decontamination_of_the_table_and_odd_rows(spark):
    texts = texts_of(spark)
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    whole = {d for d, t in texts.items() if any(i in t for i in items)}
    assert whole <= {r.doc_id for r in registry.op5_decontamination(spark, DATA).collect()}
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "a b c d e f g h"), (None, "q r s t u v w x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, "s", "x"), (2, "", "s", "x"), (3, "x a b c d e f g h y", "s", "x"), (3, "x a b c d e f g h y", "s", "x"), (None, "a b c d e f g h", "s", "x")], DOCS)
    assert {(r.doc_id, r.item_id) for r in op5.contaminated_pairs(docs, bench).collect()} == {(3, 4), (None, 4)}
    clash = docs.withColumnRenamed("source", "overlap").withColumnRenamed("n_lines", "seed").withColumn("at", F.lit(1)).withColumn("no", F.lit(2)).withColumn("words", F.lit(""))
    assert op5.decontaminate(clash, bench).columns == clash.columns and op5.decontaminate(clash, bench).count() == 2
    assert op5.contaminated_pairs(docs.limit(0), bench).count() == 0 and op5.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert op5.decontaminate(docs, bench).count() == 2


# URL filters


def _judge(url):
    host = path = ""
    if url and (m := re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)):
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules_and_hosts(spark):
    odd = ["http://A.Org/es/", "https://x.example.org/en/1?q", "ftp://com/fr/#f", "http://notcom/de/", "nourl", "", None, "http://example.org", "x://a.com/de/://b.org/", "http://ÄÖ.com/de/x"]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(odd)], "page_id long, url string, host string")
    for r in op6.url_filter(frame, registry.URL_RULES).collect():
        host, path, rule, verdict = _judge(odd[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
        assert r.verdict in ("allow", "block")
    assert op6.url_filter(frame.limit(0), registry.URL_RULES).count() == 0
    assert {r.verdict for r in op6.url_filter(frame, []).collect()} == {"allow"}


def test_mined_rules_decide_the_rest(spark):
    urls = [f"http://a{i}.example.com/{'de' if i % 2 else 'fr'}/p{i}" for i in range(200)] + [f"http://b{i}.example.net/{'de' if i % 2 else 'fr'}/p{i}" for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = op6.url_filter(frame, registry.URL_RULES).filter("rule is null").collect()
    assert len(found) == 20 and all(r.verdict == ("block" if r.page_id % 2 else "allow") and r.mined_confidence >= 0.8 for r in found)


def _mined(labelled, min_support, min_confidence):
    """Rules by plain counting of all itemsets: {(tokens, label): (confidence, support)} after pruning."""
    rules, total = {}, len(labelled)
    counts, hits = {}, {}
    for tokens, label in labelled:
        for k in range(1, len(tokens) + 1):
            for x in itertools.combinations(sorted(tokens), k):
                counts[x] = counts.get(x, 0) + 1
                hits[x, label] = hits.get((x, label), 0) + 1
    for (x, label), h in hits.items():
        if h >= min_support * total and h / counts[x] >= min_confidence:
            rules[x, label] = (h / counts[x], h / total)
    return {
        (x, label): v
        for (x, label), v in rules.items()
        if not any((y, label) in rules and rules[y, label][0] >= v[0] for k in range(1, len(x)) for y in itertools.combinations(x, k))
    }


def test_mined_rules_equal_plain_counting(spark):
    r = random.Random(20)
    for trial in range(3):
        labelled = []
        for _ in range(120):
            tokens = {t for t in "abcdefg" if r.random() < 0.5}
            odds = 0.95 if {"a", "b", "c"} <= tokens else 0.9 if {"d", "e"} <= tokens else 0.3
            labelled.append((sorted(tokens | ({"pure"} if r.random() < 0.1 * trial and odds > 0.8 else set())), "block" if r.random() < odds else "allow"))
        labelled = [(t, y) for t, y in labelled if t]
        frame = spark.createDataFrame(labelled, "tokens array<string>, label string")
        found = {(tuple(x.tokens), x.label): (round(x.confidence, 9), round(x.support, 9)) for x in op6.mine_rules(frame, "tokens", "label", 0.05, 0.8).collect()}
        assert found == {k: (round(c, 9), round(s, 9)) for k, (c, s) in _mined(labelled, 0.05, 0.8).items()}
        assert any(len(x) >= 2 for x, _ in found)


def test_mined_rules_of_many_tokens_equal_plain_counting(spark):
    """Eleven and twelve mixed tokens in a basket; exceptions that lack one token each need rules of all others."""
    every = [f"t{i:02d}" for i in range(11)]
    labelled = [(every, "block")] * 20 + [(every[:i] + every[i + 1 :], "allow") for i in range(11) for _ in range(2)]
    r = random.Random(21)
    noisy = [sorted(t for t in "abcdefghijkl" if r.random() < 0.6) for _ in range(60)]
    noisy = [(x, "block" if len(x) % 3 == 0 or {"k", "l"} <= set(x) else r.choice(["allow", "other"])) for x in noisy if x]
    for data in (labelled, noisy):
        frame = spark.createDataFrame(data, "tokens array<string>, label string")
        found = {(tuple(x.tokens), x.label): (round(x.confidence, 9), round(x.support, 9)) for x in op6.mine_rules(frame, "tokens", "label", 0.05, 0.8).collect()}
        assert found == {k: (round(c, 9), round(s, 9)) for k, (c, s) in _mined(data, 0.05, 0.8).items()}
        longest = max(len(x) for x, _ in found)
        assert longest == 11 if data is labelled else longest > 2


def test_mined_verdicts_of_the_table(spark):
    """The best of the rules that plain counting finds decides each URL that no explicit rule judges."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    url = F.col("url")
    sets = pages.select("page_id", op6.url_tokens(url, op6.host_of(url), op6.path_of(url)).alias("tokens")).collect()
    found = {x.page_id: x for x in op6.url_filter(pages, registry.URL_RULES).collect()}
    labelled = [(x.tokens, found[x.page_id].verdict) for x in sets if found[x.page_id].rule is not None and x.tokens]
    rules = _mined(labelled, 0.01, 0.8)
    for x in sets:
        if found[x.page_id].rule is None:
            fits = [(c, s, len(t), y) for (t, y), (c, s) in rules.items() if set(t) <= set(x.tokens)]
            assert found[x.page_id].verdict == (max(fits)[3] if fits else "allow")


def test_mining_of_deep_paths_is_bounded(spark):
    deep = ["/".join(f"s{k}" for k in range(30))] * 300
    urls = [f"http://a.com/{'de' if i % 3 == 0 else 'fr'}/{p}" for i, p in enumerate(deep)] + [f"http://b.net/x/{p}" for p in deep[:20]]
    began = time.perf_counter()
    found = op6.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), registry.URL_RULES).collect()
    assert len(found) == 320 and time.perf_counter() - began < 60


def test_url_query_over_the_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = registry.op6_url_filters(spark, DATA).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path, rule, verdict = _judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


# line dedup


def test_line_dedup_equals_sql(spark):
    found = registry.op7_line_dedup(spark, DATA).toPandas()
    wanted = views().sql(registry.ORACLES["op7_line_dedup"]).df()
    assert canonical(found).equals(canonical(wanted))


def test_line_dedup_odd_rows(spark):
    rows = [(i, f"menu\n\nbody {i}\n menu \nmenu", None if i % 2 else "a", "x") for i in range(20)]
    rows += [(None, "menu\nz", "a", "x"), (50, None, "a", "x"), (51, "", "a", "x"), (52, "menu", "small", "x"), (0, "menu\n\nbody 0\n menu \nmenu", "a", "x")]
    frame = spark.createDataFrame(rows, DOCS)
    found = op7.line_dedup(frame)
    assert found.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows) and by_id[1].text == "\nbody 1" and by_id[2].text == "\nbody 2" and by_id[2].n_dropped == 3
    assert (by_id[50].text, by_id[50].n_lines) == (None, 0) and by_id[51].text == "" and by_id[52].text == "menu" and by_id[None].text == "z"
    assert op7.line_dedup(frame.limit(0)).count() == 0


def test_line_dedup_of_a_long_list_of_boilerplate(spark):
    menu = [f"entry {i}" for i in range(3000)]
    rows = [(i, "\n".join([*menu[i * 7 % 100 :], f"own {i}", "entry -1"]), "site", "x") for i in range(12)]
    found = {r.doc_id: r.text for r in op7.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    holders = {m: sum(m in r[1].split("\n") for r in rows) for m in [*menu, "entry -1"]}
    for i, text, _, _ in rows:
        assert found[i] == "\n".join(x for x in text.split("\n") if holders.get(x, 1) < 4)


# suffix dedup


def test_suffix_arrays_equal_sorting():
    r = random.Random(8)
    for trial in range(150):
        strings = [[r.randint(1, r.choice([1, 2, 4, 200])) for _ in range(r.randint(0, 40))] + [0] for _ in range(r.randint(1, 6))]
        strings += [([1, 2] * 20)[: r.randint(1, 40)] + [0]] * (trial % 3 == 0)
        starts = np.cumsum([0, *map(len, strings)])
        out = suffix_arrays(np.array(sum(strings, [])), starts)
        for i, s in enumerate(strings):
            assert (out[starts[i] : starts[i + 1]] - starts[i]).tolist() == sorted(range(len(s)), key=lambda k, s=s: s[k:])


def _cut(rows, length=100):
    seen, out = set(), {}
    for k, raw in rows:
        covered = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w in seen:
                covered[j : j + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, v in zip(raw, covered, strict=True) if not v)
        out[k] = (len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_of_the_table(spark):
    want = _cut([(k, t.encode()) for k, t in sorted(texts_of(spark).items())])
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op8_suffix_dedup(spark, DATA).collect()}
    assert found == want


@pytest.mark.parametrize("leaf", [200, 3])
def test_suffix_dedup_of_planted_overlaps(spark, leaf):
    r = random.Random(9)
    passage = " ".join(words(r, 60))
    rows = []
    for i in range(60):
        text = " ".join(words(r, r.randint(5, 120)))
        if i % 3 == 0:
            cut = r.randrange(len(passage) // 2)
            text = text[: len(text) // 2] + passage[cut : cut + r.randint(60, 250)] + text[len(text) // 2 :]
        if i % 7 == 0:
            text += "ab" * r.randint(10, 200) + text[:150]
        rows.append((i, text))
    rows += [(100, rows[4][1]), (101, rows[4][1][3:]), (102, None), (103, ""), (104, "é" * 120), (105, "é" * 130)]
    frame = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS).repartition(5)
    want = _cut([(i, (t or "").encode()) for i, t in rows])
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in op8.suffix_dedup(frame, leaf=leaf).collect()}
    assert found == want


def test_suffix_dedup_of_a_shared_edge_with_many_contexts(spark):
    """One passage amid other words in every text: its edges have far more different contexts than a leaf."""
    r = random.Random(19)
    passage = " ".join(words(r, 50))
    rows = []
    for i in range(400):
        before, after = " ".join(words(r, 9)), " ".join(words(r, 9))
        rows.append((i, f"{before} {passage} {after}" if i % 5 else f"{before} {passage[: r.randrange(100, 300)]} {after}"))
    frame = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS).repartition(5)
    want = _cut([(i, t.encode()) for i, t in rows])
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in op8.suffix_dedup(frame).collect()}
    assert found == want


def test_suffix_dedup_of_texts_above_sixteen_megabytes(spark):
    """A 20 MB text of random letters with planted copies: within it, across the edges of its pieces, and in other texts."""
    g = np.random.default_rng(5)
    big = bytearray(g.integers(97, 123, 20_000_000, dtype=np.uint8).tobytes())
    small = bytearray(g.integers(97, 123, 3_000, dtype=np.uint8).tobytes())
    for source, target, n in [(100, 999_950, 260), (999_900, 5_000_000, 400), (7_000_001, 19_999_700, 300)]:
        big[target : target + n] = big[source : source + n]
        for k in (-1, n):  # what surrounds a copy differs from what surrounds its source
            if target + k < len(big):
                big[target + k] = 48 + (source + k) % 10
    small[1000:1500] = big[15_999_800:16_000_300]
    small[999], small[1500] = 33, 33
    frame = spark.createDataFrame([(1, big.decode(), "s", "x"), (2, small.decode(), "s", "x"), (3, "é" * 300_000, "s", "x")], DOCS)
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in op8.suffix_dedup(frame).collect()}
    kept = bytes(big[:999_950] + big[1_000_210:5_000_000] + big[5_000_400:19_999_700])
    assert found[1] == (20_000_000, 960, 3, hashlib.sha256(kept).hexdigest())
    assert found[2] == (3_000, 500, 1, hashlib.sha256(bytes(small[:1000] + small[1500:])).hexdigest())
    assert found[3] == (600_000, 599_998, 1, hashlib.sha256("é".encode()).hexdigest())


def test_suffix_dedup_odd_rows(spark):
    long = "q" * 150
    frame = spark.createDataFrame([(None, long, "s", "x"), (1, long, "s", "x"), (2, "short", "s", "x"), (2, "short", "s", "x"), (3, long + "a", "s", "x"), (3, long + "b", "s", "x")], DOCS)
    found = op8.suffix_dedup(frame).collect()
    assert sorted((x.doc_id or -1, x.n_bytes) for x in found) == [(-1, 150), (1, 150), (2, 5), (2, 5), (3, 151), (3, 151)]
    assert {x.doc_id: x.n_removed for x in found}[1] == 150
    assert op8.suffix_dedup(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op8.suffix_dedup(frame, length=10)


# near dedup


def _classes(texts, percent):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_dedup_of_the_table(spark):
    want = _classes(texts_of(spark), 85)
    found = registry.op10_near_dedup(spark, DATA).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_dedup_of_a_large_group(spark):
    r = random.Random(10)
    base = words(r, 80)
    texts = {}
    for i in range(250):
        w = list(base)
        for k in r.sample(range(80), r.randint(0, 4)):
            w[k] = f"x{r.randrange(9999)}"
        texts[i] = " ".join(w)
    for i in range(250, 400):
        texts[i] = " ".join(words(r, 60))
    frame = spark.createDataFrame([(i, t, "s", "x") for i, t in texts.items()], DOCS)
    for leaf in (1000, 40):  # compared at the roots, and branched
        found = op10.similarity_classes(frame, 85, leaf=leaf)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in found.collect()} == _classes(texts, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_of_threshold_pairs_in_branched_roots(spark, percent):
    """Documents that share most of a text, each too far from all others but its partner, which is at the threshold."""
    r = random.Random(12)
    base, texts = words(r, 400), {}
    own = {80: 43, 85: 31}[percent]  # words that only the document has, at the end
    for i in range(0, 100, 2):
        pair = words(r, 30)
        for k in (i, i + 1):
            texts[k] = " ".join(base[: 370 - own] + pair + [f"{k}x{j}" for j in range(own)])
    sets = {k: shingles(t) for k, t in texts.items()}
    for a, b in itertools.combinations(sets, 2):
        assert (100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])) == (a // 2 == b // 2)
    want = {k: (len(x), k - k % 2) for k, x in sets.items()}
    frame = spark.createDataFrame([(i, t, "s", "x") for i, t in texts.items()], DOCS)
    found = op10.similarity_classes(frame, percent, leaf=10, branching=1.0)  # one child a node: branching alone loses many pairs
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found.collect()} == want


def test_near_dedup_of_repeated_ids_with_different_texts(spark):
    r = random.Random(13)
    a, b, c = words(r, 120), words(r, 130), words(r, 90)
    changed = lambda w, k: " ".join(["changed" if i == k else x for i, x in enumerate(w)])
    rows = [(3, " ".join(a)), (3, " ".join(b)), (5, changed(b, 2)), (2, changed(a, 60)), (7, " ".join(b)), (9, " ".join(c)), (9, changed(c, 1)), (9, "else where")]
    frame = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS)
    found = op10.similarity_classes(frame)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == [
        (2, 116, 2), (3, 116, 2), (3, 126, 3), (5, 126, 3), (7, 126, 3), (9, 1, 9), (9, 86, 9), (9, 86, 9),
    ]
    assert sorted(x.doc_id for x in op10.near_dedup(frame).collect()) == [2, 3, 3, 9, 9, 9]


def test_near_dedup_joins_a_large_group_by_its_pivot(spark, monkeypatch):
    """Branching sees few rows of a group of near copies, however large it is beside a leaf."""
    r = random.Random(14)
    base, rows = words(r, 100), []
    for i in range(3000):
        w = list(base)
        for k in r.sample(range(100), r.randint(0, 1)):
            w[k] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w), "s", "x"))
    seen, children = [], op10._children
    monkeypatch.setattr(op10, "_children", lambda members, *a: seen.append(members.count()) or children(members, *a))
    found = op10.similarity_classes(spark.createDataFrame(rows, DOCS), 85, leaf=100)
    assert {x.component_id for x in found.collect()} == {0}
    assert sum(seen) <= 3000


def test_near_dedup_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "A b c d e f"), (None, "a b c d e f"), (8, "\u00a0x"), (9, "w " * 50_000)]
    frame = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS)
    found = op10.similarity_classes(frame).collect()
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in found}
    assert len(found) == len(rows)
    assert got >= {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 6), (None, 2, None), (8, 1, 8), (9, 1, 9)}
    kept = op10.near_dedup(frame)
    assert kept.columns == frame.columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 6, None, 8, 9]))
    assert op10.similarity_classes(frame.limit(0)).count() == 0


def test_near_dedup_of_an_id_with_and_without_text(spark):
    r = random.Random(15)
    a = words(r, 120)
    near = " ".join([*a[:60], "changed", *a[61:]])
    for first, second in ((None, " ".join(a)), (" ".join(a), "")):
        rows = [(3, first, "s", "x"), (3, second, "s", "x"), (5, near, "s", "x")]
        found = op10.similarity_classes(spark.createDataFrame(rows, DOCS))
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == [(3, 0, 3), (3, 116, 3), (5, 116, 3)]


def test_near_dedup_writes_few_tables_for_few_links(spark, monkeypatch):
    """Each written table is a shuffle over all partitions, which is what a small input with many partitions costs."""
    r = random.Random(16)
    base, rows = words(r, 100), []
    for i in range(400):
        w = list(base)
        w[r.randrange(100)] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w), "s", "x"))
    written, materialize = [], op10.materialize
    note = lambda df, name, *a: written.append(name) or materialize(df, name, *a)
    monkeypatch.setattr(op10, "materialize", note)
    monkeypatch.setattr(components, "materialize", note)
    found = op10.similarity_classes(spark.createDataFrame(rows, DOCS), 85, leaf=100)
    assert {x.component_id for x in found.collect()} == {0}
    assert len(written) <= 30 and written.count("stars") == written.count("components"), written


def test_shingle_sets_count_as_words_do():
    r = random.Random(11)
    texts = ["".join(r.choice("aAb \t\nÉ\u00a0字") for _ in range(r.randint(0, 60))) for _ in range(400)] + [None, ""]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (200, 200), (300, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[300] == 0 and found[102] == 100 and 200 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_links_in_many_parts(spark):
    r = random.Random(17)
    edges = [(i, i + 1) for i in range(300)] + [(r.randrange(1000, 3000), r.randrange(1000, 3000)) for _ in range(1500)] + [(4000, 4000), (None, 7)]
    r.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(8)
    whole = {x.node: x.component for x in components.components(frame).collect()}
    assert all(whole[i] == 0 for i in range(301)) and 4000 not in whole
    for part in (100, 700):
        found = components.components(frame, part=part).collect()
        assert len(found) == len(whole) and {x.node: x.component for x in found} == whole
