"""URL filtering by host and path rules, and by association rules between URL tokens and labels.

Explicit rules come first: a rule fits its host and all subdomains when the path starts with the rule's path, and the
longest fitting rule wins. Labelled URLs (here those that a rule judges) are turned into token sets, FP-growth mines
combinations of tokens together with the label, and rules below the support or confidence bound are pruned, as is
every rule that a more general one makes redundant. Mined rules are kept in an inverted index under their rarest
token; a URL looks up its tokens, and a rule holds when its whole antecedent is among them. Matching runs once for
each distinct token set, so a site with a third of all pages costs no more than its distinct sets.

Mining has two rounds. The first mines single tokens: baskets are pairs of a token and the label. A token that decides
the label by itself, with confidence 1, makes every combination with it redundant and goes into none. The second mines
combinations of the other frequent tokens, of any length and from all of them, by FP-growth sharded by token: every
token gets its conditional baskets, the tokens before it in the order of the baskets, and patterns grow inside them.
Nothing is cut: a pattern is only given up for a label when a part of it has as few rows of other labels, because the
part is then a rule at least as confident for every pattern above it. So tokens that always come together cost no more
than one of them. What remains is inherent: tokens of which every subset has exceptions of its own, at the support
bound, are as many patterns as they have subsets; and the distinct conditional baskets of a token are one task's.

Defined cases: a URL of any length or number of segments is judged whole; a null URL, or one without ``://``, has empty host and path, no rule and no tokens, and the default
verdict; no labelled URL, or no surviving rule, gives the default verdict; ties between mined rules go to higher
confidence, then support, then longer antecedent, then block; repeated rows are judged each for itself; only the
named columns are read. Rule paths start with ``/``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.storage import materialize

#: verdict, host, path of each explicit rule.
Rule = tuple[str, str, str]

#: Tokens of a rule up to which its subsets are enumerated to find more general rules.
_LOOKED_UP = 10

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The name of the longest rule that fits, host and path joined; null if none does."""
    chosen = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.lit(h + p)).otherwise(chosen)
    return chosen


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host suffixes and first label, path segments by place, query keys, fragment.

    Digits are replaced by ``0``, so that ids of pages do not become tokens of their own.
    """
    flat = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    labels = F.split(flat(host), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    parts = F.filter(F.split(flat(path), "/"), lambda s: s != "")
    segments = F.transform(parts, lambda s, i: F.concat(F.lit("seg"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), s))
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(flat(query), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key:"), F.substring_index(s, "=", 1))
    )
    other = F.array_compact(
        F.array(
            F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))),
            F.when(F.instr(url, "#") > 0, F.lit("fragment")),
            F.when(path.endswith("/"), F.lit("slash")),
        )
    )
    known = F.when(host != "", F.array_sort(F.array_distinct(F.concat(suffixes, segments, keys, other))))
    return F.coalesce(known, F.array().cast("array<string>"))


def _label_rules(baskets: DataFrame, min_count: int, of: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Label rules ``tokens, label, confidence, support`` and frequent itemsets of baskets ``items``; support is of ``of`` rows."""
    n = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_count - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    to_label = F.element_at("consequent", 1)
    rules = model.associationRules.filter(to_label.startswith("label=")).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(to_label, 7, 1 << 20).alias("label"),
        "confidence",
        (F.col("support") * n / of).alias("support"),
    )
    return rules, model.freqItemsets


def _grown(table: pa.Table, least: int, of: int, min_confidence: float) -> pa.Table:
    """The rules of two tokens and more that hold token ``t``, of its conditional baskets ``t, prefix, label, n``.

    Rows of ``prefix`` are weighted by ``n``. Rules with a more general one that holds ``t`` are left out.
    """
    prefix, labels = table["prefix"].combine_chunks(), table["label"].combine_chunks().dictionary_encode()
    names = prefix.flatten().dictionary_encode()
    token, at = names.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(prefix)), prefix.value_lengths().to_numpy(zero_copy_only=False))
    weight = np.zeros((len(prefix), len(labels.dictionary)))
    weight[np.arange(len(prefix)), labels.indices.to_numpy(zero_copy_only=False)] = table["n"].to_numpy()
    alone = [np.bincount(token, weights=w[at], minlength=len(names.dictionary)) for w in weight.T]
    useful = np.flatnonzero(np.max(alone, axis=0) >= least)
    place = np.full(len(names.dictionary), -1)
    place[useful] = np.arange(len(useful))
    held = np.zeros((len(prefix), len(useful)), dtype=bool)
    held[at[place[token] >= 0], place[token][place[token] >= 0]] = True
    found: list[tuple[tuple[int, ...], int, float, float]] = []

    def surest(hits: np.ndarray) -> np.ndarray:
        share = hits / hits.sum()
        return np.where((hits >= least) & (share >= min_confidence), share, -1.0)

    total = weight.sum(axis=0)
    errors = total.sum() - total
    #: by pattern: labels for which it may grow, rows of other labels, and the surest rule that is a part of it
    grown = {(): ((total >= least) & (errors > 0), errors, surest(total))}

    def grow(pattern: tuple[int, ...], rows: np.ndarray) -> None:
        below = pattern[0] if pattern else len(useful)
        counts = np.zeros((weight.shape[1], below))
        for i in range(0, len(rows), 1 << 15):
            part = rows[i : i + (1 << 15)]
            counts += weight[part].T @ held[part, :below].astype(np.float64)
        for s in np.flatnonzero((grown[pattern][0][:, None] & (counts >= least)).any(axis=0)).tolist():
            hits, longer = counts[:, s], (s, *pattern)
            fewer, open_, best = hits.sum() - hits, hits >= least, np.full(len(hits), -1.0)
            for i in range(len(longer)):  # smaller tokens first: the parts have been seen
                part = grown.get(longer[:i] + longer[i + 1 :])
                if part is None:
                    open_[:] = False
                    break
                open_ &= part[0] & (fewer < part[1])
                best = np.maximum(best, part[2])
            if not open_.any():
                continue
            own = np.where(open_, surest(hits), -1.0)
            found.extend((longer, int(y), own[y], hits[y] / of) for y in np.flatnonzero(own > best))
            open_ &= fewer > 0
            if open_.any():
                grown[longer] = (open_, fewer, np.maximum(best, own))
                grow(longer, rows[held[rows, s]])

    if grown[()][0].any():
        grow((), np.arange(len(prefix)))
    first, name, kind = table["t"][0].as_py(), names.dictionary.to_pylist(), labels.dictionary.to_pylist()
    return pa.table(
        {
            "tokens": pa.array([sorted([first, *(name[useful[s]] for s in x)]) for x, *_ in found], pa.list_(pa.string())),
            "label": pa.array([kind[y] for _, y, *_ in found], pa.string()),
            "confidence": pa.array([c for *_, c, _ in found], pa.float64()),
            "support": pa.array([c for *_, c in found], pa.float64()),
        }
    )


def mine_rules(labelled: DataFrame, tokens_col: str, label_col: str, min_support: float, min_confidence: float) -> DataFrame:
    """``rule_id, tokens, label, confidence, support`` of the rules that survive pruning.

    FP-growth needs each item once per basket; the label is an item of its own kind. A rule is dropped when another
    of the same label with fewer tokens, all of them its own, is at least as confident.
    """
    label = F.concat(F.lit("label="), F.col(label_col)).alias("label")
    rows = materialize(labelled.select(F.array_distinct(tokens_col).alias("tokens"), label), "labelled-urls")
    n = max(1, rows.count())
    least = max(1, math.ceil(min_support * n))
    pairs = rows.select("label", F.explode("tokens").alias("t")).select(F.array("t", "label").alias("items"))
    singles, itemsets = _label_rules(pairs, least, n, min_confidence)
    singles = materialize(singles, "single-rules")
    token = F.get(F.filter("items", lambda x: ~x.startswith("label=")), F.lit(0))
    itemsets = itemsets.select(token.alias("t"), F.size("items").alias("k"), "freq").filter("t is not null")
    both, frequent = itemsets.filter("k = 2"), itemsets.filter("k = 1").select("t", F.col("freq").alias("total"))
    # a token that no label has often enough is in no rule
    surest = frequent.join(both.groupBy("t").agg(F.max("freq").alias("surest")), "t")
    mixed = surest.filter("surest < total").select("t", F.struct((-F.col("total")).alias("b"), F.col("t").alias("t")).alias("place"))
    mixed = materialize(mixed, "mixed-tokens")
    held = rows.select(F.xxhash64("tokens").alias("set_id"), "tokens").groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    held = held.select("set_id", F.explode("tokens").alias("t")).join(mixed, "t").groupBy("set_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    held = materialize(held.select("set_id", F.col("places.t").alias("kept")), "mixed-sets")
    baskets = rows.withColumn("set_id", F.xxhash64("tokens")).groupBy("set_id", "label").agg(F.count(F.lit(1)).alias("n")).join(held, "set_id")
    baskets = materialize(baskets.groupBy("kept", "label").agg(F.sum("n").alias("n")), "baskets")
    parts = baskets.select("kept", F.substring("label", 7, 1 << 20).alias("label"), "n", F.posexplode("kept").alias("i", "t"))
    parts = parts.select("t", F.slice("kept", F.lit(1), F.col("i")).alias("prefix"), "label", "n").groupBy("t", "prefix", "label").agg(F.sum("n").alias("n"))
    kinds = "tokens array<string>, label string, confidence double, support double"
    several = parts.groupBy("t").applyInArrow(lambda t: _grown(t, least, n, min_confidence), kinds)
    named = materialize(singles.unionByName(several).withColumn("rule_id", F.xxhash64("tokens", "label")), "rules")
    # short rules look every proper subset up by key, so that no rule meets all others; long ones the rules inside them
    size = F.size("tokens")
    subset = lambda bits: F.filter("tokens", lambda t, i: F.floor(bits / F.pow(F.lit(2), i)) % 2 == 1)
    chosen = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 2), subset)
    smaller = named.filter((size > 1) & (size <= _LOOKED_UP)).select("rule_id", "label", "confidence", F.explode(chosen).alias("tokens"))
    general = named.select("tokens", "label", F.col("confidence").alias("general_confidence"))
    redundant = smaller.join(general, ["tokens", "label"]).filter("general_confidence >= confidence").select("rule_id")
    longer = named.filter(size > _LOOKED_UP).select("rule_id", "label", "confidence", F.col("tokens").alias("own"), F.explode("tokens").alias("t"))
    inside = F.size(F.array_except("tokens", "own")) == 0
    within = longer.join(general.withColumn("t", F.col("tokens")[0]), ["t", "label"])
    within = within.filter((F.col("general_confidence") >= F.col("confidence")) & (size < F.size("own")) & inside).select("rule_id")
    return named.join(redundant.union(within).distinct(), "rule_id", "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``set_id, label, confidence``: the best mined rule for each token set that has one.

    The inverted index holds every rule once, under the token of its antecedent that the fewest token sets hold.
    """
    postings = token_sets.select("set_id", F.col(tokens_col).alias("own"), F.explode(tokens_col).alias("token"))
    spread = postings.groupBy("token").agg(F.count(F.lit(1)).alias("holders"))
    exploded = rules.select("rule_id", "tokens", "label", "confidence", "support", F.explode("tokens").alias("token"))
    index = (
        exploded.join(spread, "token")
        .groupBy("rule_id")
        .agg(
            F.min(F.struct("holders", "token"))["token"].alias("token"),
            *(F.first(c).alias(c) for c in ("tokens", "label", "confidence", "support")),
        )
    )
    hits = postings.join(index, "token").filter(F.size(F.array_except("tokens", "own")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("tokens").alias("n"), "label"))
    return hits.groupBy("set_id").agg(best.alias("best")).select("set_id", F.col("best.label").alias("label"), F.col("best.confidence").alias("confidence"))


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    default: str = "allow",
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_confidence``: the rule's verdict, else a mined rule's, else the default."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    verdicts = F.create_map(*(F.lit(x) for v, h, p in rules for x in (h + p, v))) if rules else None
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("judged", verdicts[F.col("rule")] if rules else F.lit(None).cast("string"))
    rows = rows.withColumn("tokens", url_tokens(url, F.col("host"), F.col("path")))
    rows = materialize(rows.withColumn("set_id", F.xxhash64("tokens")).drop("url"), "url-tokens")

    learned = mine_rules(rows.filter(F.col("judged").isNotNull() & (F.size("tokens") > 0)), "tokens", "judged", min_support, min_confidence)
    learned = materialize(learned, "url-rules")
    open_sets = rows.filter(F.col("judged").isNull()).groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    matched = materialize(match_rules(open_sets, learned), "url-matches")
    joined = rows.join(matched, "set_id", "left")
    mined = F.col("judged").isNull() & F.col("label").isNotNull()
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("judged", "label", F.lit(default)).alias("verdict"),
        F.when(mined, F.col("confidence")).alias("mined_confidence"),
    )
