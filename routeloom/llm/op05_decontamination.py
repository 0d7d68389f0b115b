"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive words; the hash of the words under its ones ignores the others. Training
texts and benchmark items that agree on a seed are aligned there, and the overlap around the hit is verified word by
word: a window of ``window`` words that includes the seed must agree in ``ceil(share * window)`` places. An item
shorter than the window is verified over its whole length, which must lie within the text.

The two masks of weight 6 and span 8 are lossless for the defaults: each of the 78 ways to substitute up to two words
in thirteen leaves one of them untouched somewhere in the window. Items of 8 to 12 words, of which a fifth may differ,
have masks of their own length: the item is cut into blocks, and each mask leaves out as many blocks as words may
differ, so one of them is untouched. Items of fewer than 8 words must be found as they are, by one mask of ones. Texts
are probed for the lengths that the benchmark has. All of it is enumerated in the tests.

Words are runs of letters and digits in lower case; of scripts that are written without spaces each character is a
word. The seeds of all positions are generated and probed in one pass over the texts: when the benchmark's seed table
is within ``broadcast_seeds`` rows of two numbers it is broadcast, and no text is shuffled; beyond that, seeds are
joined by hash on narrow rows, and only texts with a hit are joined again for verification.

What is verified around a hit is the seed's context, the words of an item that a window around it can reach. Equal
contexts, of one repetitive item or of a thousand items with a passage in common, are one row with one number, so a hit
is verified once for each different context, and a text that repeats itself meets as many rows as it has places. Items
come back only for what was found, and not at all where documents alone are asked for.

Defined cases: null or empty texts and items match nothing; repeated document rows of one id count as one document;
rows with a null id are reported under the null id; texts of any length are probed whole; only the named columns are
read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.expressions import let
from routeloom.storage import broadcast_if_small, materialize

#: Spaced seeds: fixed values, lossless for two substitutions in thirteen words.
MASKS = ("11101011", "11001111")
_SPAN = 8
#: Blocks of scripts without spaces, as ranges of a character class: Thai, Lao, Myanmar, Khmer, kana, Han. Fixed values.
UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), rf"([{UNSPACED}])", " $1 "), r"[^\p{L}\p{N}]+"), "")


def masks_of(n: int, window: int, share: float) -> tuple[str, ...]:
    """The masks by which an item of n words is found."""
    if n >= window:
        return MASKS
    may_differ = n - math.ceil(share * n)
    if n < _SPAN or not may_differ:
        return ("1" * n,)
    blocks = may_differ + 3
    block = [next(b for b in range(blocks) if i < (b + 1) * n // blocks) for i in range(n)]
    return tuple("".join("0" if b in out else "1" for b in block) for out in itertools.combinations(range(blocks), may_differ))


def _seeds(words: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """The masks' hashes of the words from ``at`` (0-based) on; null where a mask does not fit."""
    hashed = lambda mask: F.xxhash64(F.lit(mask), *(F.get(words, at + k) for k, bit in enumerate(mask) if bit == "1"))
    return F.array(*(F.when(at + len(mask) <= F.size(words), hashed(mask)) for mask in masks))


def _reached(words: Column, at: Column, window: int) -> Column:
    """The words that a window around a seed at ``at`` can reach, and the place of the seed among them."""
    start = F.greatest(F.lit(0), at - (window - _SPAN))
    return F.struct(F.slice(words, start + 1, F.lit(2 * window - _SPAN)).alias("words"), (at - start).alias("at"))


def benchmark_contexts(items: DataFrame, window: int, share: float) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Contexts ``no, ctx, width, span, seeds``, what items they are of ``no, item_id``, and all masks in use.

    ``items(item_id, words)``.
    """
    n = F.size("words")
    lengths = items.select(F.least(n, F.lit(window)).alias("n")).filter("n > 0").distinct().collect()  # window rows at most
    lengths = sorted(r["n"] for r in lengths) or [window]
    places = []
    for length in lengths:
        long, masks = length == window, masks_of(length, window, share)
        own = items.filter(n >= window if long else n == length)
        at = F.explode(F.sequence(F.lit(0), n - _SPAN)) if long else F.lit(0)
        own = own.select("item_id", "words", at.alias("at"))
        kind = [F.lit(length).alias("width"), F.lit(_SPAN if long else length).alias("span")]
        seeds = _seeds(F.col("words"), F.col("at"), masks)
        places.append(own.select("item_id", _reached(F.col("words"), F.col("at"), window).alias("ctx"), *kind, seeds.alias("seeds")))
    rows, key = materialize(reduce(DataFrame.union, places), "item-places"), ["ctx", "width", "span"]
    contexts = rows.groupBy(*key).agg(F.first("seeds").alias("seeds"))
    contexts = materialize(contexts.select(F.monotonically_increasing_id().alias("no"), *key, "seeds"), "contexts")
    members = materialize(rows.join(contexts, key).select("no", "item_id").distinct(), "context-items")
    return contexts, members, tuple(dict.fromkeys(m for length in lengths for m in masks_of(length, window, share)))


def _positions(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """``doc_id, words, at, seed``: a row for each place and mask of each text."""
    starts = F.size("words") - min(map(len, masks))
    at = rows.select("doc_id", "words", F.explode(F.when(starts >= 0, F.sequence(F.lit(0), starts))).alias("at"))  # null: no rows
    return at.select("doc_id", "words", "at", F.explode(_seeds(F.col("words"), F.col("at"), masks)).alias("seed"))


def _agreeing(share: float) -> Column:
    """Most agreeing words of any window that includes the seed, 0 if none reaches its share."""
    width, at = F.col("width"), F.col("ctx.at")
    low = F.greatest(F.lit(0), at + F.col("span") - width)
    high = F.least(F.size("ctx.words"), at + width)  # exclusive
    shift = F.col("hit.at") - at

    def same(k: Column) -> Column:
        return F.when((k + shift >= 0) & (F.get("hit.words", k + shift) == F.get("ctx.words", k)), 1).otherwise(0)

    def most(flags: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(flags) - width + 1))
        total = lambda s: F.aggregate(F.slice(flags, s, width), F.lit(0), lambda a, x: a + x)
        return F.array_max(F.transform(starts, total))

    best = let(F.transform(F.sequence(low, high - 1), same), most)
    return let(best, lambda b: F.when(b >= F.ceil(width * F.lit(share)), b).otherwise(0))


def _found_contexts(
    docs: DataFrame, benchmark: DataFrame, window: int, share: float, broadcast_seeds: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, no, overlap`` of the contexts that are verified in each document; and ``no, item_id``."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col).cast("string")).alias("words"))
    contexts, members, masks = benchmark_contexts(materialize(items, "items"), window, share)
    seeds = materialize(contexts.select(F.explode("seeds").alias("seed"), "no").filter("seed is not null").distinct(), "seeds")
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    if seeds.count() <= broadcast_seeds:
        hits = _positions(rows, masks).join(F.broadcast(seeds), "seed")
    else:
        near = _positions(rows, masks).select("doc_id", "at", "seed").join(seeds, "seed")
        places = near.select("doc_id", "no", "at").distinct()
        hits = places.join(rows, places["doc_id"].eqNullSafe(rows["doc_id"])).drop(rows["doc_id"])
    # the generator keeps the verification out of the probing loop: that loop compiles to one pass over the words, and
    # only the few words around a hit leave it
    hits = hits.select("doc_id", "no", F.explode(F.array(_reached(F.col("words"), F.col("at"), window))).alias("hit"))
    hits = hits.join(contexts.drop("seeds"), "no")
    found = hits.select("doc_id", "no", _agreeing(share).alias("overlap")).filter("overlap > 0")
    return found.groupBy("doc_id", "no").agg(F.max("overlap").alias("overlap")), members


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: float = 0.8,
    broadcast_seeds: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, overlap``: verified pairs, with the most agreeing words of a window."""
    found, members = _found_contexts(docs, benchmark, window, share, broadcast_seeds, id_col, text_col, item_col, item_text_col)
    return found.join(members, "no").groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_items, item_ids, overlap``: one row for each document that holds benchmark text."""
    pairs = contaminated_pairs(docs, benchmark, **options)
    return pairs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("overlap").alias("overlap")
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: float = 0.8,
    broadcast_seeds: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows whose id holds benchmark text; all columns pass through."""
    found, _ = _found_contexts(docs, benchmark, window, share, broadcast_seeds, id_col, text_col, item_col, item_text_col)
    bad = materialize(found.select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(broadcast_if_small(bad), F.col(f"`{id_col}`").eqNullSafe(F.col("__bad")), "left_anti")
