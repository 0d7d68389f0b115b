"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The distinct shingles of five words of a text (fewer words: the whole sequence) are hashed once; the top bits of a
hash choose one of 256 bins, and each bin keeps its minimum. An empty bin takes the value of a filled one, found by
optimal densification: it follows its own random probes until it meets a filled bin, the same probes for every text.
After four probes the walk is finished by the filled bin of least random priority, which is where the probes would
have ended. The low four bits of each bin are packed into sixteen longs, printed as 256 hex digits.

Likeness of two fingerprints is the share of equal bins, corrected for the sixteenth of bins that agree by chance.
Agreement is counted on the packed longs: xor, fold each digit to its lowest bit, and count bits.

The next document in the order of ids is found without a global sort: ids are cut into ranges of about 4,096 rows each
at their approximate quantiles, whatever their values, each range is ordered by itself, and the first row of a range is
dealt to the range before it as well. There are at most a million ranges, cut in two levels of at most a thousand, so
the cuts and the first ids that are broadcast have a bound, and the text is shuffled once at any size.

Defined cases: texts of any length are one row's expression, in proportion to their words; a null or empty text, or one without words, has an empty fingerprint, likeness 1 to another such
text and 0 to any other; equal texts have equal fingerprints; a null id sorts first; rows that repeat an id are
ordered by text and are each other's neighbours, in one range however many; a single row is its own next document; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions.expressions import let, ranked_in
from routeloom.storage import materialize

BINS, BITS, PROBES = 256, 4, 4
_FREE = (1 << 56) - 1  # all ones below the bin number: marks an empty bin
_ONES = 0x1111111111111111


def words_of(text: Column) -> Column:
    """Runs of anything but space, tab and line ends, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _is_free(v: Column) -> Column:
    return v.bitwiseAND(F.lit(_FREE)) == _FREE


def _bin_minima(words: Column, width: int) -> Column:
    """The minimum of each bin, in bin order; an empty bin has its marker."""
    shingles = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (width - 1))), lambda i: F.xxhash64(F.slice(words, i, width))
    )
    markers = F.lit([((b << 56) | _FREE) - (1 << 64 if b >= 128 else 0) for b in range(BINS)])
    first = lambda hashes: F.filter(
        hashes, lambda h, i: (i == 0) | (F.shiftright(h, 56) != F.shiftright(F.get(hashes, i - 1), 56))
    )
    return let(F.sort_array(F.concat(shingles, markers)), first)


def _densified(minima: Column) -> Column:
    def fill(full: Column) -> Column:
        def filled(v: Column, b: Column) -> Column:
            probes = [F.get(minima, F.pmod(F.xxhash64(b, F.lit(j)), F.lit(BINS)).cast("int")) for j in range(PROBES)]
            last = F.array_min(
                F.transform(full, lambda f: F.struct(F.xxhash64(b, F.shiftright(f, 56), F.lit(PROBES)), f.alias("value")))
            )
            return F.when(~_is_free(v), v).otherwise(
                F.coalesce(*(let(p, lambda x: F.when(~_is_free(x), x)) for p in probes), last["value"])
            )

        return F.transform(minima, filled)

    return F.when(~F.exists(minima, _is_free), minima).otherwise(let(F.filter(minima, lambda v: ~_is_free(v)), fill))


def _packed(bins: Column) -> Column:
    def word(w: Column) -> Column:
        digits = (F.get(bins, w * 16 + k).bitwiseAND(F.lit(15).cast("long")) for k in range(16))
        total = None
        for k, d in enumerate(digits):
            d = F.shiftleft(d, k * BITS) if k else d
            total = d if total is None else total.bitwiseOR(d)
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(15)), word)


def signature(text: Column, width: int = 5) -> Column:
    """Sixteen longs, or an empty array for a text without words."""

    def of(words: Column) -> Column:
        packed = let(_bin_minima(words, width), lambda m: let(_densified(m), _packed))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(packed)

    return let(words_of(F.coalesce(text, F.lit(""))), of)


def fingerprint_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed signatures, 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(_ONES))).cast("int")

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (1 - unequal / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, signature`` of every whole text; a narrow pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), signature(F.col(text_col).cast("string")).alias("signature"))
    return rows.select("doc_id", fingerprint_text(F.col("signature")).alias("fingerprint"), "signature")


def _with_following(ranges: DataFrame) -> DataFrame:
    """``bucket, head, previous``: for each range the one before it; the first range follows the last.

    Ranges are numbered in groups of 4096, ordered within each; only one row for each group is ordered in one task.
    """
    groups = ranges.withColumn("grp", F.floor(F.col("bucket") / 4096))
    last = groups.groupBy("grp").agg(F.max("bucket").alias("last"))
    whole = Window.orderBy("grp")
    ends = last.select(
        "grp", F.lag("last").over(whole).alias("before"), F.max("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end")
    )
    inner = F.lag("bucket").over(Window.partitionBy("grp").orderBy("bucket"))
    return groups.withColumn("prior", inner).join(ends, "grp").select("bucket", "head", F.coalesce("prior", "before", "end").alias("previous"))


def _quantiles(column: str, parts: int) -> Column:
    """The ``parts - 1`` values that cut a column into parts of about equal numbers of rows."""
    return F.percentile_approx(column, [i / parts for i in range(1, parts)], F.lit(20_000))


def _ranges(ids: DataFrame, per_range: int, most: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the number of its id's range to each row, in the order of ids; null ids have -1.

    Ranges are cut at quantiles: up to ``most`` of them by one list, more by a list for each of ``most`` parts.
    """
    ranges = max(1, -(-ids.filter("doc_id is not null").count() // per_range))
    outer, inner = min(most, ranges), min(most, -(-ranges // most))
    first = ids.agg(_quantiles("doc_id", outer)).first()[0] if outer > 1 else []
    within = lambda cuts, x: ranked_in(cuts, lambda rank: rank(F.col(x)))
    part = within(F.lit(first or []).cast("array<bigint>"), "doc_id").alias("part")
    if inner > 1:
        cuts = ids.select("doc_id", part).groupBy("part").agg(_quantiles("doc_id", inner).alias("cuts"))
        cuts = materialize(cuts, "cuts")  # at most a thousand rows of a thousand numbers

    def numbered(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("part", part)
        if inner == 1:
            place = F.col("part").cast("long")
        else:
            rows = rows.join(F.broadcast(cuts), "part", "left")
            place = F.col("part") * F.lit(1 << 20) + within(F.col("cuts"), "doc_id")
        number = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place).cast("long")
        return rows.withColumn("bucket", number).drop("part", "cuts")

    return numbered


def with_next(rows: DataFrame, columns: list[str], per_range: int = 4096) -> DataFrame:
    """``rows`` (with ``doc_id`` and ``text``) and ``next``: a struct of ``columns`` of the following row."""
    ids = rows.select("doc_id")
    numbered = _ranges(ids, per_range)
    heads = numbered(ids).groupBy("bucket").agg(F.min("doc_id").alias("head"))
    heads = materialize(_with_following(heads).select(F.col("head").alias("__head"), F.col("previous").alias("__previous")), "heads")
    # one row for each range, a million at most
    dealt = numbered(rows).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("__head")), "left")
    own = F.struct(F.lit(0).alias("guest"), F.col("bucket"))
    guest = F.when(F.col("__previous").isNotNull(), F.struct(F.lit(1).alias("guest"), F.col("__previous").alias("bucket")))
    dealt = dealt.withColumn("__at", F.explode(F.array_compact(F.array(own, guest)))).select(*rows.columns, "__at.guest", "__at.bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("guest = 0").drop("guest", "bucket")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against itself with its last quarter replaced by the start of the next document, and against the next.

    ``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("text_sig", signature(F.col("text"))), ["text", "text_sig"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text_sig", F.col("next.text_sig").alias("next_sig"), edited.alias("edited_text"))
    rows = rows.withColumn("edited_text_sig", signature(F.col("edited_text")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_text",
        fingerprint_text(F.col("text_sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_text_sig")).alias("edited_fingerprint"),
        likeness(F.col("text_sig"), F.col("edited_text_sig")).alias("near_edited"),
        likeness(F.col("text_sig"), F.col("next_sig")).alias("near_next"),
    )
