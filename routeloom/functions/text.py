"""Text functions as column expressions. All are null-safe: a null input is an empty text unless said otherwise."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from routeloom.functions.expressions import char_runs, let

_CJK = "\\u3400-\\u9fff"


def collapsed(text: Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalized(text: Column) -> Column:
    """Lower case and collapsed whitespace, inside the JVM."""
    return F.lower(collapsed(text))


@F.pandas_udf(StringType())
def normalized_exact(text: pd.Series) -> pd.Series:
    """NFKC, full case folding and collapsed whitespace; these have no JVM twin, so this one crosses to Python in batches."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is not blank, trimmed; null if all are."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def skill_text(name: Column, description: Column, body: Column, max_chars: int | None = None) -> Column:
    """``name | description | body``, empty parts kept, cut at ``max_chars``."""
    whole = F.concat_ws(" | ", *(F.trim(F.coalesce(c, F.lit(""))) for c in (name, description, body)))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def filled_text(*parts: Column) -> Column:
    """Non-blank parts joined by `` | ``."""
    return F.concat_ws(" | ", *(F.nullif(F.trim(c), F.lit("")) for c in parts))


def char_grams(text: Column, width: int = 3) -> Column:
    """Distinct grams of the letters, digits and CJK of a text; a shorter text is one gram, an empty one the empty gram."""
    return F.array_distinct(char_runs(F.regexp_replace(normalized(text), f"[^a-z0-9{_CJK}]+", ""), width))


def word_features(text: Column) -> Column:
    """Distinct words of a-z and 0-9, and pairs of neighbours among the CJK characters as a whole."""
    none = F.array().cast("array<string>")
    pairs = lambda cjk: F.when(F.length(cjk) >= 2, char_runs(cjk, 2)).otherwise(none)
    low = lambda x: F.array_union(F.regexp_extract_all(x, F.lit("([a-z0-9]+)")), let(F.regexp_replace(x, f"[^{_CJK}]+", ""), pairs))
    return let(normalized(text), low)


def cjk_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{_CJK}]"))


def cjk_ratio(text: Column) -> Column:
    """CJK characters among all letters; 0 without letters."""
    letters = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))
    return F.when(letters > 0, cjk_count(text) / letters).otherwise(0.0)


def leaks_identifier(text: Column) -> Column:
    """Whether the text names an ``@owner/slug``."""
    return F.coalesce(text.rlike(r"(?U)@[\w.-]+/[\w.-]+"), F.lit(False))


#: The entities that are replaced inside the JVM; fixed values, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


#: What is taken out of Markdown and HTML, and what is put in its place, in this order; fixed values, as catalogs that
#: were cleaned elsewhere must compare equal.
MARKUP = (
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)```.*?```", " "),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"<[^>]+>", " "),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"[*_`>|]", " "),
)


def cleaned_markup(text: Column, limit: int) -> Column:
    """Plain text of Markdown or HTML by the fixed replacements, with entities as characters, cut at ``limit``."""
    bare = reduce(lambda out, step: F.regexp_replace(out, *step), MARKUP, F.coalesce(text, F.lit("")))
    plain = reduce(lambda out, entity: F.replace(out, *map(F.lit, entity)), ENTITIES, bare)
    return F.trim(F.substring(collapsed(plain), 1, limit))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """All named and numeric HTML entities; the table is Python's, so this crosses in batches."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def page_text(markup: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags."""
    bare = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    return cleaned_markup(bare, 1 << 30)


def section(markdown: Column, heading: str) -> Column:
    """The text under a heading of two or more ``#``, up to the next; empty without it."""
    pattern = rf"(?ims)^##+\s+\Q{heading}\E\s*:?[^\n]*\n(.*?)(?=^##+\s|\z)"
    return F.regexp_extract(F.coalesce(markdown, F.lit("")), pattern, 1)


def front_matter(text: Column) -> Column:
    """Map of the simple ``key: value`` lines between leading ``---`` lines; the first of a key wins."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda s: s.rlike(r"^[\w-]+:\s*\S"))
    pairs = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.regexp_extract(s, r"^[\w-]+:\s*(.*?)\s*$", 1), "^[\"']|[\"']$", "").alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def json_object(text: Column) -> Column:
    """The JSON object or array in a text with or without a fence around it; an array becomes ``{"items": ...}``."""
    plain = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), text)
    found = F.regexp_extract(plain, r"(?s)([\[{].*[\]}])", 1)
    return F.nullif(F.when(found.startswith("["), F.concat(F.lit('{"items":'), found, F.lit("}"))).otherwise(found), F.lit(""))


def repaired_span(text: Column, span: Column) -> Column:
    """An evidence span as it stands in the text: itself, or what an ellipsis in it leaves out; null if it isn't there."""
    head, tail = F.trim(F.regexp_extract(span, r"(?s)^(.*?)(?:\.\.\.|…)", 1)), F.trim(F.regexp_extract(span, r"(?s)(?:\.\.\.|…)(.*)$", 1))
    start = F.position(head, text)
    stop = F.position(tail, text, start + F.length(head))
    filled = (head != "") & (tail != "") & (start > 0) & (stop > 0)
    return F.when(text.contains(span), span).when(filled, F.substring(text, start, stop + F.length(tail) - start))


def aliased(text: Column, identifier: Column, alias: Column) -> Column:
    """``identifier`` replaced by ``alias`` whatever its case."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)\Q"), identifier, F.lit(r"\E")), F.regexp_replace(alias, r"([\\$])", r"\\$1"))


def redacted(text: Column, known: Iterable[str] = ()) -> Column:
    """Known secrets, longest first, then bearer tokens, authorization values, URL user-info and named secrets."""
    out = F.coalesce(text, F.lit(""))
    for value in sorted({v for v in known if v}, key=len, reverse=True):
        out = F.replace(out, F.lit(value), F.lit("[REDACTED]"))
    secret = "(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret|token)"
    for pattern, put in (
        (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
        (r"(?i)(authorization[\"']?\s*[:=]\s*)(?!\s*Bearer \[REDACTED\])[^\s,;]+(?:\s+[^\s,;]+)?", "$1[REDACTED]"),
        (r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@]+@", "$1[REDACTED]@"),
        (rf"(?i)({secret}[\"']?\s*[:=]\s*)([\"'])(?:(?!\2).)*\2", "$1$2[REDACTED]$2"),
        (rf"(?i)({secret}\s*[:=]\s*)(?!\[REDACTED\])[^\s\"',;]+", "$1[REDACTED]"),
    ):
        out = F.regexp_replace(out, pattern, put)
    return out


def sensitive_name(name: Column) -> Column:
    """Whether a name has a component, by case, digits or separators, that marks a secret."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    marks = F.array(*map(F.lit, ("key", "token", "secret", "password", "passwd", "credential", "credentials", "authorization")))
    return F.arrays_overlap(parts, marks)


def token_name(level: Column, index: Column) -> Column:
    return F.format_string("<SK_L%d_%d>", level, index)


def token_level(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, r"^<SK_L(\d+)_(\d+)>$", 1), F.lit("")).cast("int")


def token_index(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, r"^<SK_L(\d+)_(\d+)>$", 2), F.lit("")).cast("int")


def finite_number(text: Column) -> Column:
    """Double of a text; null for what isn't a finite number."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def canonical_url(base: str, owner: Column, slug: Column) -> Column:
    """Base, owner and slug, percent-encoded; a space is ``%20``."""
    quote = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat_ws("/", F.lit(base), quote(owner), quote(slug))


def duration_text(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` of whole seconds, negative as 0, from the largest unit that isn't zero."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    join = lambda *xs: F.concat_ws(" ", *(F.concat(x.cast("long").cast("string"), F.lit(u)) for x, u in xs))
    return (
        F.when(d > 0, join((d, "d"), (h, "h"), (m, "m"), (r, "s"))).when(h > 0, join((h, "h"), (m, "m"), (r, "s"))).when(m > 0, join((m, "m"), (r, "s"))).otherwise(join((r, "s")))
    )
