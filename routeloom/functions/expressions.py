"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row.

    A column that a lambda refers to is merged into the lambda by the optimizer and computed again for each element;
    a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_runs(text: Column, width: int) -> Column:
    """Every run of ``width`` characters in order, in one pass over the text; a shorter text is one run.

    Neighbours are joined from an array of characters: a substring at a place would walk the text up to it each time.
    """

    def runs(chars: Column) -> Column:
        joined = F.transform(chars, lambda c, i: F.concat(c, *(F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, width))))
        return F.slice(joined, 1, F.greatest(F.lit(1), F.size(chars) - (width - 1)))

    return let(F.split(text, ""), runs)


def ranked_in(cuts: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that gives how many entries of the sorted array ``cuts`` are at most a value.

    A binary search whose steps follow the array's size. They are made once for each row, however many values are looked
    up; values should be plain columns or variables, as they are read at each step. Null ``cuts`` count as empty.
    """
    none = F.array().cast("array<bigint>")
    bits = F.when(F.size(cuts) > 0, F.transform(F.sequence(F.floor(F.log2(F.size(cuts))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int")))

    def search(steps: Column) -> Callable[[Column], Column]:
        further = lambda x: lambda p, w: F.when((p + w <= F.size(cuts)) & (F.get(cuts, p + w - 1) <= x), p + w).otherwise(p)
        return lambda x: F.aggregate(steps, F.lit(0), further(x))

    return let(F.coalesce(bits, none.cast("array<int>")), lambda steps: body(search(steps)))
