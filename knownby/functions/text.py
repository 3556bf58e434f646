"""Positions in texts and pieces of them, as column expressions whose work follows the text's length.

An expression inside the body of a lambda is computed for every element, so whatever is
used there is an argument of the function or bound to a variable first (``bound``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
_PIECE = 80


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What merging gives of all elements before each one (0 before the first), for an array of longs.

    Elements are merged block by block, then within the blocks: a fold copies its state
    for every element, so no state may hold the results of all.
    """
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"))

    def before(elements: Column, start: Column, whole: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(elements, state(start, empty), lambda a, x: state(whole(a["at"], x), F.concat(a["out"], F.array(a["at"]))), lambda a: a["out"])

    def cut(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / F.lit(_BLOCK)).cast("int"))
        return F.transform(numbers, lambda b: F.slice(all_, b * _BLOCK + 1, _BLOCK))

    def spread(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, merge))
        return F.flatten(F.zip_with(blocks, before(totals, zero, merge), lambda block, base: before(block, base, merge)))

    return bound(bound(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array(empty))), spread)


def match_starts(gaps: Column, sizes: Column) -> Column:
    """Start of each match, from the lengths of the texts between the matches (one more) and of the matches."""
    def starts(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda x: x["g"] + x["m"]), lambda a, x: a + x)
        return F.zip_with(ends, steps, lambda at, x: at + x["g"])

    steps = F.zip_with(gaps, sizes, lambda g, m: F.struct(g.cast("long").alias("g"), m.cast("long").alias("m")))
    return starts(F.filter(steps, lambda x: x["m"].isNotNull()))


def pieces(text: Column) -> Column:
    """The text in pieces of ``_PIECE`` characters, for ``part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def part(of: Column, begin: Column, end: Column) -> Column:
    """The characters from ``begin`` up to ``end`` of a text given as pieces, without a walk from the text's start."""
    first = F.floor(begin / F.lit(_PIECE))
    count = F.floor(end / F.lit(_PIECE)) - first + 1
    joined = F.array_join(F.slice(of, (first + 1).cast("int"), count.cast("int")), "")
    return F.substring(joined, (begin - first * _PIECE + 1).cast("int"), (end - begin).cast("int"))
