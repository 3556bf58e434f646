"""Means and co-moments of trailing windows at constant work per row.

A series is cut into blocks of ``window`` rows. A trailing window is then the end of
one block and the beginning of the next, so it is merged from a sum that runs from the
beginning of each block and one that runs from its end. Both restart in every block:
a row outside the window takes no part, not even by rounding, and nothing is ever
subtracted. Sums are means and co-deviations, merged pairwise, so a level far above
the spread costs no digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def backwards(keys: Sequence[str], order: str) -> WindowSpec:
    """A series from its latest row to its earliest, in the order that ``trailing_moments`` leaves."""
    return Window.partitionBy(*keys).orderBy("__back", F.col(order).desc())


def trailing_moments(df: DataFrame, *, keys: Sequence[str], order: str, groups: Sequence[Sequence[str]], window: int, lag: int) -> DataFrame:
    """Add the moments of each group of columns over the ``window`` rows that end ``lag`` rows before each row.

    The columns of a group are null together. Group g adds ``__n{g}``, the mean
    ``__m{g}_{i}`` of its column i and the population covariance ``__c{g}_{i}_{j}``
    of its columns i <= j; means and covariances are null where no row counts. ``__at`` numbers
    the rows of a series from 0, ``__back`` its blocks from 0 downwards.
    """
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    work = df.withColumns({"__at": at, "__back": -F.floor(at / F.lit(window))})
    blocks = Window.partitionBy(*keys, "__back")
    running = {"__head": blocks.orderBy(order), "__tail": blocks.orderBy(F.col(order).desc())}
    for name, frame in running.items():
        over = frame.rowsBetween(Window.unboundedPreceding, 0)
        parts = []
        for g, columns in enumerate(groups):
            parts.append(F.count(columns[0]).over(over).cast("double").alias(f"n{g}"))
            for i, c in enumerate(columns):
                parts.append(F.avg(c).over(over).alias(f"m{g}_{i}"))
                parts += [F.covar_pop(c, columns[j]).over(over).alias(f"c{g}_{i}_{j}") for j in range(i, len(columns))]
        work = work.withColumn(name, F.struct(*parts))
    # The last sums left the rows from the latest to the earliest, so looking on from there takes no further sort.
    earlier = backwards(keys, order)
    # Where the window ends with a block, it is that block.
    split = F.pmod(F.col("__at") - lag, F.lit(window)) != window - 1
    work = work.withColumns({"__head": F.lead("__head", lag).over(earlier), "__tail": F.when(split, F.lead("__tail", lag + window - 1).over(earlier))})
    added: dict[str, Column] = {}
    for g, columns in enumerate(groups):
        def side(part: str, field: str) -> Column:
            return F.col(part)[field]

        n1, n2 = (F.coalesce(side(p, f"n{g}"), F.lit(0.0)) for p in ("__tail", "__head"))
        n = n1 + n2

        def merged(field: str, both: Column) -> Column:
            return F.when(n1 == 0, side("__head", field)).when(n2 == 0, side("__tail", field)).otherwise(both)

        def step(i: int) -> Column:
            return side("__head", f"m{g}_{i}") - side("__tail", f"m{g}_{i}")

        added[f"__n{g}"] = n
        for i in range(len(columns)):
            added[f"__m{g}_{i}"] = merged(f"m{g}_{i}", side("__tail", f"m{g}_{i}") + step(i) * n2 / n)
            for j in range(i, len(columns)):
                field = f"c{g}_{i}_{j}"
                within = (side("__tail", field) * n1 + side("__head", field) * n2) / n
                added[f"__{field}"] = merged(field, within + step(i) * step(j) * (n1 / n) * (n2 / n))
    return work.withColumns(added).drop("__head", "__tail")


def moments_within(groups: Sequence[Sequence[str]], inside: Column) -> list[Column]:
    """What ``trailing_moments`` adds of each group, as aggregates over the rows of a series that lie ``inside`` one window."""
    out = []
    for g, columns in enumerate(groups):
        held = [F.when(inside, F.col(c)) for c in columns]
        out.append(F.count(held[0]).cast("double").alias(f"__n{g}"))
        for i, c in enumerate(held):
            out.append(F.avg(c).alias(f"__m{g}_{i}"))
            out += [F.covar_pop(c, held[j]).alias(f"__c{g}_{i}_{j}") for j in range(i, len(held))]
    return out
