"""Cross-sectional operators: one group per decision date, any number of names.

A date may hold every security of the market, so no step puts a date in one
task: moments are partial aggregates joined back, quantiles and ranks come from
the bucketed order statistics in ``scale``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownby.functions.numeric import clip, dispersed, finite, ratio
from knownby.operators.scale import attach, exact_quantiles, group_moments, placed_quantiles, value_positions
from knownby.session import materialize


def winsorize(df: DataFrame, *, keys: Sequence[str], value: str, lower: float = 0.01,
              upper: float = 0.99, minimum: int = 5, name: str = "winsorized") -> DataFrame:
    """Clip to linear quantiles of the group; thin groups give null, missing stays missing."""
    return _clipped(df, _bounds(_stored(df, keys, value), keys, lower, upper, minimum), keys, value, name)


def _stored(df: DataFrame, keys: Sequence[str], value: str, *more: str) -> DataFrame:
    """The group and the value alone, written once for the facts that read it several times."""
    return materialize(df.select(*dict.fromkeys([*keys, *more]), finite(value).alias("__value")))


def _clip_check(lower: float, upper: float, minimum: int) -> None:
    if not 0.0 <= lower < upper <= 1.0 or minimum < 1:
        raise ValueError("clip between two ordered quantiles of a group of one or more")


def _bounds(values: DataFrame, keys, lower, upper, minimum) -> DataFrame:
    """One row per group of at least ``minimum`` values: the bounds to clip to."""
    _clip_check(lower, upper, minimum)
    bounds = exact_quantiles(values, keys=keys, value="__value", quantiles={"__lo": lower, "__hi": upper})
    counts = values.groupBy(*keys).agg(F.count("__value").alias("__n")).where(F.col("__n") >= minimum)
    return attach(counts, bounds, keys).drop("__n")


def _clipped(df: DataFrame, bounds: DataFrame, keys, value, name) -> DataFrame:
    clipped = clip(finite(value), F.col("__lo"), F.col("__hi"))
    work = attach(df, bounds.withColumn("__full", F.lit(True)), keys)
    return work.withColumn(name, F.when(F.col("__full"), clipped)).drop("__full", "__lo", "__hi")


def cross_sectional_zscore(df: DataFrame, *, keys: Sequence[str], value: str,
                           groups: str | None = None, ddof: int = 0, minimum: int = 5,
                           name: str = "zscore", source: DataFrame | None = None) -> DataFrame:
    """Standardize within a date, or within (date, group) when ``groups`` is given.

    ``source`` holds the same groups and values, if they are at hand more cheaply.
    """
    if ddof < 0 or minimum <= ddof:
        raise ValueError("minimum must exceed non-negative ddof")
    within = [*keys, groups] if groups else list(keys)
    stats = group_moments(df if source is None else source, keys=within, value=value, ddof=ddof)
    score = ratio(finite(value) - F.col("__g_mean"), dispersed(F.col("__g_sd"), "__g_mean"))
    usable = F.col("__g_n") >= minimum
    if groups:
        usable = usable & F.col(groups).isNotNull()
    return attach(df, stats, within).withColumn(name, F.when(usable, score)).drop(
        "__g_n", "__g_mean", "__g_sd"
    )


def percentile_rank(df: DataFrame, *, keys: Sequence[str], value: str,
                    name: str = "percentile") -> DataFrame:
    """Average rank over the number of non-missing names."""
    ranks = _ranks(_stored(df, keys, value), keys, "__value", name)
    return attach(df.withColumn("__value", finite(value)), ranks, [*keys, "__value"]).drop("__value")


def _ranks(values: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of each distinct value over the number of values of its group."""
    return value_positions(values, keys=keys, value=value).select(
        *keys, F.col("value").alias(value), ratio((F.col("first") + F.col("last")) / F.lit(2.0), "n").alias(name)
    )


def normalize_factor(df: DataFrame, *, keys: Sequence[str], value: str, groups: str | None = None,
                     lower: float = 0.01, upper: float = 0.99, ddof: int = 0,
                     minimum: int = 5) -> DataFrame:
    """Adds raw, winsorized, zscore and percentile columns for one factor.

    The rows are written once, as they may be costly. Clipping keeps the order, so the bounds and the ranks of clipped
    values all come from one placing of the raw ones: what is clipped to a bound ties with everything beyond it.
    """
    _clip_check(lower, upper, minimum)
    rows = materialize(df.withColumn("raw", finite(value)))
    places = materialize(value_positions(rows, keys=keys, value="raw"))
    full = places.where(F.col("n") >= minimum)
    bounds = placed_quantiles(full, keys=keys, quantiles={"__lo": lower, "__hi": upper})
    ends = materialize(attach(full, bounds, keys, "inner").groupBy(*keys).agg(
        F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"),
        F.max(F.when(F.col("value") <= F.col("__lo"), F.col("last"))).alias("__low_last"),
        F.min(F.when(F.col("value") >= F.col("__hi"), F.col("first"))).alias("__high_first"),
    ))
    work = _clipped(rows, ends.select(*keys, "__lo", "__hi"), keys, "raw", "winsorized")
    scored = cross_sectional_zscore(work, keys=keys, value="winsorized", groups=groups, ddof=ddof, minimum=minimum)
    one = F.col("__lo") == F.col("__hi")
    low, high = one | (F.col("value") <= F.col("__lo")), one | (F.col("value") >= F.col("__hi"))
    first = F.when(low, F.lit(1)).when(high, F.col("__high_first")).otherwise(F.col("first"))
    last = F.when(high, F.col("n")).when(low, F.col("__low_last")).otherwise(F.col("last"))
    ranks = attach(full, ends, keys, "inner").select(
        *keys, F.col("value").alias("raw"), ratio((first + last) / F.lit(2.0), "n").alias("percentile")
    )
    return attach(scored, ranks, [*keys, "raw"])
