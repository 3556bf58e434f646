"""Analyst estimates and valuation: revisions, breadth, dispersion, multiples."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownby.functions.checks import insist
from knownby.functions.numeric import deviation, dispersed, finite, growth, ratio
from knownby.operators.pit import Instant, instant, require_columns, utc
from knownby.operators.scale import attach, group_moments

ESTIMATE_KEYS = ("security_id", "metric", "fiscal_period")


def _vintage(value: Column, order: Column, known: Column) -> Column:
    """Value of the newest row satisfying ``known``; a null on that row stays null."""
    return F.max_by(value, F.when(known, order))


def estimate_revisions(snapshots: DataFrame, *, as_of: Instant,
                       lookback_days: Sequence[int] = (1, 7, 30),
                       keys: Sequence[str] = ESTIMATE_KEYS, value: str = "consensus",
                       available: str = "available_at", tie_break: Sequence[str] = ()) -> DataFrame:
    """Now versus n days ago, all lookbacks in one aggregation over the vintages."""
    days = list(dict.fromkeys(int(d) for d in lookback_days))
    insist((bool(days) and min(days) > 0, "name the days to look back, one or more each"))
    require_columns(snapshots, [*keys, value, available])
    cutoff = utc(as_of)
    number, order, at = finite(value), F.struct(available, *tie_break), F.col(available)
    known = snapshots.where(at <= instant(cutoff))
    result = known.groupBy(*keys).agg(
        F.max_by(number, order).alias("consensus_now"),
        F.max(available).alias("available_at_now"),
        *[
            _vintage(number, order, at <= instant(cutoff - timedelta(days=d))).alias(f"consensus_{d}d_ago")
            for d in days
        ],
    )
    return result.withColumns(
        {f"revision_{d}d": growth("consensus_now", f"consensus_{d}d_ago") for d in days}
    )


def revision_breadth(snapshots: DataFrame, *, as_of: Instant, lookback_days: int = 30,
                     groups: Sequence[str] = ESTIMATE_KEYS, contributor: str = "contributor_id",
                     value: str = "estimate", available: str = "available_at",
                     tie_break: Sequence[str] = ()) -> DataFrame:
    """(raises - cuts) / changed over contributors present at both instants."""
    insist((lookback_days > 0, "a revision looks one day back at least"))
    require_columns(snapshots, [*groups, contributor, value, available])
    cutoff = utc(as_of)
    number, order, at = finite(value), F.struct(available, *tie_break), F.col(available)
    pairs = (
        snapshots.where(at <= instant(cutoff)).groupBy(*groups, contributor)
        .agg(
            F.max_by(number, order).alias("now"),
            _vintage(number, order, at <= instant(cutoff - timedelta(days=lookback_days))).alias("prior"),
        )
        .where("now is not null and prior is not null")
    )
    counted = pairs.groupBy(*groups).agg(
        F.count_if(F.col("now") > F.col("prior")).alias("raises"),
        F.count_if(F.col("now") < F.col("prior")).alias("cuts"),
        F.count_if(F.col("now") == F.col("prior")).alias("unchanged"),
        F.count(F.lit(1)).alias("contributors_paired"),
    ).withColumn("contributors_changed", F.col("raises") + F.col("cuts"))
    return counted.withColumn(
        "revision_breadth", ratio(F.col("raises") - F.col("cuts"), "contributors_changed")
    )


def estimate_dispersion(df: DataFrame, *, keys: Sequence[str], value: str, ddof: int = 1) -> DataFrame:
    insist((ddof >= 0, f"no spread has {ddof} degrees of freedom to lose"))
    x = finite(value)
    out = df.groupBy(*keys).agg(
        F.count(x).alias("contributors"), F.avg(x).alias("mean"),
        deviation(x, ddof).alias("standard_deviation"),
    )
    return out.withColumn("coefficient_of_variation", F.abs(ratio("standard_deviation", "mean")))


def valuation_distribution(df: DataFrame, *, keys: Sequence[str], order: str, value: str,
                           as_of: Instant | None = None, lookback: int | None = 1260,
                           minimum: int = 60, ddof: int = 1) -> DataFrame:
    """Latest multiple against its own trailing history (one observation per session)."""
    if ddof < 0 or minimum <= ddof or (lookback is not None and lookback < minimum):
        raise ValueError("lookback, minimum or ddof are out of range")
    x = finite(value)
    history = df.where(x.isNotNull()).select(*keys, order, x.alias("__v"))
    if as_of is not None:
        history = history.where(F.col(order) <= instant(as_of))
    recent = history.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    )
    if lookback is not None:
        recent = recent.where(F.col("__r") <= lookback)
    newest = F.max(F.when(F.col("__r") == 1, F.col("__v"))).over(Window.partitionBy(*keys))
    stats = recent.withColumn("__current", newest).groupBy(*keys).agg(
        F.count("__v").alias("observations"),
        F.max("__current").alias("current"),
        F.percentile("__v", F.lit(0.5)).alias("median"),
        F.avg("__v").alias("__mean"),
        deviation(F.col("__v"), ddof).alias("__sd"),
        F.avg(F.when(F.col("__v") <= F.col("__current"), 1.0).otherwise(0.0)).alias("percentile"),
    )
    enough = F.col("observations") >= minimum
    return stats.select(
        *keys, "observations", "current",
        F.when(enough, F.col("median")).alias("median"),
        F.when(enough, ratio(F.col("current") - F.col("__mean"), dispersed(F.col("__sd")))).alias("zscore"),
        F.when(enough, F.col("percentile")).alias("percentile"),
    )


def peer_relative_zscore(df: DataFrame, *, peer_group: Sequence[str], value: str, minimum: int = 5,
                         ddof: int = 0, exclude_self: bool = False, name: str = "peer_zscore") -> DataFrame:
    """Value against its peer group's finite values.

    ``exclude_self`` removes the row's own value algebraically from the group
    moments, so no peer pairs are formed.
    """
    if ddof < 0 or minimum <= ddof:
        raise ValueError("minimum must exceed non-negative ddof")
    x = finite(value)
    if not exclude_self:
        stats = group_moments(df, keys=peer_group, value=value, ddof=ddof)
        score = ratio(x - F.col("__g_mean"), dispersed(F.col("__g_sd")))
        return attach(df, stats, peer_group).withColumn(
            name, F.when(F.col("__g_n") >= minimum, score)
        ).drop("__g_n", "__g_mean", "__g_sd")
    stats = df.groupBy(*peer_group).agg(
        F.count(x).alias("__n"), F.avg(x).alias("__m"), (F.var_pop(x) * F.count(x)).alias("__ss")
    )
    work = attach(df, stats, peer_group)
    own = F.when(x.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    n = F.col("__n") - own
    gap = x - F.col("__m")
    mean = F.col("__m") - ratio(gap, n)
    squares = F.greatest(F.col("__ss") - gap * gap * ratio(F.col("__n").cast("double"), n), F.lit(0.0))
    spread = F.sqrt(ratio(squares, n - F.lit(ddof)))
    return work.withColumn(
        name, F.when((n >= minimum) & (n > ddof), ratio(x - mean, dispersed(spread)))
    ).drop("__n", "__m", "__ss")


def valuation_decomposition(df: DataFrame, *, price_return: str, earnings_revision: str) -> DataFrame:
    """Multiple return M from (1 + P) = (1 + E)(1 + M), and the rebuilt price return."""
    p, e = finite(price_return), finite(earnings_revision)
    one = F.lit(1.0)
    return df.withColumn("multiple_return", growth(one + p, one + e)).withColumn(
        "reconstructed_return", (one + e) * (one + F.col("multiple_return")) - one
    )
