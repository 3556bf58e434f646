"""Statistical tests per group, for groups of any size.

Moments are partial aggregates. The Newey-West variance uses the identity that
the Bartlett-weighted sum of autocovariances with L lags equals the sum of all
squared overlapping (L+1)-term sums of the demeaned series divided by L+1, so it
needs prefix sums and one equi-join on positions instead of L lag products.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownby.functions.checks import insist
from knownby.functions.numeric import deviation, finite, ratio
from knownby.functions.student_t import t_critical, t_p_value
from knownby.session import materialize
from knownby.operators.scale import (
    attach, exact_quantiles, running_fold, running_position, value_positions,
)

EPSILON = 2.220446049250313e-16  # spacing of doubles at one

# Labels of calendar buckets.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def descriptive_statistics(df: DataFrame, *, keys: Sequence[str], value: str, ddof: int = 1) -> DataFrame:
    insist((ddof >= 0, f"no spread has {ddof} degrees of freedom to lose"))
    x = finite(value)
    base = df.groupBy(*keys).agg(
        F.count(x).alias("observations"),
        F.avg(x).alias("mean"),
        deviation(x, ddof).alias("standard_deviation"),
        F.avg(F.when(x.isNotNull(), F.when(x > 0, 1.0).otherwise(0.0))).alias("win_rate"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
    )
    return attach(base, exact_quantiles(df, keys=keys, value=value, quantiles={"median": 0.5}), keys)


def _test_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    x = finite(value)
    return df.groupBy(*keys).agg(
        F.count(x).alias("observations"),
        F.avg(x).alias("estimate"),
        F.stddev_samp(x).alias("__sd"),
        F.max(F.abs(x)).alias("__scale"),
    )


def _checks(minimum_observations: int, confidence: float) -> None:
    insist(
        (minimum_observations > 1, "a standard error takes two observations"),
        (0.0 < confidence < 1.0, "a confidence is a share between zero and one"),
    )


def _flat() -> Column:
    return F.coalesce(
        F.col("__sd") <= F.lit(EPSILON) * F.greatest(F.lit(1.0), F.col("__scale")), F.lit(True)
    )


def _finish(df: DataFrame, *, keys: Sequence[str], null_mean: float, confidence: float,
            with_inference: bool) -> DataFrame:
    """Statistic, p-value and interval from estimate, standard_error and warning."""
    ok = F.col("warning").isNull()
    out = df.withColumn("standard_error", F.when(ok, F.col("standard_error"))).withColumn(
        "statistic", ratio(F.col("estimate") - F.lit(null_mean), "standard_error")
    )
    columns = [*keys, "method", "observations", "estimate", "standard_error", "statistic"]
    if with_inference:
        freedom = (F.col("observations") - 1).cast("double")
        out = out.withColumn("p_value", t_p_value(F.col("statistic"), freedom))
        half = t_critical(F.lit(float(confidence)), F.when(ok, freedom)) * F.col("standard_error")
        out = out.withColumn("__half", half).withColumn(
            "confidence_lower", F.col("estimate") - F.col("__half")
        ).withColumn("confidence_upper", F.col("estimate") + F.col("__half"))
        columns += ["p_value", "confidence_lower", "confidence_upper"]
    return out.withColumn("valid", ok).select(*columns, "valid", "warning")


def mean_test_iid(df: DataFrame, *, keys: Sequence[str], value: str, null_mean: float = 0.0,
                  minimum_observations: int = 20, confidence: float = 0.95,
                  with_inference: bool = True) -> DataFrame:
    """One-sample t-test per group."""
    _checks(minimum_observations, confidence)
    n = F.col("observations")
    tested = _test_moments(df, keys, value).withColumn("method", F.lit("iid_t")).withColumn(
        "warning",
        F.when(n < minimum_observations, "insufficient_observations")
        .when(_flat(), "zero_sample_variance"),
    ).withColumn("standard_error", ratio("__sd", F.sqrt(n.cast("double"))))
    return _finish(tested, keys=keys, null_mean=null_mean, confidence=confidence,
                   with_inference=with_inference)


def _ordered(rows: DataFrame, keys, order, bucket, value: Column, *, position: str, prefix: str) -> DataFrame:
    """Position and running sum of ``value`` in order, bucketed when a group may be huge."""
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(position, F.row_number().over(w)).withColumn(
            prefix, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        )
    cell = F.floor(bucket)
    placed = running_position(rows, keys=keys, order=order, bucket=cell, name=position)
    return running_fold(placed, keys=keys, order=order, bucket=cell, value=value, kind="sum", name=prefix)


def mean_test_hac(df: DataFrame, *, keys: Sequence[str], value: str, order: Sequence[str],
                  bucket: Column | None = None, null_mean: float = 0.0, max_lags: int | None = None,
                  minimum_observations: int = 20, confidence: float = 0.95,
                  with_inference: bool = True) -> DataFrame:
    """Newey-West test of a mean per group.

    ``order`` must be unique per group. ``bucket`` is a monotone expression of the
    first order column and must be given when a group can outgrow one task;
    without it the groups are session series.
    """
    _checks(minimum_observations, confidence)
    insist((max_lags is None or max_lags >= 0, "lags are counted back from zero"))
    x = finite(value)
    moments = _test_moments(df, keys, value)
    n = F.col("observations")
    rule = (
        F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0)))
        if max_lags is None else F.lit(max_lags)
    )
    moments = moments.withColumn(
        "__lags", F.greatest(F.least(rule.cast("bigint"), n - 1), F.lit(0)).cast("bigint")
    )
    rows = df.where(x.isNotNull()).select(*keys, *order, x.alias("__x"))
    rows = attach(rows, moments.select(*keys, "observations", "estimate", "__lags"), keys, "inner")
    rows = rows.withColumn("__e", F.col("__x") - F.col("estimate"))
    if bucket is not None:
        rows = materialize(rows)
    placed = _ordered(rows, keys, order, bucket, F.col("__e"), position="__i", prefix="__p").select(
        *keys, "observations", "__lags", "__i", "__p"
    )
    if max_lags is not None and bucket is None:
        w = Window.partitionBy(*keys).orderBy("__i")
        paired = placed.withColumn("__back", F.lag("__p", max_lags + 1).over(w))
    else:
        placed = materialize(placed)
        back = placed.select(
            *keys, (F.col("__i") + F.col("__lags") + 1).alias("__i"), F.col("__p").alias("__back")
        )
        paired = attach(placed, back, [*keys, "__i"])
    step = F.col("__p") - F.coalesce("__back", F.lit(0.0))
    tail = F.when(
        (F.col("__i") >= F.col("observations") - F.col("__lags"))
        & (F.col("__i") < F.col("observations")),
        F.col("__p") * F.col("__p"),
    ).otherwise(F.lit(0.0))
    spectral = paired.groupBy(*keys).agg(F.sum(step * step + tail).alias("__sum"))
    joined = attach(moments, spectral, keys)
    error = ratio(F.sqrt(ratio("__sum", F.col("__lags") + 1)), n)
    tested = (
        joined.withColumn("standard_error", error)
        .withColumn("method", F.concat(F.lit("hac_mean(max_lags="), F.col("__lags").cast("string"), F.lit(")")))
        .withColumn(
            "warning",
            F.when(n < minimum_observations, "insufficient_observations")
            .when(_flat(), "zero_sample_variance")
            .when(F.coalesce(F.col("standard_error") == 0.0, F.lit(True)), "invalid_hac_standard_error"),
        )
        .withColumn("method", F.when(F.col("warning").isNull(), F.col("method")).otherwise("hac_mean"))
    )
    return _finish(tested, keys=keys, null_mean=null_mean, confidence=confidence,
                   with_inference=with_inference)


#: Values of a series that one row may hold: 512 kB of prefix sums, 250 years of sessions.
_SERIES = 65_536


def _draws(usable: DataFrame, keys: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """The start of each block of each resample."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("__rep").cast("string"), F.col("__blk").cast("string")))
    return (
        usable.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
        .withColumn("__blk", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__blocks"))))
        .withColumn("__start", F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.col("observations"))
    )


def _resampled(amounts: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    sums = amounts.groupBy(*keys, "__rep", "observations").agg(F.sum(amount).alias("__s"))
    return sums.withColumn("__m", ratio("__s", "observations"))


def _means_within(placed: DataFrame, usable: DataFrame, keys: Sequence[str], resamples: int, seed: int, longest: int) -> DataFrame:
    """Means of the resamples of series of at most ``longest`` values: each draw reads its sums from its own row, so that
    draws are never shuffled; only their means are."""
    n = F.col("observations")
    short = attach(placed, usable.where(n <= longest).select(*keys), keys, "inner")
    sums = short.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__p"))), lambda s: s["__p"]).alias("__sums"))
    rows = attach(usable, sums, keys, "inner")
    length = F.when(F.col("__blk") == F.col("__blocks"), F.col("__short")).otherwise(F.col("__b"))
    end = F.col("__start") + length
    around = F.when(end >= n, F.col("__total")).otherwise(F.lit(0.0))
    amount = F.get("__sums", (end % n).cast("int")) + around - F.get("__sums", F.col("__start").cast("int"))
    return _resampled(_draws(rows, keys, resamples, seed), keys, amount)


def _means_by_lookup(placed: DataFrame, usable: DataFrame, keys: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """Means of the resamples of series of any length: draws are joined to the block sums of their starts."""
    n = F.col("observations")
    series = attach(placed, usable, keys, "inner")

    def stop_sum(length: str, name: str, frame: DataFrame) -> DataFrame:
        """Circular sum of ``length`` terms from each start, by one positional lookup."""
        target = frame.withColumn("__t", (F.col("__i") + F.col(length)) % n)
        ends = placed.select(*keys, F.col("__i").alias("__t"), F.col("__p").alias("__end"))
        wraps = F.when(F.col("__i") + F.col(length) >= n, F.col("__total")).otherwise(F.lit(0.0))
        return attach(target, ends, [*keys, "__t"]).withColumn(
            name, F.col("__end") + wraps - F.col("__p")
        ).drop("__t", "__end")

    starts = stop_sum("__short", "__last", stop_sum("__b", "__full", series)).select(
        *keys, F.col("__i").alias("__start"), "__full", "__last"
    )
    draws = _draws(usable.select(*keys, "observations", "__blocks"), keys, resamples, seed)
    amount = F.when(F.col("__blk") == F.col("__blocks"), F.col("__last")).otherwise(F.col("__full"))
    return _resampled(attach(draws, starts, [*keys, "__start"]), keys, amount)


def block_bootstrap_mean(df: DataFrame, *, keys: Sequence[str], value: str, order: Sequence[str],
                         block_size: int | None = None, resamples: int = 2000,
                         minimum_observations: int = 20, confidence: float = 0.95,
                         seed: int = 0) -> DataFrame:
    """Circular moving-block bootstrap of the mean, one row per series.

    Block starts come from a hash of (seed, key, resample, block), so the draw is
    reproducible on any partitioning. Block sums come from prefix sums; a resample
    adds about n / block of them, never n. A series of up to ``_SERIES`` values keeps
    its prefix sums in one row, longer ones are joined by position.
    """
    _checks(minimum_observations, confidence)
    if resamples < 100 or (block_size is not None and block_size < 1):
        raise ValueError("resamples must be at least 100 and block_size positive")
    x = finite(value)
    rows = df.where(x.isNotNull()).select(*keys, *order, x.alias("__x"))
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.select(
        *keys,
        (F.row_number().over(w) - 1).cast("bigint").alias("__i"),
        (F.sum("__x").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__x")).alias("__p"),
    )
    totals = df.groupBy(*keys).agg(
        F.count(x).alias("observations"), F.avg(x).alias("estimate"), F.sum(x).alias("__total")
    )
    n = F.col("observations")
    size = F.greatest(
        F.lit(1), F.round(F.pow(n.cast("double"), F.lit(1.0 / 3.0))).cast("bigint")
    ) if block_size is None else F.lit(block_size).cast("bigint")
    totals = materialize(totals.withColumn("block_size", size))
    used = F.least(F.col("block_size"), n)
    blocks = F.ceil(n / used)
    usable = totals.where(n >= minimum_observations).withColumn("__b", used).withColumn(
        "__blocks", blocks
    ).withColumn("__short", n - (F.col("__blocks") - 1) * F.col("__b"))
    placed = materialize(placed)
    means = _means_within(placed, usable, keys, resamples, seed, _SERIES)
    if not usable.where(n > _SERIES).isEmpty():
        means = means.unionByName(_means_by_lookup(placed, usable.where(n > _SERIES), keys, resamples, seed))
    tail = (1.0 - confidence) / 2.0
    spread = means.groupBy(*keys).agg(
        F.stddev_samp("__m").alias("standard_error"),
        F.percentile("__m", F.lit(tail)).alias("confidence_lower"),
        F.percentile("__m", F.lit(1.0 - tail)).alias("confidence_upper"),
    )
    return attach(totals, spread, keys).select(
        *keys, "observations", "estimate", "standard_error", "confidence_lower",
        "confidence_upper", F.when(n >= minimum_observations, used).otherwise(F.col("block_size")).alias("block_size"),
        F.lit(resamples).alias("resamples"), (n >= minimum_observations).alias("valid"),
        F.when(n < minimum_observations, "insufficient_observations").alias("warning"),
    )


#: Places of one family that meet in one task.
BUCKET_ROWS = 1 << 16


def benjamini_hochberg(df: DataFrame, *, keys: Sequence[str] = (), p_value: str = "p_value",
                       alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values and rejections per family; missing p-values stay missing.

    Tied p-values share one adjusted value, so the step-up minimum runs over
    distinct values, in buckets of ``BUCKET_ROWS`` places of the family's own order: a family may be the whole
    table, and however its values crowd, a bucket holds no more of them.
    """
    insist((0.0 < alpha < 1.0, "a false-discovery level is a share between zero and one"))
    p = finite(p_value)
    checked = df.withColumn(
        "__p",
        F.when(p.isNull() | p.between(0.0, 1.0), p).otherwise(
            F.raise_error(F.lit("p-values must lie between zero and one")).cast("double")
        ),
    )
    places = materialize(value_positions(checked, keys=keys, value="__p"))
    stepped = running_fold(
        places, keys=keys, order=[F.col("value").desc()], bucket=-F.floor(F.col("last") / F.lit(BUCKET_ROWS)),
        value=F.col("value") * F.col("n") / F.col("last"), kind="min", name="__adjusted",
    ).select(*keys, F.col("value").alias("__p"), F.least(F.col("__adjusted"), F.lit(1.0)).alias("q_value"))
    joined = attach(checked, stepped, [*keys, "__p"]).drop("__p")
    return joined.withColumn("fdr_rejected", F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def compound_period_returns(df: DataFrame, *, keys: Sequence[str], order: str, value: str,
                            frequency: str = "month", minimum_observations: int = 15,
                            exclude_boundary_periods: bool = True) -> DataFrame:
    """Compounded return per calendar period with enough observations."""
    insist((minimum_observations > 0, "a period without observations has no return"))
    r = finite(value)
    period = F.to_date(F.date_trunc(frequency, F.col(order)))
    grouped = df.groupBy(*keys, period.alias("period")).agg(
        F.count(r).alias("observations"), (F.product(F.lit(1.0) + r) - F.lit(1.0)).alias("period_return")
    )
    kept = F.col("observations") >= minimum_observations
    if exclude_boundary_periods:
        whole = Window.partitionBy(*keys)
        grouped = grouped.withColumn("__lo", F.min("period").over(whole)).withColumn(
            "__hi", F.max("period").over(whole)
        )
        kept = kept & (F.col("period") != F.col("__lo")) & (F.col("period") != F.col("__hi"))
    return grouped.where(kept).select(*keys, "period", "observations", "period_return")


def bucket_summary(df: DataFrame, buckets: DataFrame, *, keys: Sequence[str], bucket: str, value: str,
                   order: Sequence[str], minimum_observations: int, max_lags: int | None,
                   alpha: float, with_inference: bool = True) -> DataFrame:
    """Descriptive statistics, HAC test and FDR per (key, bucket), listing empty buckets too."""
    cell = [*keys, bucket]
    df = materialize(df)
    stats = descriptive_statistics(df, keys=cell, value=value)
    tests = mean_test_hac(df, keys=cell, value=value, order=order, max_lags=max_lags,
                          minimum_observations=minimum_observations, with_inference=with_inference)
    wanted = ["standard_error", "statistic", "valid", "warning"]
    if with_inference:
        wanted += ["p_value", "confidence_lower", "confidence_upper"]
    table = attach(attach(buckets, stats, cell), tests.select(*cell, *wanted), cell)
    table = table.withColumn("observations", F.coalesce("observations", F.lit(0))).withColumn(
        "valid", F.coalesce("valid", F.lit(False))
    ).withColumn("warning", F.when(F.col("valid"), F.lit(None)).otherwise(
        F.coalesce("warning", F.lit("insufficient_observations"))))
    if with_inference:
        table = materialize(table)
    table = table.withColumnsRenamed(
        {"mean": "mean_return", "median": "median_return", "standard_deviation": "sample_std",
         "valid": "test_valid", "warning": "test_warning"}
    )
    return benjamini_hochberg(table, keys=keys, alpha=alpha) if with_inference else table


def _labelled(buckets: DataFrame, bucket: str, labels: Sequence[str], first: int) -> DataFrame:
    names = F.array(*[F.lit(label) for label in labels])
    return buckets.withColumn("label", F.element_at(names, F.col(bucket) - first + 1))


def monthly_seasonality(df: DataFrame, *, keys: Sequence[str], order: str, value: str,
                        minimum_days_per_month: int = 15, minimum_years: int = 5,
                        exclude_boundary_months: bool = True, max_lags: int | None = 1,
                        alpha: float = 0.05, with_inference: bool = True) -> DataFrame:
    """Calendar-month table; all twelve months are listed for every series."""
    periods = compound_period_returns(
        df, keys=keys, order=order, value=value, minimum_observations=minimum_days_per_month,
        exclude_boundary_periods=exclude_boundary_months,
    ).withColumn("bucket", F.month("period")).drop("observations")
    listed = df.select(*keys).distinct().withColumn(
        "bucket", F.explode(F.sequence(F.lit(1), F.lit(12)))
    )
    return bucket_summary(
        periods, _labelled(listed, "bucket", MONTHS, 1), keys=keys, bucket="bucket",
        value="period_return", order=["period"], minimum_observations=minimum_years,
        max_lags=max_lags, alpha=alpha, with_inference=with_inference,
    )


def weekday_seasonality(df: DataFrame, *, keys: Sequence[str], order: str, value: str,
                        minimum_observations: int = 20, max_lags: int | None = 1,
                        alpha: float = 0.05, with_inference: bool = True) -> DataFrame:
    """Weekday table over the weekdays that have a return (0 = Monday)."""
    rows = df.where(finite(value).isNotNull()).withColumn("bucket", F.weekday(order))
    listed = rows.select(*keys, "bucket").distinct()
    return bucket_summary(
        rows, _labelled(listed, "bucket", WEEKDAYS, 0), keys=keys, bucket="bucket", value=value,
        order=[order], minimum_observations=minimum_observations, max_lags=max_lags, alpha=alpha,
        with_inference=with_inference,
    )
