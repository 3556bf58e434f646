"""Exploratory analytics with looser conventions than the main operators.

They differ on purpose: no boundary exclusion, missing returns counted as
non-wins, windows clipped at the ends of a series, IID p-values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownby.functions.numeric import dispersed, finite, growth, ratio
from knownby.functions.student_t import t_p_value
from knownby.operators.inference import MONTHS, WEEKDAYS
from knownby.operators.scale import attach, exact_quantiles


def _t(value: Column) -> tuple[Column, Column]:
    """Statistic against zero and degrees of freedom."""
    n = F.count(value)
    return ratio(F.avg(value), ratio(dispersed(F.stddev_samp(value)), F.sqrt(n.cast("double")))), (n - 1).cast("double")


def monthly_table(df: DataFrame, *, keys: Sequence[str], order: str, value: str,
                  with_p_value: bool = True) -> DataFrame:
    """Calendar-month statistics over every month, however incomplete."""
    r = finite(value)
    monthly = df.groupBy(*keys, F.to_date(F.date_trunc("month", F.col(order))).alias("period")).agg(
        (F.coalesce(F.product(F.lit(1.0) + r), F.lit(1.0)) - F.lit(1.0)).alias("monthly_return")
    ).withColumn("month", F.month("period"))
    m = F.col("monthly_return")
    statistic, freedom = _t(m)
    table = monthly.groupBy(*keys, "month").agg(
        F.avg(m).alias("mean_return"), F.stddev_samp(m).alias("std_dev"),
        F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.count(m).alias("years"),
        statistic.alias("t_statistic"), freedom.alias("__df"),
    )
    middle = exact_quantiles(monthly, keys=[*keys, "month"], value="monthly_return", quantiles={"median_return": 0.5})
    table = attach(table, middle, [*keys, "month"])
    if with_p_value:
        table = table.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("__df")))
    names = F.array(*[F.lit(n) for n in MONTHS])
    return table.drop("__df").withColumn("label", F.element_at(names, F.col("month")))


def best_and_worst_month(table: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    order = F.struct(F.col("mean_return"), (-F.col("month")).alias("m"))
    least = F.struct(F.col("mean_return"), F.col("month").alias("m"))
    return table.groupBy(*keys).agg(
        F.max_by("label", order).alias("best_month"), F.max("mean_return").alias("best_mean"),
        F.min_by("label", least).alias("worst_month"), F.min("mean_return").alias("worst_mean"),
    )


def weekday_table(df: DataFrame, *, keys: Sequence[str], order: str, value: str,
                  with_p_value: bool = True) -> DataFrame:
    """Weekday statistics for Monday to Friday; a missing return counts as a non-win."""
    r = finite(value)
    statistic, freedom = _t(r)
    table = (
        df.withColumn("weekday", F.weekday(order)).where("weekday < 5").groupBy(*keys, "weekday")
        .agg(
            F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("std_dev"),
            F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.count(r).alias("observations"),
            statistic.alias("t_statistic"), freedom.alias("__df"),
        )
        .withColumn("annualized", F.col("mean_return") * F.lit(252.0))
    )
    if with_p_value:
        table = table.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("__df")))
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return table.drop("__df").withColumn("label", F.element_at(names, F.col("weekday") + 1))


def clipped_event_windows(series: DataFrame, event_dates: DataFrame, *, keys: Sequence[str], session: str,
                          close: str, value: str, window: int = 5, event: str = "event_date") -> DataFrame:
    """Close-to-close moves around date events, windows clipped at the series ends.

    Event dates roll to the next session. Each session carries the dates since
    the previous one, so dates and series meet in an equi-join.
    """
    w = Window.partitionBy(*keys).orderBy(session)
    price = finite(close)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(price).over(whole), F.last(price).over(whole)
    position, size = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    before = F.when(position > window, F.lag(price, window).over(w)).otherwise(first)
    after = F.when(position + window <= size, F.lead(price, window).over(w)).otherwise(last)
    span = event_dates.agg(F.min(event).alias("__first"))
    day = F.to_date(session)
    prepared = series.withColumns(
        {
            "pre": growth(price, before), "event_day": finite(value), "post": growth(after, price),
            "__prev": F.lag(day).over(w),
        }
    ).join(span, F.lit(True), "inner")
    start = F.coalesce(F.date_add("__prev", 1), F.least(F.col("__first"), day))
    daily = prepared.select(
        *keys, day.alias("session_date"), "pre", "event_day", "post",
        F.explode(F.sequence(start, day)).alias(event),
    )
    return event_dates.select(event).distinct().join(daily, event)


def substring_insider_sums(df: DataFrame, *, keys: Sequence[str], action: str, value: str) -> DataFrame:
    text, amount = F.lower(F.col(action)), finite(value)
    buys = F.sum(F.when(text.contains("buy"), amount))
    sells = F.sum(F.when(text.rlike("sale|sell"), amount))
    sums = df.groupBy(*keys).agg(
        F.coalesce(buys, F.lit(0.0)).alias("buy_value"), F.coalesce(sells, F.lit(0.0)).alias("sell_value")
    )
    odds = F.when((F.col("sell_value") > 0) & (F.col("buy_value") > 0), ratio("buy_value", "sell_value"))
    return sums.withColumn("buy_sell_ratio", odds).withColumn(
        "edge", F.when(odds < 0.1, "heavy_net_selling").when(odds > 2.0, "heavy_net_buying")
    )


def squeeze_flag(short_percent_of_float: Column | str, days_to_cover: Column | str) -> Column:
    return F.coalesce(
        (finite(short_percent_of_float) > 0.15) & (finite(days_to_cover) > 5), F.lit(False)
    )


def chain_sentiment(chain: DataFrame, *, keys: Sequence[str], spot: str) -> DataFrame:
    """Put/call ratios and moneyness skew of one chain, missing counts as zero."""
    call, put = F.col("side") == "call", F.col("side") == "put"
    zero = F.lit(0.0)
    total = lambda side, c: F.coalesce(F.sum(F.when(side, finite(c))), zero)
    out = chain.groupBy(*keys).agg(
        total(call, "volume").alias("__cv"), total(put, "volume").alias("__pv"),
        total(call, "open_interest").alias("__co"), total(put, "open_interest").alias("__po"),
        F.avg(F.when(put & (F.col("strike") < F.col(spot) * 0.95), finite("implied_volatility"))).alias("otm_put_iv"),
        F.avg(F.when(call & (F.col("strike") > F.col(spot) * 1.05), finite("implied_volatility"))).alias("otm_call_iv"),
    )
    volume, skew = ratio("__pv", "__cv"), F.col("otm_put_iv") - F.col("otm_call_iv")
    return out.select(
        *keys, volume.alias("volume_ratio"), ratio("__po", "__co").alias("open_interest_ratio"),
        "otm_put_iv", "otm_call_iv", skew.alias("iv_skew"),
        F.when(volume > 1.2, "bearish").when(volume < 0.6, "bullish").alias("volume_edge"),
        F.coalesce(skew > 0.05, F.lit(False)).alias("elevated_skew"),
    )


def earnings_drift(series: DataFrame, events: DataFrame, *, keys: Sequence[str], session: str,
                   value: str, open_: str = "open", close: str = "close", event: str = "event_date") -> DataFrame:
    """Pre-run, gap, day and +5 drift at the session on or after each event; interior anchors only."""
    w = Window.partitionBy(*keys).orderBy(session)
    price = finite(close)
    day = F.to_date(session)
    prepared = series.withColumns(
        {
            "pre_run": growth(F.lag(price, 1).over(w), F.lag(price, 5).over(w)),
            "gap": growth(finite(open_), F.lag(price, 1).over(w)),
            "day_of": finite(value),
            "post_drift": growth(F.lead(price, 5).over(w), price),
            "__inner": (F.row_number().over(w) > 5)
            & (F.lead(F.lit(1), 5).over(w).isNotNull()),
            "__prev": F.lag(day).over(w),
        }
    ).where("__inner")
    daily = prepared.select(
        *keys, day.alias("anchor"), "pre_run", "gap", "day_of", "post_drift",
        F.explode(F.sequence(F.date_add("__prev", 1), day)).alias(event),
    )
    return events.select(*keys, event).join(daily, [*keys, event])


def drift_summary(drift: DataFrame, *, by: Sequence[str], with_p_value: bool = False) -> DataFrame:
    """Mean, win rate and t of each drift column over any number of events."""
    names = ("pre_run", "gap", "day_of", "post_drift")
    long = drift.select(
        *by, F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("value")) for n in names])).alias("__x")
    ).select(*by, "__x.pattern", "__x.value")
    return pattern_table(long, keys=[*by, "pattern"], with_p_value=with_p_value)


def pattern_table(long: DataFrame, *, keys: Sequence[str], value: str = "value",
                  with_p_value: bool = True) -> DataFrame:
    x = finite(value)
    statistic, freedom = _t(x)
    out = long.groupBy(*keys).agg(
        F.count(x).alias("observations"), F.avg(x).alias("mean"),
        F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        statistic.alias("t_statistic"), freedom.alias("__df"),
    )
    if with_p_value:
        out = out.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("__df")))
    return out.drop("__df")


def sector_rotation(df: DataFrame, *, keys: Sequence[str], order: str, asset: str, sector: str,
                    market: str) -> DataFrame:
    """Cumulative returns, 63-row relative-strength change, beta and correlations per security."""
    a, s, m = finite(asset), finite(sector), finite(market)
    rows = df.where(a.isNotNull() & s.isNotNull() & m.isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    path = w.rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1.0)
    wealth = {n: F.product(one + c).over(path) for n, c in (("a", a), ("s", s), ("m", m))}
    paths = rows.withColumns({f"__{n}": c for n, c in wealth.items()}).withColumns(
        {"__rs": ratio("__a", "__s"), "__rm": ratio("__a", "__m")}
    ).withColumns(
        {
            "__ds": growth("__rs", F.lag("__rs", 62).over(w)),
            "__dm": growth("__rm", F.lag("__rm", 62).over(w)),
            "__n": F.row_number().over(w),
        }
    )
    at_end = lambda c: F.max_by(F.col(c), F.col("__n"))
    cov, var = F.covar_samp(a, m), F.var_samp(m)
    table = paths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        (at_end("__a") - one).alias("asset_return"), (at_end("__s") - one).alias("sector_return"),
        (at_end("__m") - one).alias("market_return"),
        at_end("__ds").alias("strength_change_sector"), at_end("__dm").alias("strength_change_market"),
        ratio(cov, dispersed(var)).alias("beta_market"),
        ratio(cov, dispersed(F.stddev_samp(a) * F.stddev_samp(m))).alias("correlation_market"),
        ratio(F.covar_samp(a, s), dispersed(F.stddev_samp(a) * F.stddev_samp(s))).alias("correlation_sector"),
    )
    change = F.col("strength_change_sector")
    return table.withColumn("edge", F.when(change > 0.05, "outperforming").when(change < -0.05, "underperforming"))


def edge_summary(patterns: Sequence[DataFrame], *, threshold: float = 0.10) -> DataFrame:
    """Patterns with a p-value under the threshold, from tables sharing pattern, mean, p_value."""
    union = patterns[0]
    for table in patterns[1:]:
        union = union.unionByName(table)
    bias = F.when(F.col("mean") > 0, "positive").otherwise("negative")
    return union.where(F.col("p_value") < threshold).withColumn("bias", bias)


def baseline_profile(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """(1 + mean)^252 - 1, volatility and Sharpe of daily returns."""
    r = finite(value)
    spread = dispersed(F.stddev_samp(r))
    return df.groupBy(*keys).agg(
        (F.pow(F.lit(1.0) + F.avg(r), F.lit(252.0)) - F.lit(1.0)).alias("annual_return"),
        (spread * F.sqrt(F.lit(252.0))).alias("annual_volatility"),
        (ratio(F.avg(r), spread) * F.sqrt(F.lit(252.0))).alias("sharpe"),
    )


def institutional_snapshot(holders: DataFrame, *, keys: Sequence[str], change: str) -> DataFrame:
    return holders.groupBy(*keys).agg(F.avg(finite(change)).alias("mean_change"))
