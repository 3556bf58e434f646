"""Options, insider, institutional and short-interest aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownby.functions.checks import insist
from knownby.functions.numeric import finite, ratio
from knownby.operators.pit import Instant, instant, utc
from knownby.operators.scale import attach, exact_quantiles

# Wording of insider transaction types.
NOT_OPEN_MARKET = r"gift|grant|award|exercise|option|tax|withhold|conversion"
BUY_WORDING = r"open[\s_-]*market[\s_-]*purchase|purchase|\bbuy\b"
SELL_WORDING = r"open[\s_-]*market[\s_-]*sale|\bsale\b|\bsell\b"


def _warnings(*pairs: tuple[Column, str]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_sort(
        F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in pairs]))
    )


def put_call_ratios(chain: DataFrame, *, keys: Sequence[str] = ("security_id",),
                    as_of: Instant | None = None, expiry: str | None = None,
                    available: str = "available_at") -> DataFrame:
    """Volume and open-interest ratios of each side's latest snapshot.

    ``chain`` has side (call / put), expiry, volume, open_interest. Contracts are
    summed per snapshot before the latest snapshot is chosen, so the choice is
    between a few summary rows and a huge chain never meets in one task.
    """
    known = chain if as_of is None else chain.where(F.col(available) <= instant(as_of))
    chosen = F.lit(True) if expiry is None else F.to_date("expiry") == F.lit(expiry).cast("date")
    sums = []
    for field in ("volume", "open_interest"):
        number = F.when(chosen, finite(field))
        sums += [
            F.sum(F.when(number >= 0, number)).alias(field),
            (F.count_if(chosen & number.isNull()) > 0).alias(f"partial_{field}"),
            (F.count_if(number < 0) > 0).alias(f"negative_{field}"),
        ]
    snapshots = known.groupBy(*keys, "side", available).agg(
        *sums, (F.min(F.to_date("expiry")) < F.max(F.to_date("expiry"))).alias("several_expiries")
    )
    fields = [c for c in snapshots.columns if c not in (*keys, "side", available)]
    latest = snapshots.groupBy(*keys, "side").agg(
        F.max(available).alias("at"), F.max_by(F.struct(*fields), available).alias("row")
    )
    wide = latest.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(source))).alias(f"{side}_{name}")
            for side in ("call", "put")
            for source, name in [("at", "at"), *[(f"row.{f}", f) for f in fields]]
        ]
    )
    c = lambda name: F.col(f"call_{name}")
    p = lambda name: F.col(f"put_{name}")
    either = lambda name: F.coalesce(c(name), F.lit(False)) | F.coalesce(p(name), F.lit(False))
    mixed = either("several_expiries") if expiry is None else F.lit(False)
    wide = wide.withColumn(
        "warnings",
        _warnings(
            (c("at") != p("at"), "call_put_snapshot_mismatch"),
            (mixed, "multiple_expiries_aggregated"),
            (either("partial_volume"), "partial_volume"),
            (either("negative_volume"), "negative_volume_excluded"),
            (either("partial_open_interest"), "partial_open_interest"),
            (either("negative_open_interest"), "negative_open_interest_excluded"),
            (c("volume") == 0.0, "zero_call_volume"),
            (c("open_interest") == 0.0, "zero_call_open_interest"),
        ),
    )
    totals = [c("volume"), p("volume"), c("open_interest"), p("open_interest")]
    unknown = [t.isNull() for t in totals]
    status = (
        F.when(unknown[0] & unknown[1] & unknown[2] & unknown[3], "UNKNOWN")
        .when((F.size("warnings") > 0) | unknown[0] | unknown[1] | unknown[2] | unknown[3], "PARTIAL")
        .otherwise("OK")
    )
    safe = lambda a, b: F.when(b > 0, ratio(a, b))
    return wide.select(
        *keys,
        c("volume").alias("call_volume"), p("volume").alias("put_volume"),
        safe(p("volume"), c("volume")).alias("put_call_volume_ratio"),
        c("open_interest").alias("call_open_interest"), p("open_interest").alias("put_open_interest"),
        safe(p("open_interest"), c("open_interest")).alias("put_call_open_interest_ratio"),
        F.when(c("at") == p("at"), c("at")).alias("snapshot_at"),
        status.alias("status"), "warnings",
    )


def delta_risk_reversal(chain: DataFrame, *, keys: Sequence[str] = ("security_id",),
                        target_delta: float = 0.25, maximum_distance: float = 0.10,
                        minimum_open_interest: float = 0.0, tie_break: Sequence[str] = ()) -> DataFrame:
    """Implied volatility of the call nearest +delta minus the put nearest -delta."""
    insist(
        (0.0 < target_delta <= 0.5, "a skew is read at a delta of up to one half"),
        (maximum_distance > 0.0, "some distance from the delta has to be allowed"),
    )
    delta, iv = finite("delta"), finite("implied_volatility")
    liquid = (iv > 0) & delta.isNotNull()
    if minimum_open_interest > 0.0:
        liquid = liquid & (finite("open_interest") >= minimum_open_interest)
    target = F.when(F.col("side") == "call", F.lit(target_delta)).otherwise(F.lit(-target_delta))
    distance = F.when(liquid, F.abs(delta - target))
    picks = []
    for side in ("call", "put"):
        on_side = F.when(F.col("side") == side, distance)
        nearest = F.when(on_side.isNotNull(), F.struct(on_side.alias("d"), *tie_break))
        picks.append(
            F.min_by(F.struct(delta.alias("delta"), iv.alias("iv"), distance.alias("distance")), nearest).alias(side)
        )
    best = chain.groupBy(*keys).agg(*picks)
    missing = F.col("call").isNull() | F.col("put").isNull()
    distant = (F.col("call.distance") > maximum_distance) | (F.col("put.distance") > maximum_distance)
    ok = ~missing & ~distant
    return best.select(
        *keys, F.lit(target_delta).alias("target_delta"),
        F.when(ok, F.col("call.delta")).alias("call_delta"),
        F.when(ok, F.col("put.delta")).alias("put_delta"),
        F.when(ok, F.col("call.iv")).alias("call_implied_volatility"),
        F.when(ok, F.col("put.iv")).alias("put_implied_volatility"),
        F.when(ok, F.col("call.iv") - F.col("put.iv")).alias("call_minus_put_iv"),
        F.when(ok, "OK").otherwise("UNKNOWN").alias("status"),
        F.when(missing, "no_liquid_delta_match").when(distant, "delta_match_too_distant").alias("warning"),
    )


def select_target_expiry(chain: DataFrame, *, keys: Sequence[str] = ("security_id",), as_of: Instant,
                         target_days: int = 30, minimum_days: int = 7) -> DataFrame:
    """Eligible expiry nearest the target maturity; ties go to the earlier one."""
    insist((0 <= minimum_days <= target_days, "the wanted maturity lies below the shortest one allowed, or in the past"))
    expiry = F.to_date("expiry")
    days = F.datediff(expiry, F.lit(utc(as_of).date()))
    rank = F.when(days >= minimum_days, F.struct(F.abs(days - target_days).alias("d"), expiry.alias("e")))
    return chain.groupBy(*keys).agg(F.min_by(expiry, rank).alias("target_expiry"))


def implied_realized_spread(implied: Column | str, realized: Column | str) -> Column:
    return finite(implied) - finite(realized)


def insider_activity(transactions: DataFrame, *, keys: Sequence[str] = ("security_id",), as_of: Instant,
                     lookback_days: int = 365, action: str = "transaction_type", value: str = "value",
                     available: str = "available_at") -> DataFrame:
    """Classified open-market buys and sells knowable in the window ending at the cutoff."""
    insist((lookback_days > 0, "trades are gathered over one day at least"))
    cutoff = utc(as_of)
    window = transactions.where(
        (F.col(available) <= instant(cutoff))
        & (F.col(available) >= instant(cutoff - timedelta(days=lookback_days)))
    )
    text = F.coalesce(F.lower(F.col(action)), F.lit(""))
    kept = ~text.rlike(NOT_OPEN_MARKET)
    buy, sell = kept & text.rlike(BUY_WORDING), kept & text.rlike(SELL_WORDING)
    amount = F.abs(finite(value))
    rows = window.select(*keys, buy.alias("buy"), sell.alias("sell"), amount.alias("amount"))
    agg = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("buy"), F.col("amount"))).alias("__buy"),
        F.sum(F.when(F.col("sell"), F.col("amount"))).alias("__sell"),
        F.count_if(F.col("buy") | F.col("sell")).alias("classified_transactions"),
        F.count_if(~(F.col("buy") | F.col("sell"))).alias("unclassified_transactions"),
        (F.count_if((F.col("buy") | F.col("sell")) & F.col("amount").isNull()) > 0).alias("__gap"),
    )
    # A security with transactions outside the window only is reported as unknown.
    base = attach(transactions.select(*keys).distinct(), agg, keys)
    empty = F.col("classified_transactions").isNull()
    unknown = empty | (F.col("__buy").isNull() & F.col("__sell").isNull())
    bought, sold = F.coalesce("__buy", F.lit(0.0)), F.coalesce("__sell", F.lit(0.0))
    odds = F.when(sold > 0, ratio(bought, sold)).when(bought > 0, F.lit(float("inf")))
    warnings = _warnings(
        (empty, "no_transactions_in_window"),
        (F.col("__gap"), "classified_transactions_missing_value"),
        (unknown & ~empty, "no_classified_open_market_transactions"),
        (~unknown & (F.col("unclassified_transactions") > 0), "unclassified_transactions_present"),
    )
    return base.select(
        *keys,
        F.when(~unknown, bought).alias("buy_value"),
        F.when(~unknown, sold).alias("sell_value"),
        F.when(~unknown, bought - sold).alias("net_value"),
        F.when(~unknown, odds).alias("buy_sell_ratio"),
        F.coalesce("classified_transactions", F.lit(0)).alias("classified_transactions"),
        F.coalesce("unclassified_transactions", F.lit(0)).alias("unclassified_transactions"),
        F.when(unknown, "UNKNOWN").when(F.size(warnings) > 0, "PARTIAL").otherwise("OK").alias("status"),
        warnings.alias("warnings"),
    )


def institutional_position_change(holders: DataFrame, *, keys: Sequence[str] = ("security_id",),
                                  change: str = "share_change") -> DataFrame:
    """Holder changes per security; the median is exact for any number of holders."""
    x = finite(change)
    base = holders.groupBy(*keys).agg(
        F.count(x).alias("observations"), F.avg(x).alias("mean_share_change"),
        F.sum(x).alias("total_share_change"), F.count(F.lit(1)).alias("__rows"),
    )
    middle = exact_quantiles(holders, keys=keys, value=change, quantiles={"median_share_change": 0.5})
    status = (
        F.when(F.col("observations") == 0, "UNKNOWN")
        .when(F.col("observations") < F.col("__rows"), "PARTIAL").otherwise("OK")
    )
    return attach(base, middle, keys).select(
        *keys, "observations", "mean_share_change", "median_share_change", "total_share_change",
        status.alias("status"),
    )


def short_interest_metrics(df: DataFrame, *, shares_short: str = "shares_short",
                           short_percent_of_float: str = "short_percent_of_float",
                           days_to_cover: str = "days_to_cover",
                           prior: str = "shares_short_prior") -> DataFrame:
    """Range-checked short metrics; the share of float is a fraction of at most one."""
    within = lambda c, top=None: F.when(
        (finite(c) >= 0) & (F.lit(True) if top is None else finite(c) <= top), finite(c)
    )
    out = df.withColumns(
        {
            "shares_short": within(shares_short),
            "short_percent_of_float": within(short_percent_of_float, 1.0),
            "days_to_cover": within(days_to_cover),
            "shares_short_prior": within(prior),
        }
    )
    change = F.col("shares_short") - F.col("shares_short_prior")
    known = sum(
        (F.col(c).isNotNull().cast("int") for c in
         ("shares_short", "short_percent_of_float", "days_to_cover", "shares_short_prior")),
        start=F.lit(0),
    )
    return out.withColumn("change_in_shares_short", change).withColumn(
        "change_percent", ratio(change, "shares_short_prior")
    ).withColumn(
        "status", F.when(known == 0, "UNKNOWN").when(known < 4, "PARTIAL").otherwise("OK")
    )
