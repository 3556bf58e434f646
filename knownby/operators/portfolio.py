"""Quantile long/short portfolios over a point-in-time panel, in long format.

Weights exist only at rebalance decisions. Sessions point at the decision in
force, so holding between rebalances needs no dense session-by-security grid,
and turnover is computed only where the decision in force changes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownby.functions.numeric import dispersed, finite, ratio
from knownby.operators.pit import Instant, instant, require_columns, stored_once, unavailable, utc
from knownby.operators.scale import attach, average_rank
from knownby.operators.series import drawdown_path
from knownby.session import materialize


@dataclass(frozen=True)
class PortfolioSpec:
    feature_name: str
    start: Instant
    end: Instant
    quantiles: int = 5
    direction: str = "high"
    rebalance: str = "weekly"
    transaction_cost_bps: float = 20.0
    minimum_names: int = 20
    periods_per_year: int = 252

    def __post_init__(self) -> None:
        if not self.feature_name or utc(self.end) <= utc(self.start):
            raise ValueError("spec needs a feature and end after start")
        if not 2 <= self.quantiles <= 20 or not 0.0 <= self.transaction_cost_bps <= 1000.0:
            raise ValueError("quantiles must be 2..20 and costs 0..1000 bps")
        if self.minimum_names < 4 or self.periods_per_year < 1:
            raise ValueError("minimum_names must be at least 4")
        if self.direction not in ("high", "low") or self.rebalance not in ("daily", "weekly", "monthly"):
            raise ValueError("unknown direction or rebalance")


def rebalance_decisions(panel: DataFrame, rebalance: str) -> DataFrame:
    """Rows at the last decision of each UTC day, ISO week or month that has one.

    The panel is read twice: for the decisions of each period, then for their rows.
    """
    if rebalance == "daily":
        return panel
    period = F.date_trunc("week" if rebalance == "weekly" else "month", F.col("decision_at"))
    chosen = panel.groupBy(period.alias("__period")).agg(F.max("decision_at").alias("decision_at"))
    return panel.join(chosen.select("decision_at"), "decision_at", "left_semi")


def quantile_legs(panel: DataFrame, *, quantiles: int, direction: str = "high",
                  minimum_names: int = 20) -> DataFrame:
    """Side (+1 long, -1 short, 0 neither) of each name per decision, with skip flags.

    A decision is skipped when it has too few names or an empty leg.
    """
    unique = panel.groupBy("decision_at", "security_id").agg(
        F.max(finite("value")).alias("value"), F.count(F.lit(1)).alias("__copies")
    ).withColumn(
        "value",
        F.when(F.col("__copies") == 1, F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate security values at "), F.col("decision_at").cast("string"))).cast("double")
        ),
    ).drop("__copies")
    ranked = average_rank(unique, keys=["decision_at"], value="value", rank="__r", count="names")
    share = ratio("__r", "names")
    tail = F.lit(1.0 / quantiles)
    sign = 1 if direction == "high" else -1
    sided = ranked.withColumn("percentile", share).withColumn(
        "side",
        F.when(F.col("percentile") > F.lit(1.0) - tail, sign)
        .when(F.col("percentile") <= tail, -sign).otherwise(0),
    )
    legs = sided.groupBy("decision_at").agg(
        F.count_if(F.col("side") == 1).alias("long_names"),
        F.count_if(F.col("side") == -1).alias("short_names"),
    )
    out = attach(sided, legs, ["decision_at"]).drop("__r")
    skipped = (
        (F.col("names") < minimum_names) | (F.col("long_names") == 0) | (F.col("short_names") == 0)
    )
    return out.withColumn("skipped", skipped)


def target_weights(legs: DataFrame) -> DataFrame:
    """Equal weight within each leg; only names on a leg are kept (others weigh zero)."""
    held = legs.where("not skipped and side <> 0")
    size = F.when(F.col("side") == 1, F.col("long_names")).otherwise(F.col("short_names"))
    return held.select(
        "decision_at", "security_id", ratio(F.col("side").cast("double"), size).alias("weight")
    )


def executable_calendar(sessions: DataFrame, decisions: DataFrame, *, lag: int = 1) -> DataFrame:
    """Per session: its number, the decision in force ``lag`` sessions earlier, and the previous one.

    Decisions whose instant is not a session never trade. The table has one row
    per session of the whole study, so its window is bounded by the calendar.
    """
    if lag < 0:
        raise ValueError("lag cannot be negative")
    made = decisions.select(F.col("decision_at").alias("session")).distinct().withColumn("__d", F.lit(True))
    marked = sessions.select("session").distinct().join(made, "session", "left")
    order = Window.orderBy("session")
    in_force = F.last(F.when(F.col("__d"), F.col("session")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = marked.withColumn("session_number", F.row_number().over(order)).withColumn("__f", in_force)
    active = numbered.withColumn("active", F.lag("__f", lag).over(order) if lag else F.col("__f"))
    return active.withColumn("previous_active", F.lag("active").over(order)).drop("__d", "__f")


def portfolio_returns(calendar: DataFrame, weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Sum of weight times return per session; a missing return earns zero."""
    held = weights.withColumnRenamed("decision_at", "active")
    earned = (
        returns.join(calendar.where("active is not null").select("session", "active"), "session")
        .join(held, ["active", "security_id"])
        .groupBy("session").agg(F.sum(F.col("weight") * F.coalesce(finite("ret"), F.lit(0.0))).alias("__g"))
    )
    return attach(calendar, earned, ["session"]).withColumn(
        "gross_return", F.coalesce("__g", F.lit(0.0))
    ).drop("__g")


def portfolio_turnover(calendar: DataFrame, weights: DataFrame) -> DataFrame:
    """Half the absolute weight change per session; the first position is bought from cash."""
    changed = calendar.where(~F.col("active").eqNullSafe(F.col("previous_active")))
    incoming = changed.select("session", F.col("active").alias("decision_at"), F.lit(1.0).alias("sign"))
    outgoing = changed.select("session", F.col("previous_active").alias("decision_at"), F.lit(-1.0).alias("sign"))
    moved = (
        incoming.unionByName(outgoing).where("decision_at is not null").join(weights, "decision_at")
        .groupBy("session", "security_id").agg(F.sum(F.col("sign") * F.col("weight")).alias("__dw"))
        .groupBy("session").agg((F.lit(0.5) * F.sum(F.abs("__dw"))).alias("__t"))
    )
    return attach(calendar, moved, ["session"]).withColumn(
        "turnover", F.coalesce("__t", F.lit(0.0))
    ).drop("__t")


def linear_cost(df: DataFrame, basis_points: float) -> DataFrame:
    if basis_points < 0:
        raise ValueError("basis_points cannot be negative")
    return df.withColumn("transaction_cost", F.col("turnover") * F.lit(basis_points / 10_000.0))


def evaluate_portfolio(panel: DataFrame, returns: DataFrame, spec: PortfolioSpec) -> tuple[DataFrame, DataFrame]:
    """Per-session gross, turnover, cost and net returns, plus the legs with skip flags."""
    require_columns(panel, ["decision_at", "available_at", "security_id", "feature_name", "value"])
    start, end = instant(spec.start), instant(spec.end)
    chosen = (
        (F.col("feature_name") == spec.feature_name) & (F.col("decision_at") >= start)
        & (F.col("decision_at") <= end) & F.col("available_at").isNotNull() & finite("value").isNotNull()
    )
    # One pass over the panel: every row is checked, and one feature's decisions are stored, which are read several times below.
    decisions = stored_once(
        panel, violates=unavailable(), shown=["decision_at", "available_at"], message="rows unavailable at decision time",
        then=lambda rows: rows.where(chosen).select("decision_at", "security_id", "value"),
    )
    legs = materialize(
        quantile_legs(
            rebalance_decisions(decisions, spec.rebalance), quantiles=spec.quantiles,
            direction=spec.direction, minimum_names=spec.minimum_names,
        )
    )
    weights = target_weights(legs)
    bounded = returns.where((F.col("session") >= start) & (F.col("session") <= end))
    calendar = materialize(executable_calendar(bounded, weights))
    result = linear_cost(
        portfolio_turnover(portfolio_returns(calendar, weights, bounded), weights), spec.transaction_cost_bps
    )
    return result.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost")), legs


def summarize_performance(df: DataFrame, *, keys: list[str], order: str, value: str,
                          periods_per_year: int = 252, annual_risk_free_rate: float = 0.0) -> DataFrame:
    """Portfolio conventions: wealth floored at zero for CAGR, drawdown from the first observation."""
    r = finite(value)
    clean = df.where(r.isNotNull())
    path = drawdown_path(clean, keys=keys, order=order, value=value, start_at_one=False, name="__dd")
    wealth = F.greatest(F.product(F.lit(1.0) + r), F.lit(0.0))
    years_inverse = ratio(F.lit(float(periods_per_year)), F.count(r).cast("double"))
    volatility = F.stddev_samp(r) * F.lit(math.sqrt(periods_per_year))
    periodic = (1.0 + annual_risk_free_rate) ** (1.0 / periods_per_year) - 1.0
    return path.groupBy(*keys).agg(
        F.count(r).alias("observations"),
        (F.product(F.lit(1.0) + r) - F.lit(1.0)).alias("cumulative_return"),
        F.when(wealth > 0, F.pow(wealth, years_inverse) - F.lit(1.0)).otherwise(F.lit(-1.0)).alias("cagr"),
        F.when(F.count(r) > 1, volatility).alias("annualized_volatility"),
        ratio((F.avg(r) - F.lit(periodic)) * F.lit(float(periods_per_year)), dispersed(volatility)).alias("sharpe"),
        F.min("__dd").alias("max_drawdown"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
