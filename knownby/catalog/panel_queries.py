"""Screens and portfolio evaluation (groups K and L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownby.catalog.base import cte, cutoff_values, oracle, register, table, weekly_features, weekly_panel
from knownby.catalog.pit_queries import WEEK_AS_OF, WEEK_AT
from knownby.operators import portfolio, screens
from knownby.session import materialize

DECLINE, BREAKOUT = screens.ABNORMAL_RESIDUAL_DECLINE, screens.RELATIVE_STRENGTH_BREAKOUT
MONTHS = [f"{y}-{m:02d}-01T00:00:00+00:00" for y in (1999, 2000, 2001) for m in range(1, 11)]


@register("k1_feature_panel", oracle(
    f"SELECT {WEEK_AT} AS decision_at, security_id, feature_name, feature_version, value, effective_at, available_at, calculated_at, config_version, code_version FROM weekly_features",
    "weekly_features", "value", stamps="decision_at effective_at available_at calculated_at"))
def _(spark, sf):
    return screens.snapshots_to_panel(weekly_features(spark, sf), decision_at=WEEK_AS_OF)


_DEFS = """SELECT p_name AS feature_name, p_brand AS feature_version, p_type AS unit FROM part"""


@register("k2_redefined_features", oracle(
    f"SELECT feature_name, feature_version, count(DISTINCT unit) AS definitions FROM ({_DEFS}) GROUP BY 1, 2 HAVING count(DISTINCT unit) > 1"))
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("feature_name"), F.col("p_brand").alias("feature_version"), F.col("p_type").alias("unit"))
    return screens.redefined_features(rows)


@register("k2_pin_issues", oracle(
    """SELECT s.screen_id, s.feature_name, s.feature_version, 'unknown_version' AS issue FROM
       (VALUES ('abnormal-residual-decline-v0', 'residual_return_zscore_1d', 'price-mvp-v0'), ('abnormal-residual-decline-v0', 'dollar_volume_zscore_20d', 'price-mvp-v0'),
               ('relative-strength-breakout-v0', 'relative_return_sector_63d', 'price-mvp-v0'), ('relative-strength-breakout-v0', 'realized_volatility_20d', 'price-mvp-v0'),
               ('cheap-positive-revisions-v0', 'eps_revision_breadth_20d', 'estimates-mvp-v0'), ('cheap-positive-revisions-v0', 'forward_pe_zscore_5y', 'valuation-mvp-v0'),
               ('cheap-positive-revisions-v0', 'residual_momentum_20d', 'price-mvp-v0')) s(screen_id, feature_name, feature_version)
       WHERE NOT EXISTS (SELECT 1 FROM weekly_features f WHERE f.feature_name = s.feature_name AND f.feature_version = s.feature_version)""", "weekly_features"))
def _(spark, sf):
    registry = weekly_features(spark, sf).select("feature_name", "feature_version").distinct()
    return screens.pin_issues(screens.SHIPPED, registry)


def wide_sql(names, criteria, extra="") -> str:
    missing = " OR ".join(f"{n} IS NULL" for n in names)
    return f"SELECT *, ({missing}) AS excluded_for_missing_data, coalesce({criteria}, false) AS matches FROM {extra}"


def pivot_sql(names, where: str, group: str = "security_id") -> str:
    newest = f"""SELECT * FROM weekly_features {where} QUALIFY row_number() OVER (PARTITION BY {group}, feature_name ORDER BY available_at DESC) = 1"""
    cells = ", ".join(f"max(CASE WHEN feature_name = '{n}' THEN value END) AS {n}" for n in names)
    return f"(SELECT {group}, {cells} FROM ({newest}) WHERE feature_name IN ({', '.join(repr(n) for n in names)}) GROUP BY {group})"


_DN, _BN = list(DECLINE.features), list(BREAKOUT.features)
_DECLINE = "residual_return_zscore_1d <= -2.0 AND dollar_volume_zscore_20d >= 1.0"
_BREAK = "relative_return_sector_63d >= 0.05 AND realized_volatility_20d IS NOT NULL"


@register("k3_run_screen", oracle(
    wide_sql(_BN, _BREAK, pivot_sql(_BN, f"WHERE available_at <= {WEEK_AT}")), "weekly_features", " ".join(_BN)))
def _(spark, sf):
    return screens.run_screen(weekly_features(spark, sf), BREAKOUT, as_of=WEEK_AS_OF).drop("as_of")


@register("k3_screen_matches", oracle(
    f"""SELECT * FROM (SELECT security_id, relative_return_sector_63d, row_number() OVER (ORDER BY relative_return_sector_63d DESC NULLS LAST, security_id) AS match_rank
        FROM ({wide_sql(_BN, _BREAK, pivot_sql(_BN, f'WHERE available_at <= {WEEK_AT}'))}) WHERE matches) WHERE match_rank <= 25""",
    "weekly_features", "relative_return_sector_63d"))
def _(spark, sf):
    out = screens.run_screen(weekly_features(spark, sf), BREAKOUT, as_of=WEEK_AS_OF)
    return screens.screen_matches(out, BREAKOUT).select("security_id", "relative_return_sector_63d", "match_rank")


@register("k4_pinned_screen", oracle(
    f"""SELECT s_suppkey AS security_id, {', '.join(_BN)}, ({' OR '.join(n + ' IS NULL' for n in _BN)}) AS excluded_for_missing_data, coalesce({_BREAK}, false) AS matches
        FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT -s_suppkey - 1 FROM supplier) LEFT JOIN {pivot_sql(_BN, f"WHERE calculated_at <= {WEEK_AT} AND feature_version = 'price-mvp-v0'")} w ON w.security_id = s_suppkey""",
    "weekly_features", " ".join(_BN)))
def _(spark, sf):
    # Negative ids have no features, so the universe join has placeholders to fill.
    universe = table(spark, sf, "supplier").select(F.explode(F.array(F.col("s_suppkey"), -F.col("s_suppkey") - 1)).alias("security_id"))
    return screens.evaluate_pinned(weekly_features(spark, sf), BREAKOUT, universe, as_of=WEEK_AS_OF).drop("as_of")


@register("k5_screen_history", oracle(
    f"""SELECT as_of, security_id, {', '.join(_DN)}, ({' OR '.join(n + ' IS NULL' for n in _DN)}) AS excluded_for_missing_data, coalesce({_DECLINE}, false) AS matches
        FROM (SELECT as_of, security_id, {', '.join(f"max(CASE WHEN feature_name = '{n}' THEN value END) AS {n}" for n in _DN)}
          FROM (SELECT c.as_of, f.* FROM (VALUES {cutoff_values(MONTHS)}) c(as_of) JOIN weekly_features f ON f.available_at <= c.as_of
                QUALIFY row_number() OVER (PARTITION BY c.as_of, security_id, feature_name ORDER BY available_at DESC) = 1)
          WHERE feature_name IN ({', '.join(repr(n) for n in _DN)}) GROUP BY 1, 2)""",
    "weekly_features", " ".join(_DN), stamps="as_of"))
def _(spark, sf):
    return screens.screen_history(weekly_features(spark, sf), DECLINE, cutoffs=MONTHS)


@register("k7_shipped_screens_history_matches", oracle(
    f"""SELECT as_of, security_id, match_rank FROM (SELECT as_of, security_id, row_number() OVER (PARTITION BY as_of ORDER BY relative_return_sector_63d DESC NULLS LAST, security_id) AS match_rank
        FROM (SELECT as_of, security_id, {', '.join(f"max(CASE WHEN feature_name = '{n}' THEN value END) AS {n}" for n in _BN)}
          FROM (SELECT c.as_of, f.* FROM (VALUES {cutoff_values(MONTHS)}) c(as_of) JOIN weekly_features f ON f.available_at <= c.as_of
                QUALIFY row_number() OVER (PARTITION BY c.as_of, security_id, feature_name ORDER BY available_at DESC) = 1) GROUP BY 1, 2) WHERE {_BREAK}) WHERE match_rank <= 25""",
    "weekly_features", stamps="as_of"))
def _(spark, sf):
    out = screens.screen_history(weekly_features(spark, sf), BREAKOUT, cutoffs=MONTHS)
    return screens.screen_matches(out, BREAKOUT).select("as_of", "security_id", "match_rank")


# -- portfolios --------------------------------------------------------------

SPEC = portfolio.PortfolioSpec("residual_return_zscore_1d", "1996-01-01T00:00:00+00:00", "2001-06-30T00:00:00+00:00",
                               rebalance="monthly", periods_per_year=52)


def decision_panel(spark, sf):
    out = weekly_features(spark, sf)
    return out.select(F.col("effective_at").alias("decision_at"), F.col("effective_at").alias("available_at"), "security_id", "feature_name", "value")


def asset_returns(spark, sf):
    """Weekly returns in per mille, so compounding stays in range."""
    return weekly_panel(spark, sf).select(F.col("session_date").cast("timestamp").alias("session"), "security_id", (F.col("ret") / 1000).alias("ret"))


_BOUNDS = "BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30'"
#: The same tables within the bounds of SPEC, and (``_all``) over everything there is.
for _x, _and in (("", _BOUNDS), ("_all", "IS NOT NULL")):
    cte(f"signal{_x}", f"""SELECT CAST(session_date AS TIMESTAMP) AS decision_at, security_id, residual_return_zscore_1d AS value FROM weekly_signals
WHERE residual_return_zscore_1d IS NOT NULL AND CAST(session_date AS TIMESTAMP) {_and}""", ["weekly_signals"])
    cte(f"signal_monthly{_x}", f"""SELECT * FROM signal{_x} WHERE decision_at IN (SELECT max(decision_at) FROM signal{_x} GROUP BY date_trunc('month', decision_at))""", [f"signal{_x}"])
    cte(f"legs{_x}", f"""SELECT *, CASE WHEN percentile > 1.0 - 1.0 / 5 THEN 1 WHEN percentile <= 1.0 / 5 THEN -1 ELSE 0 END AS side FROM
(SELECT decision_at, security_id, value, count(*) OVER (PARTITION BY decision_at) AS names,
 (rank() OVER (PARTITION BY decision_at ORDER BY value) + (count(*) OVER (PARTITION BY decision_at, value) - 1) / 2.0) / count(*) OVER (PARTITION BY decision_at) AS percentile
 FROM signal_monthly{_x})""", [f"signal_monthly{_x}"])
    cte(f"legs_flagged{_x}", f"""SELECT *, names < 20 OR long_names = 0 OR short_names = 0 AS skipped FROM
(SELECT *, count(*) FILTER (WHERE side = 1) OVER (PARTITION BY decision_at) AS long_names, count(*) FILTER (WHERE side = -1) OVER (PARTITION BY decision_at) AS short_names FROM legs{_x})""", [f"legs{_x}"])
    cte(f"weights{_x}", f"SELECT decision_at, security_id, CAST(side AS DOUBLE) / CASE WHEN side = 1 THEN long_names ELSE short_names END AS weight FROM legs_flagged{_x} WHERE NOT skipped AND side <> 0", [f"legs_flagged{_x}"])
    cte(f"asset_returns{_x}", f"SELECT CAST(session_date AS TIMESTAMP) AS session, security_id, ret / 1000 AS ret FROM weekly_panel WHERE CAST(session_date AS TIMESTAMP) {_and}", ["weekly_panel"])
    cte(f"calendar{_x}", f"""SELECT *, lag(active) OVER (ORDER BY session) AS previous_active FROM
(SELECT session, lag(f) OVER (ORDER BY session) AS active FROM
 (SELECT session, last_value(d IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS f FROM
  (SELECT s.session, w.decision_at AS d FROM (SELECT DISTINCT session FROM asset_returns{_x}) s LEFT JOIN (SELECT DISTINCT decision_at FROM weights{_x}) w ON w.decision_at = s.session)))""",
        [f"asset_returns{_x}", f"weights{_x}"])
cte("portfolio", """SELECT c.session, coalesce(g.gross, 0) AS gross_return, coalesce(t.turnover, 0) AS turnover, coalesce(t.turnover, 0) * 20.0 / 10000 AS transaction_cost,
 coalesce(g.gross, 0) - coalesce(t.turnover, 0) * 20.0 / 10000 AS net_return
FROM calendar c LEFT JOIN (SELECT r.session, sum(w.weight * coalesce(r.ret, 0)) AS gross FROM asset_returns r JOIN calendar k USING (session)
  JOIN weights w ON w.decision_at = k.active AND w.security_id = r.security_id GROUP BY 1) g USING (session)
LEFT JOIN (SELECT session, 0.5 * sum(abs(dw)) AS turnover FROM (SELECT session, security_id, sum(w) AS dw FROM
  (SELECT k.session, w.security_id, w.weight AS w FROM calendar k JOIN weights w ON w.decision_at = k.active
   UNION ALL SELECT k.session, w.security_id, -w.weight FROM calendar k JOIN weights w ON w.decision_at = k.previous_active) GROUP BY 1, 2) GROUP BY 1) t USING (session)""",
    ["calendar", "weights", "asset_returns"])


@register("l1_rebalance_decisions", oracle(
    """SELECT decision_at, count(*) AS names FROM signal_all WHERE decision_at IN (SELECT max(decision_at) FROM signal_all GROUP BY extract(isoyear FROM decision_at), extract(week FROM decision_at)) GROUP BY 1""",
    "signal_all", stamps="decision_at"))
def _(spark, sf):
    return portfolio.rebalance_decisions(_signal(spark, sf), "weekly").groupBy("decision_at").agg(F.count(F.lit(1)).alias("names"))


def _signal(spark, sf):
    """The signal's known values, written once for the steps that read them several times."""
    rows = decision_panel(spark, sf).where("feature_name = 'residual_return_zscore_1d' and value is not null")
    return materialize(rows.select("decision_at", "security_id", "value"))


def _legs(spark, sf):
    return materialize(portfolio.quantile_legs(portfolio.rebalance_decisions(_signal(spark, sf), "monthly"), quantiles=5))


@register("l2_quantile_legs", oracle(
    "SELECT decision_at, security_id, value, percentile, side, names, long_names, short_names, skipped FROM legs_flagged_all", "legs_flagged_all", "value percentile", stamps="decision_at"))
def _(spark, sf):
    return _legs(spark, sf).select("decision_at", "security_id", "value", "percentile", "side", "names", "long_names", "short_names", "skipped")


@register("l3_target_weights", oracle("SELECT * FROM weights_all", "weights_all", "weight", stamps="decision_at"))
def _(spark, sf):
    return portfolio.target_weights(_legs(spark, sf))


@register("l4_executable_calendar", oracle("SELECT session, active, previous_active FROM calendar_all", "calendar_all", stamps="session active previous_active"))
def _(spark, sf):
    out = portfolio.executable_calendar(asset_returns(spark, sf), portfolio.target_weights(_legs(spark, sf)))
    return out.select("session", "active", "previous_active")


@register("l5_l7_l9_portfolio_evaluation", oracle(
    "SELECT session, gross_return, turnover, transaction_cost, net_return FROM portfolio", "portfolio", "gross_return turnover transaction_cost net_return", stamps="session"))
def _(spark, sf):
    result, _ = portfolio.evaluate_portfolio(decision_panel(spark, sf), asset_returns(spark, sf), SPEC)
    return result.select("session", "gross_return", "turnover", "transaction_cost", "net_return")


@register("l8_performance_summary", oracle(
    """SELECT 'net' AS portfolio, count(*) AS observations, product(1 + net_return) - 1 AS cumulative_return,
       CASE WHEN product(1 + net_return) > 0 THEN pow(product(1 + net_return), 52.0 / count(*)) - 1 ELSE -1 END AS cagr,
       stddev_samp(net_return) * sqrt(52) AS annualized_volatility, avg(net_return) * 52 / (stddev_samp(net_return) * sqrt(52)) AS sharpe,
       min(w / peak - 1) AS max_drawdown, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate
       FROM (SELECT *, max(w) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM
             (SELECT session, net_return, product(1 + net_return) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS w FROM portfolio))""",
    "portfolio", "cumulative_return cagr annualized_volatility sharpe max_drawdown hit_rate"))
def _(spark, sf):
    result, _ = portfolio.evaluate_portfolio(decision_panel(spark, sf), asset_returns(spark, sf), SPEC)
    return portfolio.summarize_performance(result.withColumn("portfolio", F.lit("net")), keys=["portfolio"], order="session",
                                           value="net_return", periods_per_year=52)
