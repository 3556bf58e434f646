"""Returns, risk and anomaly queries (groups C, D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownby.catalog.base import bars_daily, cte, daily_returns, oracle, register, weekly_panel
from knownby.functions.numeric import finite
from knownby.operators import panels, series

K, T = ["security_id"], "session_date"
W = "OVER (PARTITION BY security_id ORDER BY session_date)"
CUM = "OVER (PARTITION BY security_id ORDER BY session_date ROWS UNBOUNDED PRECEDING)"


def frame(lo: int, hi: int) -> str:
    return f"OVER (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"


@register("c1_simple_returns", oracle(
    f"SELECT security_id, session_date, close / nullif(lag(close, 2) {W}, 0) - 1 AS simple_return FROM bars_daily",
    "bars_daily", "simple_return", "session_date"))
def _(spark, sf):
    out = series.simple_returns(bars_daily(spark, sf), keys=K, order=T, value="close", periods=2)
    return out.select("security_id", T, "simple_return")


@register("c2_log_returns", oracle(
    f"""SELECT security_id, session_date, ln(p / lag(p) {W}) AS log_return
        FROM (SELECT *, CASE WHEN close > 0 THEN close END AS p FROM bars_daily)""",
    "bars_daily", "log_return", "session_date"))
def _(spark, sf):
    return series.log_returns(bars_daily(spark, sf), keys=K, order=T, value="close").select("security_id", T, "log_return")


_H = (1, 2, 5, 20, 63, 126, 252)


@register("c3_horizon_returns", oracle(
    "SELECT security_id, session_date, " + ", ".join(
        f"close / nullif(lag(close, {h}) {W}, 0) - 1 AS return_{h}" for h in _H) + " FROM weekly_panel",
    "weekly_panel", " ".join(f"return_{h}" for h in _H), "session_date"))
def _(spark, sf):
    out = series.horizon_returns(weekly_panel(spark, sf), keys=K, order=T, value="close")
    return out.select("security_id", T, *[f"return_{h}" for h in _H])


@register("c4_compound_returns", oracle(
    "SELECT security_id, product(1 + ret) - 1 AS compound_return FROM daily_returns GROUP BY 1",
    "daily_returns", "compound_return", digits=3), digits=3)
def _(spark, sf):
    r = finite("ret")
    return daily_returns(spark, sf).groupBy("security_id").agg(series.compounded(r).alias("compound_return"))


@register("c5_rolling_total_return", oracle(
    f"""SELECT security_id, session_date,
        CASE WHEN count(ret) {frame(19, 0)} >= 15 THEN product(1 + ret) {frame(19, 0)} - 1 END AS rolling_return
        FROM weekly_panel""", "weekly_panel", "rolling_return", "session_date"))
def _(spark, sf):
    out = series.rolling_total_return(weekly_panel(spark, sf), keys=K, order=T, value="ret", window=20, minimum=15)
    return out.select("security_id", T, "rolling_return")


@register("c6_overnight_gap", oracle(
    f"SELECT security_id, session_date, open / nullif(lag(close) {W}, 0) - 1 AS overnight_gap FROM bars_daily",
    "bars_daily", "overnight_gap", "session_date"))
def _(spark, sf):
    return series.overnight_gap(bars_daily(spark, sf), keys=K, order=T).select("security_id", T, "overnight_gap")


@register("c7_intraday_return", oracle(
    "SELECT security_id, session_date, close / nullif(open, 0) - 1 AS intraday_return FROM bars_daily",
    "bars_daily", "intraday_return", "session_date"))
def _(spark, sf):
    return series.intraday_return(bars_daily(spark, sf)).select("security_id", T, "intraday_return")


@register("c8_relative_return", oracle(
    "SELECT security_id, session_date, (1 + ret) / nullif(1 + mkt_ret, 0) - 1 AS relative_return FROM weekly_panel",
    "weekly_panel", "relative_return", "session_date"))
def _(spark, sf):
    out = series.relative_return(weekly_panel(spark, sf), asset="ret", benchmark="mkt_ret")
    return out.select("security_id", T, "relative_return")


@register("c9_relative_strength", oracle(
    f"""SELECT security_id, session_date,
        CASE WHEN sum(CASE WHEN rel IS NULL THEN 1 ELSE 0 END) {CUM} = 0 THEN 100 * product(1 + rel) {CUM} END AS relative_strength
        FROM (SELECT *, CASE WHEN row_number() {W} = 1 THEN 0 ELSE (1 + ret) / nullif(1 + mkt_ret, 0) - 1 END AS rel FROM weekly_panel)""",
    "weekly_panel", "relative_strength", "session_date"))
def _(spark, sf):
    # The first session is the base: it has no return of its own.
    base = F.row_number().over(series.sessions(K, T)) == 1
    rows = weekly_panel(spark, sf)
    rows = rows.withColumns({c: F.when(base, F.lit(0.0)).otherwise(F.col(c)) for c in ("ret", "mkt_ret")})
    out = series.relative_strength(rows, keys=K, order=T, asset="ret", benchmark="mkt_ret", base=100.0)
    return out.select("security_id", T, "relative_strength")


@register("c10_c14_return_summary", oracle(
    """SELECT security_id, count(ret) AS observations, product(1 + ret) - 1 AS cumulative_return,
       CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / nullif(count(ret), 0)) - 1
            WHEN product(1 + ret) = 0 THEN -1 END AS cagr,
       avg(ret) * 252 AS arithmetic_return, stddev_samp(ret) * sqrt(252) AS volatility,
       CASE WHEN stddev_samp(ret) * sqrt(252) > 1e-12
            THEN (avg(ret) - (pow(1.02, 1.0 / 252) - 1)) * 252 / (stddev_samp(ret) * sqrt(252)) END AS sharpe,
       avg(CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END) AS hit_rate
       FROM weekly_panel GROUP BY 1""",
    "weekly_panel", "cumulative_return cagr arithmetic_return volatility sharpe hit_rate"))
def _(spark, sf):
    return series.summarize_returns(weekly_panel(spark, sf), keys=K, value="ret", annual_risk_free_rate=0.02)


@register("d1_rolling_volatility", oracle(
    f"""SELECT security_id, session_date, CASE WHEN count(ret) {frame(62, 0)} >= 30
        THEN stddev_samp(ret) {frame(62, 0)} * sqrt(252) END AS rolling_volatility FROM weekly_panel""",
    "weekly_panel", "rolling_volatility", "session_date"))
def _(spark, sf):
    out = series.rolling_volatility(weekly_panel(spark, sf), keys=K, order=T, value="ret", window=63, minimum=30)
    return out.select("security_id", T, "rolling_volatility")


_RISK = """
SELECT p.security_id, count(p.ret) AS observations, stddev_samp(p.ret) * sqrt(252) AS volatility,
  sqrt(sum(pow(CASE WHEN p.ret IS NOT NULL THEN least(p.ret, 0) END, 2)) / nullif(count(p.ret), 0)) * sqrt(252) AS downside_deviation,
  least(min(p.w / p.peak - 1), 0) AS maximum_drawdown,
  greatest(0, -any_value(q.q)) AS value_at_risk,
  greatest(0, -avg(CASE WHEN p.ret <= q.q THEN p.ret END)) AS expected_shortfall
FROM (SELECT *, greatest(max(w) OVER (PARTITION BY security_id ORDER BY session_date ROWS UNBOUNDED PRECEDING), 1) AS peak
      FROM (SELECT security_id, session_date, ret, CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER
            (PARTITION BY security_id ORDER BY session_date ROWS UNBOUNDED PRECEDING) END AS w FROM weekly_panel)) p
JOIN (SELECT security_id, quantile_cont(ret, 0.05) AS q FROM weekly_panel GROUP BY 1) q USING (security_id)
GROUP BY 1"""


@register("d2_d7_risk_summary", oracle(
    _RISK, "weekly_panel", "volatility downside_deviation maximum_drawdown value_at_risk expected_shortfall"))
def _(spark, sf):
    return series.summarize_risk(weekly_panel(spark, sf), keys=K, order=T, value="ret")


@register("d6_beta_estimate", oracle(
    """SELECT security_id, count(*) AS observations, avg(ret) - covar_samp(ret, mkt_ret) / var_samp(mkt_ret) * avg(mkt_ret) AS alpha,
       covar_samp(ret, mkt_ret) / var_samp(mkt_ret) AS beta, corr(ret, mkt_ret) AS correlation,
       corr(ret, mkt_ret) * corr(ret, mkt_ret) AS r_squared
       FROM weekly_panel WHERE ret IS NOT NULL AND mkt_ret IS NOT NULL GROUP BY 1""",
    "weekly_panel", "alpha beta correlation r_squared"))
def _(spark, sf):
    return series.beta_estimate(weekly_panel(spark, sf), keys=K, asset="ret", benchmark="mkt_ret")


def zscore_sql(x: str, window: int, minimum: int, spread: str = "stddev_samp") -> str:
    f = frame(window, 1)
    return (f"CASE WHEN count({x}) {f} >= {minimum} AND {spread}({x}) {f} > 1e-12 "
            f"THEN ({x} - avg({x}) {f}) / {spread}({x}) {f} END")


@register("e1_e5_rolling_zscore_flags", oracle(
    f"""SELECT *, abs(zscore) >= 2.0 AS is_anomaly FROM
        (SELECT security_id, session_date, {zscore_sql('ret', 63, 30)} AS zscore FROM weekly_panel)""",
    "weekly_panel", "zscore", "session_date"))
def _(spark, sf):
    out = series.rolling_zscore(weekly_panel(spark, sf), keys=K, order=T, value="ret", window=63, minimum=30)
    return series.anomaly_flags(out, score="zscore").select("security_id", T, "zscore", "is_anomaly")


@register("e2_volume_zscore", oracle(
    f"""SELECT security_id, session_date, {zscore_sql('lv', 63, 30)} AS volume_zscore
        FROM (SELECT *, ln(1 + volume) AS lv FROM weekly_panel)""",
    "weekly_panel", "volume_zscore", "session_date"))
def _(spark, sf):
    out = series.volume_zscore(weekly_panel(spark, sf), keys=K, order=T, volume="volume", window=63, minimum=30)
    return out.select("security_id", T, "volume_zscore")


_F = frame(126, 1)
cte("one_factor", f"""
SELECT *, CASE WHEN n >= 63 AND vx > 1e-26 * mx * mx AND mkt_ret IS NOT NULL THEN cxy / vx END AS b
FROM (SELECT security_id, session_date, ret, mkt_ret, count(y) {_F} AS n, avg(y) {_F} AS my, avg(x) {_F} AS mx,
        var_samp(y) {_F} AS vy, var_samp(x) {_F} AS vx, covar_samp(y, x) {_F} AS cxy
      FROM (SELECT *, CASE WHEN ret IS NOT NULL AND mkt_ret IS NOT NULL THEN ret END AS y,
                      CASE WHEN ret IS NOT NULL AND mkt_ret IS NOT NULL THEN mkt_ret END AS x FROM weekly_panel))""",
    ["weekly_panel"])


@register("e3_abnormal_returns_one_factor", oracle(
    """SELECT security_id, session_date, my + b * (mkt_ret - mx) AS expected_return,
       ret - (my + b * (mkt_ret - mx)) AS residual_return,
       CASE WHEN b IS NOT NULL THEN sqrt(greatest((n - 1) * (vy - b * cxy) / (n - 2), 0)) END AS residual_volatility,
       CASE WHEN b IS NOT NULL THEN (ret - (my + b * (mkt_ret - mx))) / nullif(sqrt(greatest((n - 1) * (vy - b * cxy) / (n - 2), 0)), 0) END AS abnormal_score,
       my - b * mx AS coef_intercept, b AS coef_mkt_ret FROM one_factor""",
    "one_factor", "expected_return residual_return residual_volatility abnormal_score coef_intercept coef_mkt_ret",
    "session_date"))
def _(spark, sf):
    out = series.abnormal_returns(weekly_panel(spark, sf), keys=K, order=T, asset="ret", factors=["mkt_ret"])
    return out.select("security_id", T, "expected_return", "residual_return", "residual_volatility", "abnormal_score",
                      "coef_intercept", "coef_mkt_ret")


def two_factor_sql(source: str, y: str = "ret", a: str = "mkt_ret", b: str = "sec_ret", keep: str = "") -> str:
    """Closed-form two-factor rolling fit over ``source`` (126-row training frame)."""
    ok = f"{y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL"
    return f"""
SELECT *, CASE WHEN fit THEN my - b1 * m1 - b2 * m2 END AS b0,
  CASE WHEN fit THEN sqrt(greatest((n - 1) * (vy - b1 * c1 - b2 * c2) / (n - 3), 0)) END AS sigma
FROM (SELECT *, CASE WHEN fit THEN (c1 * v2 - c2 * c12) / det END AS b1, CASE WHEN fit THEN (c2 * v1 - c1 * c12) / det END AS b2
 FROM (SELECT *, v1 * v2 - c12 * c12 AS det,
   n >= 63 AND {a} IS NOT NULL AND {b} IS NOT NULL AND v1 > 1e-26 * m1 * m1 AND v2 > 1e-26 * m2 * m2 AND v2 - c12 * c12 / nullif(v1, 0) > 1e-12 * v2 AS fit
  FROM (SELECT *, count(yy) {_F} AS n, avg(yy) {_F} AS my, avg(x1) {_F} AS m1, avg(x2) {_F} AS m2,
    var_samp(yy) {_F} AS vy, var_samp(x1) {_F} AS v1, var_samp(x2) {_F} AS v2,
    covar_samp(yy, x1) {_F} AS c1, covar_samp(yy, x2) {_F} AS c2, covar_samp(x1, x2) {_F} AS c12
   FROM (SELECT *, CASE WHEN {ok} THEN {y} END AS yy, CASE WHEN {ok} THEN {a} END AS x1, CASE WHEN {ok} THEN {b} END AS x2
         FROM {source}))))"""


cte("two_factor", two_factor_sql("weekly_panel"), ["weekly_panel"])


@register("e3_abnormal_returns_two_factors", oracle(
    """SELECT security_id, session_date, b0 + b1 * mkt_ret + b2 * sec_ret AS expected_return,
       ret - (b0 + b1 * mkt_ret + b2 * sec_ret) AS residual_return, sigma AS residual_volatility,
       (ret - (b0 + b1 * mkt_ret + b2 * sec_ret)) / nullif(sigma, 0) AS abnormal_score FROM two_factor""",
    "two_factor", "expected_return residual_return residual_volatility abnormal_score", "session_date"))
def _(spark, sf):
    out = series.abnormal_returns(weekly_panel(spark, sf), keys=K, order=T, asset="ret", factors=["mkt_ret", "sec_ret"])
    return out.select("security_id", T, "expected_return", "residual_return", "residual_volatility", "abnormal_score")


def general_fit_sql(source: str, y: str, factors: list[str]) -> str:
    """Rolling least squares of any number of factors by elimination over ``source`` (126-row training frame)."""
    k = range(1, len(factors) + 1)
    values = [y, *factors]
    ok = " AND ".join(f"{v} IS NOT NULL" for v in values)
    sql = "SELECT *, " + ", ".join(f"CASE WHEN {ok} THEN {v} END AS v{i}" for i, v in enumerate(values)) + f" FROM ({source})"
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    sql = f"SELECT *, count(v0) {_F} AS n, " + ", ".join(f"avg(v{i}) {_F} AS m{i}" for i in range(len(values))) + ", " + ", ".join(f"covar_pop(v{i}, v{j}) {_F} AS c{i}_{j}" for i, j in pairs) + f" FROM ({sql})"
    sql = "SELECT *, true AS full_rank, " + ", ".join(f"c{i}_{i} AS own{i}" for i in range(len(values))) + f" FROM ({sql})"
    name = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    for p in k:
        rest = [0, *range(p + 1, len(values))]
        sql = f"SELECT *, " + ", ".join(f"{name(p, i)} / nullif(c{p}_{p}, 0) AS f{p}_{i}" for i in rest) + f" FROM ({sql})"
        swap = [f"{name(i, j)} - f{p}_{i} * {name(p, j)} AS {name(i, j)}" for i, j in pairs if i in rest and j in rest]
        swap.append(f"full_rank AND coalesce(own{p} > 1e-26 * m{p} * m{p} AND c{p}_{p} > 1e-12 * own{p}, false) AS full_rank")
        sql = f"SELECT * REPLACE ({', '.join(swap)}) FROM ({sql})"
    current = " AND ".join(f"{f} IS NOT NULL" for f in factors)
    for p in reversed(k):
        slope = f"f{p}_0" + "".join(f" - f{p}_{j} * b{j}" for j in range(p + 1, len(values)))
        sql = f"SELECT *, CASE WHEN full_rank AND n >= 63 AND {current} THEN {slope} END AS b{p} FROM ({sql})"
    shift = "".join(f" + b{i} * ({f} - m{i})" for i, f in enumerate(factors, start=1))
    return f"SELECT *, m0{shift} AS expected, CASE WHEN c0_0 > 1e-14 * own0 THEN sqrt(c0_0 * n / (n - {len(values)})) END AS sigma FROM ({sql})"


@register("e3_abnormal_returns_general", oracle(
    f"""SELECT security_id, session_date, expected AS expected_return, ret - expected AS residual_return, (ret - expected) / sigma AS abnormal_score
        FROM ({general_fit_sql("SELECT *, ln(volume) AS vol_change FROM weekly_panel", "ret", ["mkt_ret", "sec_ret", "vol_change"])})""",
    "weekly_panel", "expected_return residual_return abnormal_score", "session_date"))
def _(spark, sf):
    work = weekly_panel(spark, sf).withColumn("vol_change", F.ln("volume"))
    work = work.select("security_id", T, "ret", "mkt_ret", "sec_ret", "vol_change")
    out = series.abnormal_returns(work, keys=K, order=T, asset="ret", factors=["mkt_ret", "sec_ret", "vol_change"])
    return out.select("security_id", T, "expected_return", "residual_return", "abnormal_score")


@register("e4_abnormal_fit_warnings", oracle(
    """SELECT security_id, CASE WHEN bool_or(n >= 63 AND mkt_ret IS NOT NULL AND NOT (vx > 1e-26 * mx * mx))
       THEN 'rank_deficient_training_windows_skipped' ELSE '' END AS warnings FROM one_factor GROUP BY 1""", "one_factor"))
def _(spark, sf):
    out = series.abnormal_returns(weekly_panel(spark, sf), keys=K, order=T, asset="ret", factors=["mkt_ret"])
    return series.abnormal_fit_warnings(out, keys=K)


@register("e6_winsorize", oracle(
    """SELECT p.security_id, p.session_date, CASE WHEN q.n >= 5 AND p.ret IS NOT NULL
       THEN greatest(least(p.ret, q.hi), q.lo) END AS winsorized
       FROM weekly_panel p JOIN (SELECT session_date, count(ret) AS n, quantile_cont(ret, 0.05) AS lo,
       quantile_cont(ret, 0.95) AS hi FROM weekly_panel GROUP BY 1) q USING (session_date)""",
    "weekly_panel", "winsorized", "session_date"))
def _(spark, sf):
    out = panels.winsorize(weekly_panel(spark, sf), keys=[T], value="ret", lower=0.05, upper=0.95)
    return out.select("security_id", T, "winsorized")


_G = "OVER (PARTITION BY session_date, region)"


@register("e7_sector_neutral_zscore", oracle(
    f"""SELECT security_id, session_date, CASE WHEN count(ret) {_G} >= 5 AND stddev_pop(ret) {_G} > 1e-12
        THEN (ret - avg(ret) {_G}) / stddev_pop(ret) {_G} END AS zscore FROM weekly_panel""",
    "weekly_panel", "zscore", "session_date"))
def _(spark, sf):
    out = panels.cross_sectional_zscore(weekly_panel(spark, sf), keys=[T], value="ret", groups="region")
    return out.select("security_id", T, "zscore")


_D = "OVER (PARTITION BY session_date)"


@register("e8_normalize_factor", oracle(
    f"""SELECT security_id, session_date, raw, winsorized,
        CASE WHEN count(winsorized) {_D} >= 5 AND stddev_pop(winsorized) {_D} > 1e-12
             THEN (winsorized - avg(winsorized) {_D}) / stddev_pop(winsorized) {_D} END AS zscore,
        CASE WHEN winsorized IS NOT NULL THEN
          (rank() OVER (PARTITION BY session_date ORDER BY winsorized NULLS LAST)
           + (count(*) OVER (PARTITION BY session_date, winsorized) - 1) / 2.0) / count(winsorized) {_D} END AS percentile
        FROM (SELECT p.security_id, p.session_date, p.ret AS raw, CASE WHEN q.n >= 5 AND p.ret IS NOT NULL
              THEN greatest(least(p.ret, q.hi), q.lo) END AS winsorized
              FROM weekly_panel p JOIN (SELECT session_date, count(ret) AS n, quantile_cont(ret, 0.01) AS lo,
              quantile_cont(ret, 0.99) AS hi FROM weekly_panel GROUP BY 1) q USING (session_date))""",
    "weekly_panel", "raw winsorized zscore percentile", "session_date"))
def _(spark, sf):
    out = panels.normalize_factor(weekly_panel(spark, sf).select("security_id", T, "ret"), keys=[T], value="ret")
    return out.select("security_id", T, "raw", "winsorized", "zscore", "percentile")


@register("e9_e10_momentum_reversal", oracle(
    f"""SELECT security_id, session_date, lag(close, 21) {W} / nullif(lag(close, 252) {W}, 0) - 1 AS momentum_12_1,
        -(close / nullif(lag(close, 21) {W}, 0) - 1) AS short_term_reversal FROM weekly_panel""",
    "weekly_panel", "momentum_12_1 short_term_reversal", "session_date"))
def _(spark, sf):
    out = series.momentum(weekly_panel(spark, sf), keys=K, order=T, value="close")
    out = series.short_term_reversal(out, keys=K, order=T, value="close")
    return out.select("security_id", T, "momentum_12_1", "short_term_reversal")


@register("e11_rolling_beta", oracle(
    f"""SELECT security_id, session_date, CASE WHEN n >= 63 AND m >= 63 AND v > 1e-26 * l * l THEN c / v END AS rolling_beta
        FROM (SELECT security_id, session_date, count(y) {_F} AS n, count(mkt_ret) {_F} AS m,
              covar_samp(y, x) {_F} AS c, var_samp(mkt_ret) {_F} AS v, avg(mkt_ret) {_F} AS l
              FROM (SELECT *, CASE WHEN ret IS NOT NULL AND mkt_ret IS NOT NULL THEN ret END AS y,
                    CASE WHEN ret IS NOT NULL AND mkt_ret IS NOT NULL THEN mkt_ret END AS x FROM weekly_panel))""",
    "weekly_panel", "rolling_beta", "session_date"))
def _(spark, sf):
    out = series.rolling_beta(weekly_panel(spark, sf), keys=K, order=T, asset="ret", benchmark="mkt_ret")
    return out.select("security_id", T, "rolling_beta")


@register("e12_factor_exposures", oracle(
    "SELECT security_id, session_date, b0 AS coef_intercept, b1 AS coef_mkt_ret, b2 AS coef_sec_ret FROM two_factor",
    "two_factor", "coef_intercept coef_mkt_ret coef_sec_ret", "session_date"))
def _(spark, sf):
    return series.rolling_factor_exposures(weekly_panel(spark, sf), keys=K, order=T, asset="ret", factors=["mkt_ret", "sec_ret"])


@register("e13_residual_momentum", oracle(
    f"""SELECT security_id, session_date, CASE WHEN count(r) {frame(19, 0)} >= 20 THEN product(1 + r) {frame(19, 0)} - 1 END AS residual_momentum
        FROM (SELECT security_id, session_date, (ret - (my + b * (mkt_ret - mx))) / 1000 AS r FROM one_factor)""",
    "one_factor", "residual_momentum", "session_date"))
def _(spark, sf):
    fit = series.abnormal_returns(weekly_panel(spark, sf), keys=K, order=T, asset="ret", factors=["mkt_ret"])
    # The proxy's residuals reach several hundred; per mille keeps twenty-fold products finite.
    fit = fit.withColumn("residual_return", F.col("residual_return") / 1000)
    out = series.residual_momentum(fit, keys=K, order=T, value="residual_return")
    return out.select("security_id", T, "residual_momentum")


@register("e14_configured_signals", oracle(
    f"""SELECT security_id, session_date, CASE WHEN count(ret) {frame(62, 0)} >= 63 THEN -stddev_samp(ret) {frame(62, 0)} * sqrt(252) END AS low_volatility,
        -(close / nullif(lag(close, 5) {W}, 0) - 1) AS reversal_5 FROM weekly_panel""",
    "weekly_panel", "low_volatility reversal_5", "session_date"))
def _(spark, sf):
    out = series.low_volatility(weekly_panel(spark, sf), keys=K, order=T, value="ret")
    out = series.short_term_reversal(out, keys=K, order=T, value="close", horizon=5, name="reversal_5")
    return out.select("security_id", T, "low_volatility", "reversal_5")


@register("e15_finite_coercion", oracle(
    """SELECT event_id, CASE WHEN isfinite(x) THEN x END AS finite_value
       FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE WHEN event_type = 'view' THEN 'inf'::DOUBLE ELSE value END AS x FROM events)""",
    "", "finite_value"))
def _(spark, sf):
    from knownby.catalog.base import table

    raw = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "view", F.lit(float("inf"))).otherwise(F.col("value"))
    )
    return table(spark, sf, "events").select("event_id", finite(raw).alias("finite_value"))
