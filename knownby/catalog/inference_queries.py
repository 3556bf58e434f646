"""Statistical tests and seasonality (group J), and the exploratory tables (group P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownby.catalog.base import bars_daily, cte, daily_returns, oracle, register, table, weekly_panel
from knownby.catalog.domain_queries import chain, company_events, transactions, week_bars
from knownby.operators import inference, naive

K, T = ["security_id"], "session_date"


def p_sql(t: str, df: str) -> str:
    """Two-sided Student-t probability by Simpson's rule on the angle atan(t / sqrt(df))."""
    nodes = 2000
    density = f"pow(cos(atan(abs({t}) / sqrt({df})) * k / {nodes}.0), {df} - 1)"
    weight = f"CASE WHEN k IN (0, {nodes}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum([{weight} * {density} for k in range(0, {nodes + 1})]) * atan(abs({t}) / sqrt({df})) / {nodes} / 3"
    return f"1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * ({area})"


@register("j1_descriptive_statistics", oracle(
    """SELECT security_id, count(ret) AS observations, avg(ret) AS mean, stddev_samp(ret) AS standard_deviation,
       avg(CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END) AS win_rate, min(ret) AS minimum, max(ret) AS maximum, quantile_cont(ret, 0.5) AS median
       FROM weekly_panel GROUP BY 1""", "weekly_panel", "mean standard_deviation win_rate minimum maximum median"))
def _(spark, sf):
    return inference.descriptive_statistics(weekly_panel(spark, sf), keys=K, value="ret")


cte("iid", """SELECT security_id, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) / sqrt(count(ret)) AS se, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t
FROM daily_returns GROUP BY 1""", ["daily_returns"])


@register("j2_mean_test_iid", oracle(
    f"""SELECT security_id, n AS observations, m AS estimate, CASE WHEN n >= 20 THEN se END AS standard_error, CASE WHEN n >= 20 THEN t END AS statistic,
        CASE WHEN n >= 20 THEN {p_sql('t', '(n - 1.0)')} END AS p_value, n >= 20 AS valid, CASE WHEN n < 20 THEN 'insufficient_observations' END AS warning FROM iid""",
    "iid", "estimate standard_error statistic p_value"))
def _(spark, sf):
    out = inference.mean_test_iid(daily_returns(spark, sf), keys=K, value="ret")
    return out.drop("method", "confidence_lower", "confidence_upper")


#: The critical value of each number of degrees of freedom, by halving an interval on the tail probability above.
_HALVED = f"""WITH RECURSIVE halved AS (
  SELECT DISTINCT n - 1.0 AS df, CAST(0 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi, 0 AS step FROM iid WHERE n >= 20
  UNION ALL SELECT df, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, step + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, {p_sql('((lo + hi) / 2)', 'df')} AS p FROM halved WHERE step < 50))
  SELECT df, (lo + hi) / 2 AS t FROM halved WHERE step = 50"""


@register("j2_confidence_intervals", oracle(
    f"""SELECT i.security_id, i.m AS estimate, CASE WHEN i.n >= 20 THEN i.m - c.t * i.se END AS confidence_lower, CASE WHEN i.n >= 20 THEN i.m + c.t * i.se END AS confidence_upper
        FROM iid i LEFT JOIN ({_HALVED}) c ON c.df = i.n - 1.0""",
    "iid", "estimate confidence_lower confidence_upper"))
def _(spark, sf):
    out = inference.mean_test_iid(daily_returns(spark, sf), keys=K, value="ret")
    return out.select("security_id", "estimate", "confidence_lower", "confidence_upper")


_L = "least(floor(4 * pow(a.n / 100.0, 2.0 / 9)), a.n - 1)"
cte("hac_rows", """SELECT security_id, ret, ret - avg(ret) OVER (PARTITION BY security_id) AS e, count(*) OVER (PARTITION BY security_id) AS n,
 row_number() OVER (PARTITION BY security_id ORDER BY session_date) AS i FROM weekly_panel WHERE ret IS NOT NULL""", ["weekly_panel"])
cte("hac", f"""SELECT security_id, n AS observations, m AS estimate, lags, sqrt(g) / n AS standard_error, m / (sqrt(g) / n) AS statistic FROM
 (SELECT a.security_id, any_value(a.n) AS n, avg(a.ret) AS m, CAST(any_value({_L}) AS BIGINT) AS lags,
   sum(CASE WHEN a.i = b.i THEN a.e * b.e ELSE 2 * (1 - (a.i - b.i) / ({_L} + 1)) * a.e * b.e END) AS g
  FROM hac_rows a JOIN hac_rows b ON a.security_id = b.security_id AND b.i <= a.i AND a.i - b.i <= {_L} GROUP BY 1)""", ["hac_rows"])
cte("hac_mean", "SELECT security_id, avg(ret) AS estimate FROM hac_rows GROUP BY 1", ["hac_rows"])


@register("j3_mean_test_hac", oracle(
    f"""SELECT security_id, 'hac_mean(max_lags=' || CAST(lags AS VARCHAR) || ')' AS method, observations, e.estimate, standard_error, e.estimate / standard_error AS statistic,
        {p_sql('(e.estimate / standard_error)', '(observations - 1.0)')} AS p_value FROM hac JOIN hac_mean e USING (security_id)""",
    "hac hac_mean", "estimate standard_error statistic p_value"))
def _(spark, sf):
    out = inference.mean_test_hac(weekly_panel(spark, sf), keys=K, value="ret", order=[T])
    return out.select("security_id", "method", "observations", "estimate", "standard_error", "statistic", "p_value")


@register("j3_mean_test_hac_whole_table", oracle(
    """SELECT event_type, count(*) AS observations, any_value(m) AS estimate, sqrt(sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / 13.0) * g END)) / any_value(n) AS standard_error FROM
       (SELECT a.event_type, a.i, any_value(a.n) AS n, any_value(a.m) AS m, 0 AS l, any_value(a.e * a.e) + 2 * coalesce(sum((1 - (a.i - b.i) / 13.0) * a.e * b.e), 0) AS g
        FROM ev a LEFT JOIN ev b ON a.event_type = b.event_type AND b.i < a.i AND a.i - b.i <= 12 GROUP BY 1, 2) GROUP BY 1""",
    "ev", "estimate standard_error"))
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "value", "ts", "event_id")
    out = inference.mean_test_hac(rows, keys=["event_type"], value="value", order=["ts", "event_id"], max_lags=12,
                                  bucket=F.unix_seconds("ts") / F.lit(60), with_inference=False)
    return out.select("event_type", "observations", "estimate", "standard_error")


cte("ev", """SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS e, avg(value) OVER (PARTITION BY event_type) AS m, count(*) OVER (PARTITION BY event_type) AS n,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events""")

_REPS = 200
cte("boot_series", """SELECT security_id, ret, row_number() OVER (PARTITION BY security_id ORDER BY session_date) - 1 AS i, count(*) OVER (PARTITION BY security_id) AS n FROM weekly_panel WHERE ret IS NOT NULL""", ["weekly_panel"])
cte("boot_size", """SELECT security_id, any_value(n) AS n, avg(ret) AS estimate, least(greatest(1, CAST(round(pow(any_value(n), 1.0 / 3)) AS BIGINT)), any_value(n)) AS b FROM boot_series GROUP BY 1""", ["boot_series"])
cte("boot_draws", f"""SELECT security_id, n, rep, blk, b, CASE WHEN blk = ceil(n / CAST(b AS DOUBLE)) THEN n - (ceil(n / CAST(b AS DOUBLE)) - 1) * b ELSE b END AS len,
  CAST('0x' || substr(md5('7:' || CAST(security_id AS VARCHAR) || ':' || CAST(rep AS VARCHAR) || ':' || CAST(blk AS VARCHAR)), 1, 12) AS BIGINT) % n AS start
 FROM (SELECT *, unnest(range(1, CAST(ceil(n / CAST(b AS DOUBLE)) AS BIGINT) + 1)) AS blk FROM (SELECT *, unnest(range(1, {_REPS + 1})) AS rep FROM boot_size))""", ["boot_size"])
cte("boot_offsets", "SELECT security_id, n, rep, (start + unnest(range(0, CAST(len AS BIGINT)))) % n AS i FROM boot_draws", ["boot_draws"])


@register("j4_block_bootstrap", oracle(
    """SELECT security_id, any_value(z.n) AS observations, any_value(z.estimate) AS estimate, any_value(z.b) AS block_size, stddev_samp(m.mean) AS standard_error,
       quantile_cont(m.mean, 0.025) AS confidence_lower, quantile_cont(m.mean, 0.975) AS confidence_upper FROM boot_size z JOIN
       (SELECT security_id, rep, avg(ret) AS mean FROM boot_offsets JOIN boot_series USING (security_id, i) GROUP BY 1, 2) m USING (security_id) GROUP BY 1""",
    "boot_size boot_offsets boot_series", "estimate standard_error confidence_lower confidence_upper"))
def _(spark, sf):
    out = inference.block_bootstrap_mean(weekly_panel(spark, sf), keys=K, value="ret", order=[T], resamples=_REPS, seed=7)
    return out.select("security_id", "observations", "estimate", "block_size", "standard_error", "confidence_lower", "confidence_upper")


cte("pvals", "SELECT event_id, event_type, CASE WHEN user_id % 10 = 3 THEN NULL ELSE least(pow(value / 500.0, 3), 1.0) END AS p_value FROM events")


@register("j5_benjamini_hochberg", oracle(
    """SELECT event_id, event_type, p_value, q_value, coalesce(q_value <= 0.05, false) AS fdr_rejected FROM
       (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1, min(cand) OVER (PARTITION BY event_type ORDER BY p_value DESC NULLS LAST RANGE UNBOUNDED PRECEDING)) END AS q_value FROM
        (SELECT *, p_value * count(p_value) OVER (PARTITION BY event_type) / (rank() OVER (PARTITION BY event_type ORDER BY p_value NULLS LAST) + count(*) OVER (PARTITION BY event_type, p_value) - 1) AS cand FROM pvals))""",
    "pvals", "p_value q_value"))
def _(spark, sf):
    p = F.when(F.col("user_id") % 10 != 3, F.least(F.pow(F.col("value") / 500.0, F.lit(3.0)), F.lit(1.0)))
    rows = table(spark, sf, "events").select("event_id", "event_type", p.alias("p_value"))
    return inference.benjamini_hochberg(rows, keys=["event_type"])


cte("periods", """SELECT security_id, period, observations, r AS period_return FROM (SELECT *, min(period) OVER (PARTITION BY security_id) AS lo, max(period) OVER (PARTITION BY security_id) AS hi FROM
 (SELECT security_id, CAST(date_trunc('month', session_date) AS DATE) AS period, count(ret) AS observations, product(1 + ret / 10) - 1 AS r FROM weekly_panel GROUP BY 1, 2))
WHERE observations >= 3 AND period <> lo AND period <> hi""", ["weekly_panel"])


def scaled(spark, sf):
    """Weekly returns in tenths, so monthly products stay in range."""
    return weekly_panel(spark, sf).withColumn("ret", F.col("ret") / 10)


@register("j6_period_returns", oracle("SELECT * FROM periods", "periods", "period_return", "period"))
def _(spark, sf):
    return inference.compound_period_returns(scaled(spark, sf), keys=K, order=T, value="ret", minimum_observations=3)


def bucket_sql(rows: str, minimum: int) -> str:
    """Statistics and one-lag HAC error per (security, bucket) of (security_id, bucket, t, x)."""
    return f"""SELECT security_id, bucket, any_value(n) AS observations, avg(x) AS mean_return, quantile_cont(x, 0.5) AS median_return, stddev_samp(x) AS sample_std,
 avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, CASE WHEN any_value(n) >= {minimum} THEN sqrt(sum(e * e + coalesce(e * pe, 0))) / any_value(n) END AS standard_error
FROM (SELECT *, lag(e) OVER (PARTITION BY security_id, bucket ORDER BY t) AS pe FROM
 (SELECT *, x - avg(x) OVER (PARTITION BY security_id, bucket) AS e, count(*) OVER (PARTITION BY security_id, bucket) AS n FROM {rows})) GROUP BY 1, 2"""


cte("monthly", bucket_sql("(SELECT security_id, month(period) AS bucket, period AS t, period_return AS x FROM periods)", 5), ["periods"])


def family_sql(source: str, count: str) -> str:
    p = p_sql("(mean_return / standard_error)", "(observations - 1.0)")
    return f"""SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1, min(cand) OVER (PARTITION BY security_id ORDER BY p_value DESC NULLS LAST)) END AS q_value FROM
(SELECT *, p_value * count(p_value) OVER (PARTITION BY security_id) / rank() OVER (PARTITION BY security_id ORDER BY p_value NULLS LAST) AS cand FROM
 (SELECT *, CASE WHEN standard_error IS NOT NULL THEN {p} END AS p_value FROM {source}))"""


cte("monthly_q", family_sql("monthly", ""), ["monthly"])
_STATS = ["observations", "mean_return", "median_return", "sample_std", "win_rate", "standard_error"]


@register("j7_j8_monthly_seasonality", oracle(
    f"""SELECT s.security_id, s.bucket, coalesce(m.observations, 0) AS observations, {', '.join('m.' + c for c in _STATS[1:])}, m.p_value, m.q_value
        FROM (SELECT security_id, unnest(range(1, 13)) AS bucket FROM (SELECT DISTINCT security_id FROM weekly_panel)) s LEFT JOIN monthly_q m USING (security_id, bucket)""",
    "monthly_q weekly_panel", "mean_return median_return sample_std win_rate standard_error p_value q_value"))
def _(spark, sf):
    out = inference.monthly_seasonality(scaled(spark, sf), keys=K, order=T, value="ret", minimum_days_per_month=3)
    return out.select("security_id", "bucket", *_STATS, "p_value", "q_value")


cte("weekday_stats", bucket_sql("(SELECT security_id, isodow(session_date) - 1 AS bucket, session_date AS t, ret AS x FROM daily_returns WHERE ret IS NOT NULL)", 4), ["daily_returns"])
cte("weekday_q", family_sql("weekday_stats", ""), ["weekday_stats"])


@register("j9_weekday_seasonality", oracle(
    f"SELECT security_id, bucket, {', '.join(_STATS)}, p_value, q_value FROM weekday_q", "weekday_q", "mean_return median_return sample_std win_rate standard_error p_value q_value"))
def _(spark, sf):
    out = inference.weekday_seasonality(daily_returns(spark, sf), keys=K, order=T, value="ret", minimum_observations=4)
    return out.select("security_id", "bucket", *_STATS, "p_value", "q_value")


# -- exploratory tables ------------------------------------------------------

cte("naive_months", """SELECT security_id, month(period) AS month, r FROM (SELECT security_id, date_trunc('month', session_date) AS period, coalesce(product(1 + ret / 10), 1) - 1 AS r FROM weekly_panel GROUP BY 1, 2)""", ["weekly_panel"])
cte("naive_table", f"""SELECT *, CASE WHEN t_statistic IS NOT NULL THEN {p_sql('t_statistic', '(years - 1.0)')} END AS p_value FROM
(SELECT security_id, month, avg(r) AS mean_return, stddev_samp(r) AS std_dev, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(r) AS years,
 CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / (stddev_samp(r) / sqrt(count(r))) END AS t_statistic, quantile_cont(r, 0.5) AS median_return FROM naive_months GROUP BY 1, 2)""", ["naive_months"])


@register("p1_monthly_table", oracle("SELECT * FROM naive_table", "naive_table", "mean_return std_dev win_rate t_statistic median_return p_value"))
def _(spark, sf):
    return naive.monthly_table(scaled(spark, sf), keys=K, order=T, value="ret").drop("label")


@register("p1_best_and_worst_month", oracle(
    """SELECT security_id, max(mean_return) AS best_mean, min(mean_return) AS worst_mean, strftime(make_date(2000, CAST(arg_max(month, mean_return) AS BIGINT), 1), '%b') AS best_month,
       strftime(make_date(2000, CAST(arg_min(month, mean_return) AS BIGINT), 1), '%b') AS worst_month FROM naive_table GROUP BY 1""", "naive_table", "best_mean worst_mean"))
def _(spark, sf):
    return naive.best_and_worst_month(naive.monthly_table(scaled(spark, sf), keys=K, order=T, value="ret", with_p_value=False), keys=K)


@register("p2_weekday_table", oracle(
    f"""SELECT *, CASE WHEN t_statistic IS NOT NULL THEN {p_sql('t_statistic', '(observations - 1.0)')} END AS p_value FROM
        (SELECT security_id, isodow(session_date) - 1 AS weekday, avg(ret) AS mean_return, stddev_samp(ret) AS std_dev, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(ret) AS observations,
          CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) END AS t_statistic, avg(ret) * 252 AS annualized
         FROM daily_returns WHERE isodow(session_date) <= 5 GROUP BY 1, 2)""", "daily_returns", "mean_return std_dev win_rate t_statistic annualized p_value"))
def _(spark, sf):
    return naive.weekday_table(daily_returns(spark, sf), keys=K, order=T, value="ret").drop("label")


_S = "PARTITION BY security_id ORDER BY session_date"


@register("p3_clipped_event_windows", oracle(
    f"""SELECT o.event_date, c.security_id, c.session_date, pre, event_day, post FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS event_date FROM orders) o JOIN
        (SELECT security_id, session_date, ret AS event_day, lag(session_date) OVER ({_S}) AS prev,
           close / CASE WHEN row_number() OVER ({_S}) > 5 THEN lag(close, 5) OVER ({_S}) ELSE first_value(close) OVER ({_S}) END - 1 AS pre,
           coalesce(lead(close, 5) OVER ({_S}), last_value(close) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / close - 1 AS post FROM weekly_panel) c
        ON o.event_date <= c.session_date AND (c.prev IS NULL OR o.event_date > c.prev)""", "weekly_panel", "pre event_day post", "event_date session_date"))
def _(spark, sf):
    dates = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("event_date")).distinct()
    return naive.clipped_event_windows(weekly_panel(spark, sf), dates, keys=K, session=T, close="close", value="ret")


@register("p4_insider_substring_sums", oracle(
    """SELECT user_id AS security_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN v END), 0) AS buy_value, coalesce(sum(CASE WHEN event_type = 'view' THEN v END), 0) AS sell_value,
       CASE WHEN sum(CASE WHEN event_type = 'view' THEN v END) > 0 AND sum(CASE WHEN event_type = 'purchase' THEN v END) > 0
         THEN sum(CASE WHEN event_type = 'purchase' THEN v END) / sum(CASE WHEN event_type = 'view' THEN v END) END AS buy_sell_ratio,
       CASE WHEN sum(CASE WHEN event_type = 'purchase' THEN v END) / nullif(sum(CASE WHEN event_type = 'view' THEN v END), 0) < 0.1 THEN 'heavy_net_selling'
            WHEN sum(CASE WHEN event_type = 'purchase' THEN v END) / nullif(sum(CASE WHEN event_type = 'view' THEN v END), 0) > 2 THEN 'heavy_net_buying' END AS edge
       FROM (SELECT *, CASE WHEN value > 1 THEN value END AS v FROM events) GROUP BY 1""", "", "buy_value sell_value buy_sell_ratio"))
def _(spark, sf):
    return naive.substring_insider_sums(transactions(spark, sf), keys=K, action="transaction_type", value="value")


@register("p5_squeeze_flag", oracle("SELECT p_partkey, p_size / 100.0 > 0.15 AND p_retailprice / 200 > 5 AS squeeze FROM part"))
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", naive.squeeze_flag(F.col("p_size") / 100.0, F.col("p_retailprice") / 200).alias("squeeze"))


@register("p6_chain_sentiment", oracle(
    """SELECT security_id, pv / nullif(cv, 0) AS volume_ratio, po / nullif(co, 0) AS open_interest_ratio, piv AS otm_put_iv, civ AS otm_call_iv, piv - civ AS iv_skew,
       CASE WHEN pv / nullif(cv, 0) > 1.2 THEN 'bearish' WHEN pv / nullif(cv, 0) < 0.6 THEN 'bullish' END AS volume_edge, coalesce(piv - civ > 0.05, false) AS elevated_skew FROM
       (SELECT security_id, coalesce(sum(volume) FILTER (WHERE side = 'call'), 0) AS cv, coalesce(sum(volume) FILTER (WHERE side = 'put'), 0) AS pv,
         coalesce(sum(open_interest) FILTER (WHERE side = 'call'), 0) AS co, coalesce(sum(open_interest) FILTER (WHERE side = 'put'), 0) AS po,
         avg(implied_volatility) FILTER (WHERE side = 'put' AND strike < 2000 * 0.95) AS piv, avg(implied_volatility) FILTER (WHERE side = 'call' AND strike > 2000 * 1.05) AS civ
        FROM chain GROUP BY 1)""", "chain", "volume_ratio open_interest_ratio otm_put_iv otm_call_iv iv_skew"))
def _(spark, sf):
    return naive.chain_sentiment(chain(spark, sf).withColumn("spot", F.lit(2000.0)), keys=K, spot="spot")


cte("drift", f"""SELECT e.event_id, e.security_id, e.event_date, c.anchor, pre_run, gap, day_of, post_drift FROM
 (SELECT event_id, user_id AS security_id, CAST(ts AS DATE) AS event_date FROM events) e JOIN
 (SELECT security_id, session_date AS anchor, lag(session_date) OVER ({_S}) AS prev, row_number() OVER ({_S}) AS rn, lead(session_date, 5) OVER ({_S}) AS fifth,
   lag(close, 1) OVER ({_S}) / nullif(lag(close, 5) OVER ({_S}), 0) - 1 AS pre_run, open / nullif(lag(close) OVER ({_S}), 0) - 1 AS gap, ret AS day_of, lead(close, 5) OVER ({_S}) / close - 1 AS post_drift
  FROM week_bars) c ON c.security_id = e.security_id AND c.rn > 5 AND c.fifth IS NOT NULL AND e.event_date <= c.anchor AND e.event_date > c.prev""", ["week_bars"])


def drift(spark, sf):
    dates = company_events(spark, sf).select("event_id", "security_id", F.to_date("event_at").alias("event_date"))
    bars = week_bars(spark, sf)
    joined = naive.earnings_drift(bars, dates.select("security_id", "event_date").distinct(), keys=K, session=T, value="ret")
    return dates.join(joined, ["security_id", "event_date"])


@register("p7_earnings_drift", oracle(
    "SELECT CAST(event_id AS VARCHAR) AS event_id, security_id, anchor, pre_run, gap, day_of, post_drift FROM drift", "drift", "pre_run gap day_of post_drift", "anchor"))
def _(spark, sf):
    return drift(spark, sf).select("event_id", "security_id", "anchor", "pre_run", "gap", "day_of", "post_drift")


@register("p7_drift_summary", oracle(
    " UNION ALL ".join(
        f"SELECT '{c}' AS pattern, count({c}) AS observations, avg({c}) AS mean, avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg({c}) / (stddev_samp({c}) / sqrt(count({c}))) AS t_statistic FROM drift"
        for c in ("pre_run", "gap", "day_of", "post_drift")), "drift", "mean win_rate t_statistic"))
def _(spark, sf):
    return naive.drift_summary(drift(spark, sf), by=[])


@register("p8_sector_rotation", oracle(
    f"""SELECT security_id, count(*) AS observations, arg_max(a, n) - 1 AS asset_return, arg_max(s, n) - 1 AS sector_return, arg_max(m, n) - 1 AS market_return,
        arg_max(ds, n) AS strength_change_sector, arg_max(dm, n) AS strength_change_market, covar_samp(ret, mkt_ret) / var_samp(mkt_ret) AS beta_market,
        corr(ret, mkt_ret) AS correlation_market, corr(ret, sec_ret) AS correlation_sector,
        CASE WHEN arg_max(ds, n) > 0.05 THEN 'outperforming' WHEN arg_max(ds, n) < -0.05 THEN 'underperforming' END AS edge
        FROM (SELECT *, (a / s) / lag(a / s, 62) OVER ({_S}) - 1 AS ds, (a / m) / lag(a / m, 62) OVER ({_S}) - 1 AS dm, row_number() OVER ({_S}) AS n FROM
          (SELECT *, product(1 + ret) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS a, product(1 + sec_ret) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS s, product(1 + mkt_ret) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS m
           FROM (SELECT security_id, session_date, ret / 100 AS ret, sec_ret / 100 AS sec_ret, mkt_ret / 100 AS mkt_ret FROM weekly_panel WHERE ret IS NOT NULL AND sec_ret IS NOT NULL AND mkt_ret IS NOT NULL))) GROUP BY 1""",
    "weekly_panel", "asset_return sector_return market_return strength_change_sector strength_change_market beta_market correlation_market correlation_sector"))
def _(spark, sf):
    rows = weekly_panel(spark, sf).withColumns({c: F.col(c) / 100 for c in ("ret", "sec_ret", "mkt_ret")})
    return naive.sector_rotation(rows, keys=K, order=T, asset="ret", sector="sec_ret", market="mkt_ret")


@register("p9_edge_summary", oracle(
    """SELECT 'month ' || CAST(month AS VARCHAR) AS pattern, security_id, mean_return AS mean, p_value, CASE WHEN mean_return > 0 THEN 'positive' ELSE 'negative' END AS bias
       FROM naive_table WHERE p_value < 0.10""", "naive_table", "mean p_value"))
def _(spark, sf):
    months = naive.monthly_table(scaled(spark, sf), keys=K, order=T, value="ret").select(
        F.concat(F.lit("month "), F.col("month").cast("string")).alias("pattern"), "security_id", F.col("mean_return").alias("mean"), "p_value")
    return naive.edge_summary([months])


@register("p9_baseline_profile", oracle(
    """SELECT security_id, pow(1 + avg(ret) / 1000, 252) - 1 AS annual_return, stddev_samp(ret / 1000) * sqrt(252) AS annual_volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM weekly_panel GROUP BY 1""",
    "weekly_panel", "annual_return annual_volatility sharpe"))
def _(spark, sf):
    return naive.baseline_profile(weekly_panel(spark, sf).withColumn("ret", F.col("ret") / 1000), keys=K, value="ret")


@register("p10_institutional_snapshot", oracle("SELECT l_suppkey AS security_id, avg(l_quantity - 20) AS mean_change FROM lineitem GROUP BY 1", "", "mean_change"))
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("security_id"), (F.col("l_quantity") - 20).alias("share_change"))
    return naive.institutional_snapshot(rows, keys=K, change="share_change")
