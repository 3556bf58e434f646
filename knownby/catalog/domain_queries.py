"""Events, estimates, valuation, options and ownership (groups F, G, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownby.catalog.base import bars_daily, contributors, cte, daily_returns, oracle, register, table, weekly_panel
from knownby.catalog.pit_queries import AS_OF, AT, WEEK_AS_OF, WEEK_AT
from knownby.catalog.series_queries import zscore_sql
from knownby.functions.numeric import growth
from knownby.operators import estimates, events, inference, positioning, series

SPEC = events.standard_event_spec(pre_sessions=3, post_sessions=3)
K = ["security_id"]
WINDOWS = [w.name for w in SPEC.windows]

cte("weekdays", "SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events WHERE isodow(CAST(ts AS DATE)) <= 5")
cte("week_bars", """SELECT *, close / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY session_date), 0) - 1 AS ret
FROM bars_daily WHERE isodow(session_date) <= 5""", ["bars_daily"])


def company_events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("security_id"), F.col("ts").alias("event_at"),
        (F.col("ts") + F.expr("interval 1 minute")).alias("available_at"), "event_type", "value")


def week_bars(spark, sf):
    """Daily bars on weekdays only, so weekend events must roll."""
    days = bars_daily(spark, sf).where(F.weekday("session_date") < 5)
    return series.simple_returns(days, keys=K, order="session_date", value="close", name="ret")


# Local New York time without a zone table: the data lies in January (UTC-5).
cte("clocked", """SELECT CAST(event_id AS VARCHAR) AS event_id, user_id AS security_id, ts AS event_at, value, event_type, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_date,
 CASE WHEN CAST(ts - INTERVAL 5 HOUR AS TIME) < TIME '09:30:00' THEN 'BMO' WHEN CAST(ts - INTERVAL 5 HOUR AS TIME) >= TIME '16:00:00' THEN 'AMC' ELSE 'INTRADAY' END AS event_timing FROM events""")
_RULE = """CASE WHEN s IS NULL THEN 'no_future_session' WHEN event_timing = 'AMC' THEN 'strict_next_session_after_close' || CASE WHEN s - local_date > 1 THEN '_holiday_or_weekend_roll' ELSE '' END
 ELSE 'same_or_next_open_session' || CASE WHEN s <> local_date THEN '_holiday_or_weekend_roll' ELSE '' END END AS alignment_rule"""


@register("f1_align_events", oracle(
    f"""SELECT event_id, event_timing, s AS response_session, {_RULE} FROM
        (SELECT c.*, (SELECT min(session_date) FROM weekdays d WHERE d.session_date > c.local_date OR (d.session_date = c.local_date AND c.event_timing <> 'AMC')) AS s FROM clocked c)""",
    "clocked weekdays", dates="response_session"))
def _(spark, sf):
    days = bars_daily(spark, sf).select("session_date").where(F.weekday("session_date") < 5)
    out = events.align_events(company_events(spark, sf), days, SPEC)
    return out.select("event_id", "event_timing", "response_session", "alignment_rule")


@register("f2_session_index", oracle(
    "SELECT security_id, session_date, row_number() OVER (PARTITION BY security_id ORDER BY session_date) - 1 AS position FROM bars_daily", "bars_daily", dates="session_date"))
def _(spark, sf):
    return events.session_index(bars_daily(spark, sf), keys=K).select("security_id", "session_date", "position")


@register("f3_events_known", oracle(
    f"SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE ts + INTERVAL 1 MINUTE <= {AT}"))
def _(spark, sf):
    return events.filter_events_as_of(company_events(spark, sf), as_of=AS_OF).select("event_id")


def _win(name, lo, hi):
    bound = lambda n: f"{-n} PRECEDING" if n < 0 else ("CURRENT ROW" if n == 0 else f"{n} FOLLOWING")
    over = f"OVER (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN {bound(lo)} AND {bound(hi)})"
    return f"CASE WHEN count(ret) {over} = {hi - lo + 1} THEN product(1 + ret) {over} - 1 END AS {name}"


cte("windowed", f"""SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session_date) - 1 AS position,
 {', '.join(_win(w.name, w.start, w.end) for w in SPEC.windows)},
 open / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY session_date), 0) - 1 AS overnight_gap,
 {zscore_sql('lv', 10, 5)} AS volume_zscore FROM (SELECT *, ln(1 + volume) AS lv FROM week_bars)""", ["week_bars"])
cte("aligned", """SELECT c.*, (SELECT min(session_date) FROM week_bars d WHERE d.security_id = c.security_id AND (d.session_date > c.local_date OR (d.session_date = c.local_date AND c.event_timing <> 'AMC'))) AS s FROM clocked c""",
    ["clocked", "week_bars"])
cte("study", f"""SELECT a.*, w.position, {', '.join('w.' + n for n in WINDOWS)}, w.overnight_gap, w.volume_zscore,
 coalesce({' AND '.join(f'w.{n} IS NOT NULL' for n in WINDOWS)}, false) AS is_complete,
 coalesce(w.position - lag(w.position) OVER o <= 6, false) OR coalesce(lead(w.position) OVER o - w.position <= 6, false) AS near
FROM aligned a LEFT JOIN windowed w ON w.security_id = a.security_id AND w.session_date = a.s
WINDOW o AS (PARTITION BY a.security_id, w.position IS NULL ORDER BY w.position)""", ["aligned", "windowed"])


def study(spark, sf, policy="flag", volume_window=10):
    spec = events.EventStudySpec(SPEC.windows, overlap_policy=policy)
    return events.extract_event_windows(week_bars(spark, sf), company_events(spark, sf), spec, keys=K, value="ret")


@register("f4_f5_event_windows", oracle(
    f"""SELECT event_id, s AS response_session, {', '.join(WINDOWS)}, is_complete, near AND s IS NOT NULL AS overlaps_another_event,
        is_complete AND NOT near AS is_eligible FROM study""", "study", " ".join(WINDOWS), "response_session"))
def _(spark, sf):
    out = study(spark, sf, policy="exclude")
    return out.select("event_id", "response_session", *WINDOWS, "is_complete", "overlaps_another_event", "is_eligible")


@register("f7_event_window_tests", oracle(
    "SELECT * FROM hac_windows", "hac_windows", "estimate standard_error statistic", digits=5), digits=5)
def _(spark, sf):
    rows = study(spark, sf)
    # Window returns of the proxy are extreme; a log keeps the sums well conditioned.
    logged = rows.withColumns({n: F.log1p(F.col(n)) for n in WINDOWS})
    out = events.summarize_event_windows(logged, SPEC)
    return out.select("window", "observations", "estimate", "standard_error", "statistic")


cte("window_values", " UNION ALL ".join(
    f"SELECT '{n}' AS w, ln(1 + {n}) AS x, event_at, event_id FROM study WHERE is_complete" for n in WINDOWS), ["study"])
cte("window_centred", "SELECT w, x - avg(x) OVER (PARTITION BY w) AS e, x, count(*) OVER (PARTITION BY w) AS n, row_number() OVER (PARTITION BY w ORDER BY event_at, event_id) AS i FROM window_values", ["window_values"])
cte("hac_windows", """SELECT w AS "window", n AS observations, est AS estimate, sqrt(g) / n AS standard_error, est / (sqrt(g) / n) AS statistic FROM
(SELECT a.w, any_value(a.n) AS n, any_value(m.est) AS est,
  sum(CASE WHEN a.i = b.i THEN a.e * b.e ELSE 2 * (1 - (a.i - b.i) / (floor(4 * pow(a.n / 100.0, 2.0 / 9)) + 1)) * a.e * b.e END) AS g
 FROM window_centred a JOIN window_centred b ON a.w = b.w AND b.i <= a.i AND a.i - b.i <= floor(4 * pow(a.n / 100.0, 2.0 / 9))
 JOIN (SELECT w, avg(x) AS est FROM window_centred GROUP BY 1) m ON m.w = a.w GROUP BY 1)""", ["window_centred"])


@register("f8_surprise_ratio", oracle(
    "SELECT o_orderkey, (o_totalprice - c) / nullif(abs(c), 0) AS surprise_ratio FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 150000.0 END AS c FROM orders)", "", "surprise_ratio"))
def _(spark, sf):
    c = F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(150000.0)
    return table(spark, sf, "orders").select("o_orderkey", events.surprise_ratio(F.col("o_totalprice"), c).alias("surprise_ratio"))


@register("f9_earnings_features", oracle(
    f"""SELECT event_id, s AS response_session, {', '.join(WINDOWS)}, overnight_gap, volume_zscore,
        (value - 20.0) / 20.0 AS eps_surprise FROM study""", "study", " ".join(WINDOWS) + " overnight_gap volume_zscore eps_surprise", "response_session"))
def _(spark, sf):
    rows = company_events(spark, sf).withColumn("actual_eps", F.col("value")).withColumn("consensus_eps", F.lit(20.0))
    out = events.earnings_event_features(week_bars(spark, sf), rows, SPEC, volume_window=10, volume_minimum=5)
    return out.select("event_id", "response_session", *WINDOWS, "overnight_gap", "volume_zscore", "eps_surprise")


cte("releases", "SELECT event_type AS series_id, date_trunc('hour', ts) AS release_at, avg(value) AS value, 25.0 AS consensus FROM events GROUP BY 1, 2")


@register("f10_f11_macro_surprise", oracle(
    f"""SELECT series_id, release_at, sp AS surprise, {zscore_sql('sp', 24, 12).replace('security_id', 'series_id').replace('session_date', 'release_at')} AS standardized_surprise
        FROM (SELECT *, value - consensus AS sp FROM releases)""", "releases", "surprise standardized_surprise", stamps="release_at"))
def _(spark, sf):
    # One release per series and hour: the series grows with the calendar, not with the events.
    hourly = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("release_at")).agg(F.avg("value").alias("actual"))
    rows = hourly.select("series_id", "release_at", events.macro_surprise(F.col("actual"), F.lit(25.0)).alias("surprise"))
    return series.rolling_standardized_surprise(rows, keys=["series_id"], order="release_at", value="surprise")


@register("f12_standardized_changes", oracle(
    f"""SELECT security_id, session_date, {zscore_sql('ch', 126, 63)} AS standardized_change
        FROM (SELECT *, close - lag(close) OVER (PARTITION BY security_id ORDER BY session_date) AS ch FROM weekly_panel)""",
    "weekly_panel", "standardized_change", "session_date"))
def _(spark, sf):
    out = series.standardized_macro_changes(weekly_panel(spark, sf), keys=K, order="session_date", value="close")
    return out.select("security_id", "session_date", "standardized_change")


@register("f13_macro_event_study", oracle(
    f"""SELECT a.event_id, a.security_id, a.s AS response_session, {', '.join('w.' + n for n in WINDOWS)}, coalesce({' AND '.join(f'w.{n} IS NOT NULL' for n in WINDOWS)}, false) AS is_complete
        FROM (SELECT c.event_id, u.security_id, (SELECT min(session_date) FROM week_bars d WHERE d.security_id = u.security_id AND (d.session_date > c.local_date OR (d.session_date = c.local_date AND c.event_timing <> 'AMC'))) AS s
              FROM daily_release c, (SELECT DISTINCT security_id FROM week_bars) u) a
        LEFT JOIN windowed w ON w.security_id = a.security_id AND w.session_date = a.s""",
    "daily_release windowed", " ".join(WINDOWS), "response_session"))
def _(spark, sf):
    # One release stream: the last event of each hour.
    rows = company_events(spark, sf).groupBy(F.date_trunc("hour", "event_at").alias("h")).agg(F.max_by(F.struct("event_id", "event_at"), "event_at").alias("e"))
    releases = rows.select("e.event_id", F.col("e.event_at").alias("release_at"))
    out = events.macro_event_study(week_bars(spark, sf), releases, SPEC, keys=K, value="ret", available=None)
    return out.select("event_id", "security_id", "response_session", *WINDOWS, "is_complete")


cte("daily_release", "SELECT * FROM clocked QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', event_at) ORDER BY event_at DESC) = 1", ["clocked"])


@register("f14_macro_sensitivities", oracle(
    "SELECT security_id, session_date, my - b * mx AS coef_intercept, b AS coef_mkt_ret FROM one_factor", "one_factor", "coef_intercept coef_mkt_ret", "session_date"))
def _(spark, sf):
    return series.rolling_factor_exposures(weekly_panel(spark, sf), keys=K, order="session_date", asset="ret", factors=["mkt_ret"])


# -- estimates and valuation -------------------------------------------------

_NEWEST = "ORDER BY available_at DESC, event_id DESC) = 1"
_EK = "security_id, metric, fiscal_period"


def _vint(at: str) -> str:
    return f"(SELECT {_EK}, estimate AS v, available_at FROM contributors WHERE available_at <= {at} QUALIFY row_number() OVER (PARTITION BY {_EK} {_NEWEST})"


@register("g1_estimate_revisions", oracle(
    f"""SELECT n.security_id, n.metric, n.fiscal_period, n.v AS consensus_now, n.available_at AS available_at_now, a.v AS consensus_1d_ago, n.v / nullif(a.v, 0) - 1 AS revision_1d,
        b.v AS consensus_7d_ago, n.v / nullif(b.v, 0) - 1 AS revision_7d FROM {_vint(AT)} n
        LEFT JOIN {_vint(AT + ' - INTERVAL 1 DAY')} a USING ({_EK}) LEFT JOIN {_vint(AT + ' - INTERVAL 7 DAY')} b USING ({_EK})""",
    "contributors", "consensus_now consensus_1d_ago revision_1d consensus_7d_ago revision_7d", stamps="available_at_now"))
def _(spark, sf):
    rows = contributors(spark, sf).withColumnRenamed("estimate", "consensus")
    return estimates.estimate_revisions(rows, as_of=AS_OF, lookback_days=(1, 7), tie_break=["event_id"])


_CK = _EK + ", contributor_id"


def _cont(at: str) -> str:
    return f"(SELECT {_CK}, estimate AS v FROM contributors WHERE available_at <= {at} QUALIFY row_number() OVER (PARTITION BY {_CK} {_NEWEST})"


@register("g2_revision_breadth", oracle(
    f"""SELECT security_id, metric, fiscal_period, count(*) FILTER (WHERE n.v > p.v) AS raises, count(*) FILTER (WHERE n.v < p.v) AS cuts, count(*) FILTER (WHERE n.v = p.v) AS unchanged,
        count(*) AS contributors_paired, count(*) FILTER (WHERE n.v <> p.v) AS contributors_changed,
        (count(*) FILTER (WHERE n.v > p.v) - count(*) FILTER (WHERE n.v < p.v)) / nullif(CAST(count(*) FILTER (WHERE n.v <> p.v) AS DOUBLE), 0) AS revision_breadth
        FROM {_cont(AT)} n JOIN {_cont(AT + ' - INTERVAL 5 DAY')} p USING ({_CK}) GROUP BY 1, 2, 3""", "contributors", "revision_breadth"))
def _(spark, sf):
    return estimates.revision_breadth(contributors(spark, sf), as_of=AS_OF, lookback_days=5, tie_break=["event_id"])


@register("g3_estimate_dispersion", oracle(
    """SELECT security_id, metric, count(estimate) AS contributors, avg(estimate) AS mean, stddev_samp(estimate) AS standard_deviation,
       abs(stddev_samp(estimate) / nullif(avg(estimate), 0)) AS coefficient_of_variation FROM contributors GROUP BY 1, 2""",
    "contributors", "mean standard_deviation coefficient_of_variation"))
def _(spark, sf):
    return estimates.estimate_dispersion(contributors(spark, sf), keys=["security_id", "metric"], value="estimate")


@register("h1_valuation_distribution", oracle(
    f"""SELECT security_id, count(*) AS observations, max(CASE WHEN r = 1 THEN close END) AS current, CASE WHEN count(*) >= 60 THEN quantile_cont(close, 0.5) END AS median,
        CASE WHEN count(*) >= 60 AND stddev_samp(close) > 1e-12 THEN (max(CASE WHEN r = 1 THEN close END) - avg(close)) / stddev_samp(close) END AS zscore,
        CASE WHEN count(*) >= 60 THEN avg(CASE WHEN close <= c THEN 1.0 ELSE 0.0 END) END AS percentile
        FROM (SELECT *, first_value(close) OVER (PARTITION BY security_id ORDER BY session_date DESC) AS c, row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) AS r
              FROM weekly_panel WHERE session_date <= CAST({WEEK_AT} AS DATE)) WHERE r <= 200 GROUP BY 1""",
    "weekly_panel", "current median zscore percentile"))
def _(spark, sf):
    rows = weekly_panel(spark, sf).withColumn("known_at", F.col("session_date").cast("timestamp"))
    return estimates.valuation_distribution(rows, keys=K, order="known_at", value="close", as_of=WEEK_AS_OF, lookback=200)


@register("h2_peer_relative_zscore", oracle(
    """SELECT security_id, session_date, CASE WHEN n >= 5 AND n > 0 AND sd > 1e-12 THEN (close - m) / sd END AS peer_zscore FROM
       (SELECT a.security_id, a.session_date, any_value(a.close) AS close, count(b.close) AS n, avg(b.close) AS m, stddev_pop(b.close) AS sd
        FROM weekly_panel a LEFT JOIN weekly_panel b ON a.session_date = b.session_date AND a.region = b.region AND a.security_id <> b.security_id GROUP BY 1, 2)""",
    "weekly_panel", "peer_zscore", "session_date"))
def _(spark, sf):
    out = estimates.peer_relative_zscore(weekly_panel(spark, sf), peer_group=["session_date", "region"], value="close", exclude_self=True)
    return out.select("security_id", "session_date", "peer_zscore")


@register("h3_valuation_decomposition", oracle(
    """SELECT security_id, session_date, (1 + ret) / nullif(1 + sec_ret, 0) - 1 AS multiple_return, (1 + sec_ret) * (1 + ((1 + ret) / nullif(1 + sec_ret, 0) - 1)) - 1 AS reconstructed_return FROM weekly_panel""",
    "weekly_panel", "multiple_return reconstructed_return", "session_date"))
def _(spark, sf):
    out = estimates.valuation_decomposition(weekly_panel(spark, sf), price_return="ret", earnings_revision="sec_ret")
    return out.select("security_id", "session_date", "multiple_return", "reconstructed_return")


# -- options and ownership ---------------------------------------------------

cte("chain", """SELECT l_suppkey AS security_id, CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS side, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS volume,
 l_quantity - 2 AS open_interest, CAST(l_shipdate AS DATE) AS expiry, date_trunc('month', l_shipdate) AS available_at,
 CASE WHEN l_returnflag = 'R' THEN -5 * l_discount ELSE 5 * l_discount END AS delta, l_tax AS implied_volatility, l_extendedprice / l_quantity AS strike FROM lineitem""")


def chain(spark, sf):
    put = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("security_id"), F.when(put, "put").otherwise("call").alias("side"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("volume"), (F.col("l_quantity") - 2).alias("open_interest"),
        F.to_date("l_shipdate").alias("expiry"), F.date_trunc("month", "l_shipdate").alias("available_at"),
        F.when(put, F.col("l_discount") * -5).otherwise(F.col("l_discount") * 5).alias("delta"), F.col("l_tax").alias("implied_volatility"),
        F.try_divide("l_extendedprice", "l_quantity").alias("strike"))


_SIDE = f"""(SELECT security_id, available_at AS at, sum(volume) AS v, sum(CASE WHEN open_interest >= 0 THEN open_interest END) AS oi,
 bool_or(volume IS NULL) AS pv, bool_or(open_interest < 0) AS noi, min(expiry) < max(expiry) AS several
 FROM (SELECT * FROM chain WHERE available_at <= {WEEK_AT} AND side = '@' QUALIFY available_at = max(available_at) OVER (PARTITION BY security_id)) GROUP BY 1, 2)"""


@register("i1_put_call_ratios", oracle(
    f"""SELECT security_id, c.v AS call_volume, p.v AS put_volume, CASE WHEN c.v > 0 THEN p.v / c.v END AS put_call_volume_ratio, c.oi AS call_open_interest, p.oi AS put_open_interest,
        CASE WHEN c.oi > 0 THEN p.oi / c.oi END AS put_call_open_interest_ratio, CASE WHEN c.at = p.at THEN c.at END AS snapshot_at,
        concat_ws(',', CASE WHEN c.at <> p.at THEN 'call_put_snapshot_mismatch' END, CASE WHEN coalesce(c.several, false) OR coalesce(p.several, false) THEN 'multiple_expiries_aggregated' END,
          CASE WHEN coalesce(c.noi, false) OR coalesce(p.noi, false) THEN 'negative_open_interest_excluded' END, CASE WHEN coalesce(c.pv, false) OR coalesce(p.pv, false) THEN 'partial_volume' END,
          CASE WHEN c.oi = 0 THEN 'zero_call_open_interest' END, CASE WHEN c.v = 0 THEN 'zero_call_volume' END) AS warnings
        FROM {_SIDE.replace('@', 'call')} c FULL JOIN {_SIDE.replace('@', 'put')} p USING (security_id)""",
    "chain", "call_volume put_volume put_call_volume_ratio call_open_interest put_open_interest put_call_open_interest_ratio", stamps="snapshot_at"))
def _(spark, sf):
    return positioning.put_call_ratios(chain(spark, sf), as_of=WEEK_AS_OF).drop("status")


_PICK = """(SELECT security_id, delta, implied_volatility AS iv, abs(delta - @t) AS d FROM chain WHERE side = '@s' AND implied_volatility > 0 AND open_interest >= 5
 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY abs(delta - @t), implied_volatility) = 1)"""
_C, _P = _PICK.replace("@t", "0.25").replace("@s", "call"), _PICK.replace("@t", "-0.25").replace("@s", "put")


@register("i2_delta_risk_reversal", oracle(
    f"""SELECT s.security_id, CASE WHEN ok THEN c.delta END AS call_delta, CASE WHEN ok THEN p.delta END AS put_delta, CASE WHEN ok THEN c.iv - p.iv END AS call_minus_put_iv,
        CASE WHEN ok THEN 'OK' ELSE 'UNKNOWN' END AS status FROM (SELECT DISTINCT security_id FROM chain) s LEFT JOIN {_C} c USING (security_id) LEFT JOIN {_P} p USING (security_id),
        LATERAL (SELECT coalesce(c.d <= 0.1 AND p.d <= 0.1, false) AS ok)""", "chain", "call_delta put_delta call_minus_put_iv"))
def _(spark, sf):
    out = positioning.delta_risk_reversal(chain(spark, sf), minimum_open_interest=5, tie_break=["implied_volatility"])
    return out.select("security_id", "call_delta", "put_delta", "call_minus_put_iv", "status")


@register("i3_target_expiry", oracle(
    f"""SELECT security_id, arg_min(CASE WHEN days >= 7 THEN expiry END, CASE WHEN days >= 7 THEN struct_pack(d := abs(days - 30), e := expiry) END) AS target_expiry FROM
        (SELECT *, expiry - CAST({WEEK_AT} AS DATE) AS days FROM chain) GROUP BY 1""", "chain", dates="target_expiry"))
def _(spark, sf):
    return positioning.select_target_expiry(chain(spark, sf), as_of=WEEK_AS_OF)


@register("i4_implied_realized_spread", oracle(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_tax - l_discount AS spread FROM lineitem", "", "spread"))
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", positioning.implied_realized_spread("l_tax", "l_discount").alias("spread"))


_TYPES = {"click": "Open-Market Purchase", "view": "Sale (10b5-1)", "signup": "Stock gift", "purchase": "Buy", "error": "Unknown transfer"}


def transactions(spark, sf):
    text = F.lit(None).cast("string")
    for kind, words in _TYPES.items():
        text = F.when(F.col("event_type") == kind, words).otherwise(text)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("security_id"), text.alias("transaction_type"), F.when(F.col("value") > 1, F.col("value")).alias("value"), F.col("ts").alias("available_at"))


@register("i5_insider_activity", oracle(
    f"""SELECT security_id, CASE WHEN NOT u THEN coalesce(b, 0) END AS buy_value, CASE WHEN NOT u THEN coalesce(s, 0) END AS sell_value, CASE WHEN NOT u THEN coalesce(b, 0) - coalesce(s, 0) END AS net_value,
        CASE WHEN NOT u AND s > 0 THEN coalesce(b, 0) / s END AS buy_sell_ratio, c AS classified_transactions, t - c AS unclassified_transactions,
        CASE WHEN u THEN 'UNKNOWN' WHEN g OR t > c THEN 'PARTIAL' ELSE 'OK' END AS status FROM
        (SELECT user_id AS security_id, sum(CASE WHEN ok AND event_type IN ('click', 'purchase') THEN v END) AS b, sum(CASE WHEN ok AND event_type = 'view' THEN v END) AS s,
          count(*) FILTER (WHERE ok AND event_type IN ('click', 'purchase', 'view')) AS c, count(*) FILTER (WHERE ok) AS t,
          bool_or(ok AND event_type IN ('click', 'purchase', 'view') AND v IS NULL) AS g,
          coalesce(sum(CASE WHEN ok AND event_type IN ('click', 'purchase', 'view') THEN v END), 0) = 0 AS u
         FROM (SELECT *, CASE WHEN value > 1 THEN value END AS v, ts <= {AT} AND ts >= {AT} - INTERVAL 10 DAY AS ok FROM events) GROUP BY 1)""",
    "", "buy_value sell_value net_value buy_sell_ratio"))
def _(spark, sf):
    out = positioning.insider_activity(transactions(spark, sf), as_of=AS_OF, lookback_days=10)
    finite_ratio = F.when(F.col("buy_sell_ratio") != float("inf"), F.col("buy_sell_ratio"))
    return out.withColumn("buy_sell_ratio", finite_ratio).drop("warnings")


@register("i6_institutional_change", oracle(
    """SELECT l_suppkey AS security_id, count(x) AS observations, avg(x) AS mean_share_change, quantile_cont(x, 0.5) AS median_share_change, sum(x) AS total_share_change,
       CASE WHEN count(x) = 0 THEN 'UNKNOWN' WHEN count(x) < count(*) THEN 'PARTIAL' ELSE 'OK' END AS status
       FROM (SELECT *, CASE WHEN l_quantity <= 45 THEN l_quantity - 20 END AS x FROM lineitem) GROUP BY 1""",
    "", "mean_share_change median_share_change total_share_change"))
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("security_id"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity") - 20).alias("share_change"))
    return positioning.institutional_position_change(rows)


@register("i7_short_interest", oracle(
    """SELECT p_partkey, a AS shares_short, b AS short_percent_of_float, c AS days_to_cover, d AS shares_short_prior, a - d AS change_in_shares_short, (a - d) / nullif(d, 0) AS change_percent,
       CASE WHEN k = 0 THEN 'UNKNOWN' WHEN k < 4 THEN 'PARTIAL' ELSE 'OK' END AS status FROM (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT AS k FROM
       (SELECT p_partkey, CASE WHEN p_retailprice - 1000 >= 0 THEN p_retailprice - 1000 END AS a, CASE WHEN p_size / 25.0 <= 1 THEN p_size / 25.0 END AS b,
               CAST(p_size AS DOUBLE) AS c, CASE WHEN p_size > 40 THEN NULL ELSE p_size - 1.0 END AS d FROM part))""",
    "", "shares_short short_percent_of_float days_to_cover shares_short_prior change_in_shares_short change_percent"))
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_retailprice") - 1000).alias("shares_short"), (F.col("p_size") / 25.0).alias("short_percent_of_float"),
        F.col("p_size").cast("string").alias("days_to_cover"), F.when(F.col("p_size") > 40, F.lit("n/a")).otherwise((F.col("p_size") - 1).cast("string")).alias("shares_short_prior"))
    return positioning.short_interest_metrics(rows)
