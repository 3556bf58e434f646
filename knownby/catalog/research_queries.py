"""Research outputs, text and pipelines (groups M, N, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownby.catalog.base import cte, oracle, register, supplier_regions, table, weekly_features, weekly_sums
from knownby.catalog.pit_queries import WEEK_AS_OF, WEEK_AT
from knownby.catalog.series_queries import frame, two_factor_sql, zscore_sql
from knownby.functions.ids import iso_instant, research_id
from knownby.operators import filings, research, screens
from knownby.plans import daily, workflows
from knownby.session import materialize

REQUEST = daily.DailyRequest("all", "2001-06-30T00:00:00+00:00", "2001-07-01T00:00:00+00:00", "fixture", lookback_days=5000)
_END = "DATE '2001-06-30'"


def instruments(spark, sf):
    """Weekly bars of suppliers, their regions and the market, as canonical price bars."""
    sums = materialize(weekly_sums(spark, sf))
    placed = sums.join(supplier_regions(spark, sf), "security_id")
    totals = [F.sum("amount").alias("amount"), F.sum("units").alias("units")]
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("security_id")
    rows = sums.select(text("S", "security_id"), "session_date", "amount", "units")
    # The market is the sum of the regions.
    regions = materialize(placed.groupBy("region", "session_date").agg(*totals))
    rows = rows.unionByName(regions.select(text("R", "region"), "session_date", "amount", "units"))
    rows = rows.unionByName(regions.groupBy(F.lit("MKT").alias("security_id"), "session_date").agg(*totals))
    at = F.col("session_date").cast("timestamp")
    return rows.select(
        "security_id", "session_date", F.lit("1d").alias("frequency"), at.alias("effective_at"),
        (at + F.expr("interval 6 hours")).alias("available_at"), (at + F.expr("interval 12 hours")).alias("ingested_at"),
        F.try_divide(F.col("amount").cast("double"), F.col("units").cast("double")).alias("close"),
        F.lit(None).cast("double").alias("adjusted_close"), (F.col("units") / F.lit(100.0)).alias("volume"), F.lit("fixture").alias("source"),
        F.concat_ws(":", "security_id", F.col("session_date").cast("string")).alias("source_record_id"),
        F.date_format("session_date", "'batch-'yyyy").alias("ingestion_batch_id"))


def coverage(spark, sf):
    start = F.lit("1995-01-01 00:00:00").cast("timestamp")
    return supplier_regions(spark, sf).select(
        F.lit("all").alias("coverage_list_id"), F.concat(F.lit("S"), F.col("security_id").cast("string")).alias("security_id"),
        F.concat(F.lit("R"), F.col("region").cast("string")).alias("benchmark_security_id"), start.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"))


def market_mappings(spark, sf):
    """Suppliers in good standing follow the market; the others have a sector only."""
    return table(spark, sf, "supplier").where("s_acctbal >= 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("security_id"), F.lit("MKT").alias("benchmark_security_id"),
        F.lit("market").alias("kind"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))


def holdings(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal < 8000").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("security_id"), (F.col("s_acctbal") / 100000).alias("weight"))


def run(spark, sf):
    return daily.daily_research(REQUEST, members=coverage(spark, sf), mappings=market_mappings(spark, sf), bars=instruments(spark, sf),
                                weights=holdings(spark, sf))


_TR = "OVER (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN @ PRECEDING AND CURRENT ROW)"
_F = frame(126, 1)
#: Up to the daily run's own instant, and (``_all``) over all bars.
for _x, _and in (("", f"WHERE session_date <= {_END}"), ("_all", "")):
    cte(f"day_base{_x}", f"""SELECT w.*, s.s_acctbal, s.s_acctbal < 0 AS single, CASE WHEN s.s_acctbal < 0 THEN w.sec_ret ELSE w.mkt_ret END AS f1,
 ln(1 + close * volume) AS lv, (1 + ret) / nullif(1 + sec_ret, 0) - 1 AS rel FROM weekly_panel w JOIN supplier s ON s.s_suppkey = w.security_id {_and}""", ["weekly_panel"])
    cte(f"day_two{_x}", two_factor_sql(f"day_base{_x}"), [f"day_base{_x}"])
    cte(f"day_one{_x}", f"""SELECT security_id, session_date, CASE WHEN ok THEN my + cxy / vx * (sec_ret - mx) END AS expected,
 CASE WHEN ok THEN sqrt(greatest((n - 1) * (vy - cxy / vx * cxy) / (n - 2), 0)) END AS sigma1 FROM
 (SELECT *, n >= 63 AND vx > 0 AND sec_ret IS NOT NULL AS ok FROM
 (SELECT security_id, session_date, sec_ret, count(y) {_F} AS n, avg(y) {_F} AS my, avg(x) {_F} AS mx, var_samp(y) {_F} AS vy, var_samp(x) {_F} AS vx, covar_samp(y, x) {_F} AS cxy
  FROM (SELECT *, CASE WHEN ret IS NOT NULL AND sec_ret IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND sec_ret IS NOT NULL THEN sec_ret END AS x FROM day_base{_x})))""", [f"day_base{_x}"])
    cte(f"day_rest{_x}", f"""SELECT security_id, session_date, s_acctbal, single, ret, f1, sec_ret, {zscore_sql('lv', 20, 20)} AS volume_zscore,
 CASE WHEN count(ret) {_TR.replace('@', '19')} >= 20 THEN stddev_samp(ret) {_TR.replace('@', '19')} * sqrt(252) END AS realized_volatility_20d,
 CASE WHEN count(y) {_F} >= 63 AND count(f1) {_F} >= 63 AND var_samp(f1) {_F} > 0 THEN covar_samp(y, x) {_F} / var_samp(f1) {_F} END AS beta_126d,
 CASE WHEN count(rel) {_TR.replace('@', '62')} >= 63 THEN product(1 + rel) {_TR.replace('@', '62')} - 1 END AS relative_return_sector_63d,
 count(ret) OVER (PARTITION BY security_id ORDER BY session_date ROWS UNBOUNDED PRECEDING) AS observations
 FROM (SELECT *, CASE WHEN ret IS NOT NULL AND f1 IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND f1 IS NOT NULL THEN f1 END AS x FROM day_base{_x})""", [f"day_base{_x}"])
    cte(f"day_features{_x}", f"""SELECT 'S' || CAST(r.security_id AS VARCHAR) AS security_id, r.session_date, r.s_acctbal, r.ret AS daily_return, r.f1 AS benchmark_return, r.sec_ret AS sector_return, r.observations,
 CASE WHEN r.observations >= 63 THEN r.ret - CASE WHEN r.single THEN o.expected ELSE t.b0 + t.b1 * t.mkt_ret + t.b2 * t.sec_ret END END AS residual_return,
 CASE WHEN r.observations >= 63 THEN (r.ret - CASE WHEN r.single THEN o.expected ELSE t.b0 + t.b1 * t.mkt_ret + t.b2 * t.sec_ret END) / nullif(CASE WHEN r.single THEN o.sigma1 ELSE t.sigma END, 0) END AS residual_zscore,
 r.volume_zscore, r.realized_volatility_20d, CASE WHEN r.observations >= 63 THEN r.beta_126d END AS beta_126d, r.relative_return_sector_63d
FROM day_rest{_x} r JOIN day_one{_x} o USING (security_id, session_date) JOIN day_two{_x} t USING (security_id, session_date)""", [f"day_rest{_x}", f"day_one{_x}", f"day_two{_x}"])
    cte(f"day_last{_x}", f"SELECT * FROM day_features{_x} QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) = 1", [f"day_features{_x}"])
_SEVEN = "daily_return residual_return residual_zscore volume_zscore realized_volatility_20d beta_126d relative_return_sector_63d"


@register("o1_member_benchmarks", oracle(
    f"""SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS security_id, CASE WHEN s_acctbal >= 0 THEN 'MKT' END AS market_id, 'R' || CAST(region AS VARCHAR) AS sector_id
        FROM supplier JOIN supplier_regions ON security_id = s_suppkey""", "supplier_regions"))
def _(spark, sf):
    out = daily.member_benchmarks(coverage(spark, sf), market_mappings(spark, sf), as_of=REQUEST.as_of)
    return out.select("security_id", "market_id", "sector_id")


@register("o3_daily_price_features", oracle(
    f"SELECT security_id, session_date, observations, {', '.join(_SEVEN.split())} FROM day_last", "day_last", _SEVEN, "session_date"))
def _(spark, sf):
    return run(spark, sf).snapshots.select("security_id", "session_date", "observations", *_SEVEN.split())


_LONG = " UNION ALL ".join(
    f"SELECT security_id, '{name}' AS feature_name, {column} AS value, '{unit}' AS unit, '{window}' AS \"window\", CAST(session_date AS TIMESTAMP) AS effective_at, greatest(CAST(session_date AS TIMESTAMP), rl, CASE WHEN s_acctbal >= 0 THEN ml END) + INTERVAL 6 HOUR AS available_at FROM day_stamped WHERE {column} IS NOT NULL"
    for name, column, unit, window in daily.FEATURES)


cte("day_stamped", f"""SELECT d.*, CAST(r.rl AS TIMESTAMP) AS rl, CAST((SELECT max(session_date) FROM weekly_sums WHERE session_date <= {_END}) AS TIMESTAMP) AS ml FROM day_last d
JOIN (SELECT 'S' || CAST(security_id AS VARCHAR) AS security_id, max(session_date) OVER (PARTITION BY region) AS rl FROM
 (SELECT security_id, region, max(session_date) AS session_date FROM weekly_sums JOIN supplier_regions USING (security_id) WHERE session_date <= {_END} GROUP BY 1, 2)) r USING (security_id)""",
    ["day_last", "weekly_sums", "supplier_regions"])


@register("o4_long_features", oracle(_LONG, "day_stamped", "value", stamps="effective_at available_at"))
def _(spark, sf):
    out = run(spark, sf).features
    return out.select("security_id", "feature_name", "value", "unit", "window", "effective_at", "available_at")


@register("o5_run_status", oracle(
    """SELECT count(*) AS members, count(*) FILTER (WHERE bars < 200) AS failures, CASE WHEN count(*) FILTER (WHERE bars < 200) >= count(*) THEN 'failed'
       WHEN count(*) FILTER (WHERE bars < 200) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM (SELECT security_id, count(*) AS bars FROM weekly_sums GROUP BY 1)""", "weekly_sums"))
def _(spark, sf):
    bars = weekly_sums(spark, sf).groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"))
    return daily.run_status(bars, bars.where("bars < 200"))


_KEY = "'daily:' || sha256('all|2001-06-30T00:00:00+00:00|2001-07-01T00:00:00+00:00|fixture|knownby-v0|equity-mvp-v0|' || b)"
cte("day_run", f"""SELECT {_KEY} AS run_key FROM (SELECT string_agg(x, '|' ORDER BY x) AS b FROM (SELECT DISTINCT 'batch-' || CAST(year(session_date) AS VARCHAR) AS x FROM weekly_sums WHERE session_date <= {_END}))""", ["weekly_sums"])


def uuid_sql(namespace: str, name: str) -> str:
    """RFC 4122 version 5 identifier in SQL."""
    h = f"sha1(from_hex('{namespace.replace('-', '')}') || encode({name}))"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
            f"substr('89ab89ab89ab89ab', CAST('0x' || substr({h}, 17, 1) AS INT) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)")


_NS = "656fba2e-f396-4efd-a529-a2b63d810576"


@register("m5_m6_run_identity", oracle(
    f"SELECT run_key, {uuid_sql(_NS, chr(39) + 'run:' + chr(39) + ' || run_key')} AS research_run_id FROM day_run", "day_run"))
def _(spark, sf):
    return run(spark, sf).run.select("run_key", "research_run_id")


_COMPONENTS = {"estimate_change": 0.20, "abnormal_price": 0.15, "abnormal_volume": 0.10, "valuation_change": 0.10, "event_novelty": 0.10, "thesis_relevance": 0.15}


def _tier(x: str) -> str:
    return f"CASE WHEN {x} >= 0.8 THEN 'critical' WHEN {x} >= 0.65 THEN 'material' WHEN {x} >= 0.3 THEN 'watch' ELSE 'routine' END"


@register("m1_materiality_score", oracle(
    f"""SELECT p_partkey, raw AS raw_score, completeness, m AS priority_modifier, raw * m AS priority_score, {_tier('raw')} AS materiality_tier FROM
        (SELECT p_partkey, {' + '.join(f'coalesce(v * {w}, 0)' for w in _COMPONENTS.values())} AS raw, CASE WHEN v IS NULL THEN 0 ELSE {sum(_COMPONENTS.values())} END AS completeness,
           1 + sqrt(CASE WHEN wt IS NULL THEN 0 ELSE least(abs(wt), 10) END) AS m
         FROM (SELECT p_partkey, CASE WHEN p_size <= 45 THEN p_size / 45.0 END AS v, CASE WHEN p_size > 5 THEN p_retailprice / 1000 - 1.2 END AS wt FROM part))""",
    "", "raw_score completeness priority_modifier priority_score"))
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") <= 45, F.col("p_size") / 45.0).alias("v"), F.when(F.col("p_size") > 5, F.col("p_retailprice") / 1000 - 1.2).alias("wt"))
    out = research.score_materiality(rows, research.Materiality(), {c: "v" for c in _COMPONENTS}, position_weight="wt")
    return out.select("p_partkey", "raw_score", "completeness", "priority_modifier", "priority_score", "materiality_tier")


cte("day_scores", f"""SELECT *, 0.15 * coalesce(cp, 0) + 0.10 * coalesce(cv, 0) + 0.10 * coalesce(cf, 0) + 0.10 * coalesce(cn, 0) AS raw_score,
 CASE WHEN cp IS NULL THEN 0 ELSE 0.15 END + CASE WHEN cv IS NULL THEN 0 ELSE 0.10 END + CASE WHEN cf IS NULL THEN 0 ELSE 0.10 END + CASE WHEN cn IS NULL THEN 0 ELSE 0.10 END AS completeness,
 coalesce(abs(residual_zscore) >= 2, false) AS price, coalesce(abs(volume_zscore) >= 2, false) AS vol FROM
 (SELECT *, greatest(cp, cv) AS cn FROM (SELECT *, CASE WHEN s_acctbal < 8000 THEN s_acctbal / 100000 END AS position_weight,
   CASE WHEN residual_zscore IS NOT NULL THEN least(abs(residual_zscore) / 4, 1) END AS cp, CASE WHEN volume_zscore IS NOT NULL THEN least(abs(volume_zscore) / 4, 1) END AS cv,
   CASE WHEN relative_return_sector_63d IS NOT NULL THEN least(abs(relative_return_sector_63d) / 0.2, 1) END AS cf FROM day_last))""", ["day_last"])


@register("m3_m4_price_findings", oracle(
    f"""SELECT security_id, raw_score, completeness, raw_score * (1 + sqrt(coalesce(abs(position_weight), 0))) AS priority_score, {_tier('raw_score')} AS materiality_tier,
        CASE WHEN price THEN 'price_anomaly' WHEN vol THEN 'volume_anomaly' ELSE 'other' END AS category,
        CASE WHEN price THEN CASE WHEN residual_zscore < 0 THEN 'negative' ELSE 'positive' END WHEN vol THEN CASE WHEN volume_zscore > 0 THEN 'high' ELSE 'low' END END AS direction,
        CASE WHEN price THEN 'Abnormal residual price move' WHEN vol THEN 'Unusual trading volume' ELSE 'Daily quantitative snapshot' END AS title,
        CASE WHEN observations >= 252 AND completeness >= 0.35 THEN 'high' WHEN observations >= 126 THEN 'medium' ELSE 'low' END AS confidence,
        {' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in _SEVEN.split())} AS metric_count FROM day_scores""",
    "day_scores", "raw_score completeness priority_score"))
def _(spark, sf):
    out = run(spark, sf).findings
    return out.select("security_id", "raw_score", "completeness", "priority_score", "materiality_tier", "category", "direction", "title", "confidence", F.size("metrics").alias("metric_count"))


@register("m5_m7_bar_evidence", oracle(
    f"""SELECT {uuid_sql(_NS, "'evidence:events:' || CAST(event_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00'")} AS evidence_id,
        CAST(event_id AS VARCHAR) AS source_record_id FROM events"""))
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.lit("events").alias("source"), F.col("event_id").cast("string").alias("source_record_id"), F.col("ts").alias("effective_at"), F.col("ts").alias("available_at"), F.col("ts").alias("ingested_at"))
    return research.price_bar_evidence(rows).select("evidence_id", "source_record_id")


@register("b14_evidence_violations", oracle("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'"))
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("available_at"))
    return research.evidence_violations(rows, data_cutoff_at="2024-01-15T12:00:00+00:00").select("event_id")


_KINDS = (("price_anomaly", 0.4, "watch", "medium", "p"), ("volume_anomaly", 0.1, "routine", "low", "v"), ("other", 0.7, "material", "high", "o"))


def findings(spark, sf):
    """Three findings per supplier with overlapping metrics and evidence."""
    at = F.lit("2001-06-25 00:00:00").cast("timestamp")
    parts = []
    for kind, base, tier, confidence, mark in _KINDS:
        key = F.concat(F.lit(mark + ":"), F.col("s_suppkey").cast("string"))
        metric = F.struct(F.lit("daily_return").alias("name"), (F.col("s_acctbal") / 10000 + base).alias("value"), F.lit("decimal_return").alias("unit"), F.lit("1d").alias("horizon"), at.alias("as_of"))
        own = F.struct(F.lit(mark + "_score").alias("name"), (F.col("s_nationkey") + base).alias("value"), F.lit("zscore").alias("unit"), F.lit(None).cast("string").alias("horizon"), at.alias("as_of"))
        parts.append(table(spark, sf, "supplier").select(
            F.lit("run-1").alias("research_run_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("security_id"), key.alias("finding_key"),
            key.alias("finding_id"), F.lit(kind).alias("category"), F.lit(kind + " seen.").alias("change"), (base + F.abs(F.col("s_acctbal")) / 20000).alias("raw_score"),
            (base + F.abs(F.col("s_acctbal")) / 20000 * (2.0 if mark == "p" else 1.0)).alias("priority_score"), F.lit(tier).alias("materiality_tier"), F.lit(confidence).alias("confidence"),
            at.alias("as_of"), F.array(metric, own).alias("metrics"), F.array(F.lit("shared"), key).alias("evidence_ids")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


cte("findings", " UNION ALL ".join(
    f"""SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS security_id, '{m}:' || CAST(s_suppkey AS VARCHAR) AS finding_key, '{k}' AS category, {b} + abs(s_acctbal) / 20000 AS raw_score,
        {b} + abs(s_acctbal) / 20000 * {2.0 if m == 'p' else 1.0} AS priority_score, s_acctbal / 10000 + {b} AS ret, s_acctbal FROM supplier""" for k, b, _t, _c, m in _KINDS))
cte("cards", """SELECT security_id, any_value(s_acctbal) AS s_acctbal, 'material' AS materiality_tier, 'low' AS confidence, string_agg(finding_key, ',' ORDER BY priority_score DESC, finding_key) AS finding_ids,
 string_agg(category || ' seen.', ' ' ORDER BY priority_score DESC, finding_key) AS change, arg_max(ret, priority_score) AS first_return, arg_max(category, priority_score) AS lead_category,
 (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT unnest(list_append(list(finding_key), 'shared')) AS e)) AS evidence_ids FROM findings GROUP BY 1""", ["findings"])


def cards(spark, sf):
    context = table(spark, sf, "supplier").select(
        F.lit("run-1").alias("research_run_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("security_id"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 70000).alias("position_weight"), (F.col("s_acctbal") / 30000).alias("daily_return"))
    return research.build_cards(findings(spark, sf), context)


@register("m8_research_cards", oracle(
    """SELECT security_id, materiality_tier, confidence, finding_ids, evidence_ids, change, first_return, CASE WHEN s_acctbal > 0 THEN s_acctbal / 70000 * s_acctbal / 30000 * 10000 END AS contribution_bps,
       CASE lead_category WHEN 'price_anomaly' THEN 'Is the residual move explained by new fundamental evidence or a temporary dislocation?' WHEN 'volume_anomaly' THEN 'What catalyst or positioning change explains the abnormal volume?'
         ELSE 'Which new data would most change the current research thesis?' END AS next_research_question FROM cards""", "cards", "first_return contribution_bps"))
def _(spark, sf):
    first = F.filter("quant_evidence", lambda m: m["name"] == "daily_return")
    return cards(spark, sf).withColumn("first_return", first[0]["value"]).select(
        "security_id", "materiality_tier", "confidence", "finding_ids", "evidence_ids", "change", "first_return", "contribution_bps", "next_research_question")


_MD = r"""chr(35) || ' ' || security_id || ' — MATERIAL' || chr(10) || chr(10) || '## Change' || chr(10) || chr(10) || change || chr(10) || chr(10) || '## Quant evidence' || chr(10) || chr(10)
 || '- daily_return (1d): ' || printf('%.2f', first_return * 100) || '%' || chr(10) || '- o_score: ' || printf('%+.2f', nation + 0.7) || ' sigma' || chr(10) || '- p_score: ' || printf('%+.2f', nation + 0.4) || ' sigma' || chr(10) || '- v_score: ' || printf('%+.2f', nation + 0.1) || ' sigma'
 || chr(10) || chr(10) || '## Context' || chr(10) || chr(10) || CASE WHEN s_acctbal > 0 THEN '- Position weight: ' || printf('%.2f', s_acctbal / 70000 * 100) || '%' || chr(10) || '- Indicative daily contribution: ' || printf('%+.1f', s_acctbal / 70000 * (s_acctbal / 30000) * 10000) || ' bps' || chr(10)
   || '- Contribution is a simple weight x return estimate, not accounting-grade attribution.' ELSE '- Not held or holdings context unavailable.' END
 || chr(10) || chr(10) || '## Thesis impact' || chr(10) || chr(10) || 'None' || chr(10) || chr(10) || '## Confidence' || chr(10) || chr(10) || 'Low' || chr(10) || chr(10) || '## Next research question' || chr(10) || chr(10)
 || CASE lead_category WHEN 'price_anomaly' THEN 'Is the residual move explained by new fundamental evidence or a temporary dislocation?' WHEN 'volume_anomaly' THEN 'What catalyst or positioning change explains the abnormal volume?' ELSE 'Which new data would most change the current research thesis?' END || chr(10)"""
cte("markdown", f"SELECT security_id, {_MD} AS markdown FROM cards JOIN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS security_id, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier) USING (security_id)", ["cards"])


@register("m9_card_markdown", oracle("SELECT * FROM markdown", "markdown"))
def _(spark, sf):
    out = research.render_card_markdown(cards(spark, sf).withColumn("security_label", F.col("security_id")))
    return out.select("security_id", "markdown")


@register("m10_morning_brief", oracle(
    """SELECT count(*) AS cards, chr(35) || ' Morning research brief' || chr(10) || chr(10) || string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY security_id) AS brief
       FROM (SELECT * FROM markdown ORDER BY security_id LIMIT 8)""", "markdown"))
def _(spark, sf):
    return research.morning_brief(cards(spark, sf).withColumn("security_label", F.col("security_id")))


@register("m11_inbox", oracle(
    "SELECT o_orderkey AS card_id, CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'watch' ELSE 'routine' END AS materiality_tier, o_orderdate AS as_of FROM orders WHERE o_orderstatus IN ('F', 'O')", "", stamps="as_of"))
def _(spark, sf):
    tier = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "watch").otherwise("routine")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("card_id"), tier.alias("materiality_tier"), F.col("o_orderdate").alias("as_of"))
    return research.inbox(rows)


_FB = {"click": "useful", "view": "noise", "signup": "already_known", "purchase": "wrong", "error": "investigate"}


@register("m12_feedback_counts", oracle(
    "SELECT c_custkey AS card_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {k}" for e, k in _FB.items()) + " FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"))
def _(spark, sf):
    kind = F.lit(None).cast("string")
    for event, name in _FB.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    feedback = table(spark, sf, "events").select(F.col("user_id").alias("card_id"), kind.alias("kind"))
    return research.feedback_counts(table(spark, sf, "customer").select(F.col("c_custkey").alias("card_id")), feedback)


# -- text ----------------------------------------------------------------------

_CLAIM = r"(^|[^\p{L}\p{N}_])([$€£]?[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:\s*(?:%|bps?\b|x\b))?)"
cte("claim_docs", r"""SELECT doc_id, n_chars, text || ' Total of ' || CAST(n_chars AS VARCHAR) || ' characters, up 5% or 12.5 bps at $3, ratio 2x.' AS body FROM documents""")
cte("claim_raw", rf"""SELECT doc_id, n_chars, unnest(regexp_extract_all(replace(body, '%', '%%'), '{_CLAIM}', 2, 'i')) AS raw, generate_subscripts(regexp_extract_all(replace(body, '%', '%%'), '{_CLAIM}', 2, 'i'), 1) - 1 AS position FROM claim_docs""", ["claim_docs"])
cte("claims", r"""SELECT doc_id, n_chars, position, raw, u,
 CASE WHEN u = '%' THEN 'percent' WHEN u LIKE 'bp%' THEN 'basis_points' WHEN u = 'x' THEN 'multiple' WHEN regexp_matches(raw, '^[$€£]') THEN 'currency' ELSE 'number' END AS unit,
 CAST(regexp_replace(raw, '[^0-9.+-]', '', 'g') AS DOUBLE) / CASE WHEN u = '%' THEN 100.0 WHEN u LIKE 'bp%' THEN 10000.0 ELSE 1.0 END AS value
FROM (SELECT *, lower(regexp_replace(raw, '[^%a-zA-Z]', '', 'g')) AS u FROM claim_raw)""", ["claim_raw"])


def claim_docs(spark, sf):
    """Whole documents followed by a sentence that states numbers."""
    body = F.concat("text", F.lit(" Total of "), F.col("n_chars").cast("string"), F.lit(" characters, up 5% or 12.5 bps at $3, ratio 2x."))
    return table(spark, sf, "documents").select("doc_id", "n_chars", body.alias("text"))


@register("n1_numeric_claims", oracle("SELECT doc_id, position, raw, value, unit, true AS found_there FROM claims", "claims", "value"))
def _(spark, sf):
    docs = claim_docs(spark, sf)
    claims = filings.extract_numeric_claims(docs).join(docs.select("doc_id", "text"), "doc_id")
    there = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("raw")
    return claims.select("doc_id", "position", "raw", "value", "unit", there.alias("found_there"))


@register("n2_validate_claims", oracle(
    """SELECT doc_id, count(*) AS claims, count(*) FILTER (WHERE NOT ok) AS unsupported, bool_and(ok) AS numbers_valid FROM
       (SELECT doc_id, (unit = 'number' AND abs(value - n_chars) <= greatest(1e-6 * greatest(abs(value), n_chars), 0)) OR (unit = 'percent' AND abs(value - 0.05) <= greatest(1e-6 * greatest(abs(value), 0.05), 0.001))
          OR (unit = 'multiple' AND abs(value - 2) <= 0.5) OR (unit = 'basis_points' AND abs(value - 0.00125) <= 1e-6 * greatest(abs(value), 0.00125)) AS ok FROM claims) GROUP BY 1""", "claims"))
def _(spark, sf):
    fact = lambda v, u, t: F.struct(v.cast("double").alias("value"), F.lit(u).alias("unit"), F.lit(float(t)).alias("absolute_tolerance"))
    facts = F.array(fact(F.col("n_chars"), "number", 0), fact(F.lit(0.05), "percent", 0.001), fact(F.lit(2), "multiple", 0.5), fact(F.lit(0.00125), "basis_points", 0))
    out = filings.validate_numeric_claims(claim_docs(spark, sf).withColumn("facts", facts))
    return out.select("doc_id", F.size("claims").alias("claims"), F.size("unsupported_claims").alias("unsupported"), "numbers_valid")


@register("n3_evidence_presence", oracle("SELECT doc_id, trim(lang) <> '' AND n_chars % 3 <> 0 AS has_evidence FROM documents"))
def _(spark, sf):
    ids = F.array("lang", F.when(F.col("n_chars") % 3 == 0, " ").otherwise(F.col("source")))
    return table(spark, sf, "documents").select("doc_id", filings.has_evidence(ids).alias("has_evidence"))


def headed_docs(spark, sf):
    """Whole documents with a filing-like frame of headings around them."""
    body = F.concat(
        F.lit("RISK FACTORS\n"), F.col("lang"), F.lit("\n\nMANAGEMENT DISCUSSION & ANALYSIS\n"), F.col("text"), F.lit("\nRISK FACTORS\n"), F.col("source"), F.lit("\nEXHIBITS\n \n"))
    return table(spark, sf, "documents").select("doc_id", body.alias("text"))


cte("headed", r"""SELECT doc_id, 'RISK FACTORS' || chr(10) || lang || chr(10) || chr(10) || 'MANAGEMENT DISCUSSION & ANALYSIS' || chr(10) || text || chr(10) || 'RISK FACTORS' || chr(10) || source || chr(10) || 'EXHIBITS' || chr(10) || ' ' || chr(10) AS body FROM documents""")
cte("parts", r"""SELECT doc_id, unnest(list_slice(p, 2, len(p))) AS part, generate_subscripts(list_slice(p, 2, len(p)), 1) AS k FROM
 (SELECT doc_id, string_split(regexp_replace(body, '(?m)^(?:item\s+\d+[a-z]?\.?\s*)?([A-Z][A-Z\s&/-]{3,})$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM headed)""", ["headed"])
cte("sections", r"""SELECT doc_id, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(regexp_replace(trim(string_split(part, chr(2))[1], ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g'), ' ')], ' ') AS section,
 regexp_replace(regexp_replace(substr(part, instr(part, chr(2)) + 1), '^\s+', ''), '\s+$', '') AS body, k FROM parts""", ["parts"])
cte("kept_sections", "SELECT doc_id, section, body FROM sections WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY k DESC) = 1", ["sections"])


@register("n4_sections", oracle("SELECT doc_id, section, md5(body) AS body_hash FROM kept_sections", "kept_sections"))
def _(spark, sf):
    return filings.segment_sections(headed_docs(spark, sf)).select("doc_id", "section", F.md5(F.encode("body", "UTF-8")).alias("body_hash"))


cte("lines", r"SELECT doc_id, section, line, count(*) AS c FROM (SELECT doc_id, section, unnest(regexp_split_to_array(body, '\r\n|\n|\r')) AS line FROM kept_sections) GROUP BY 1, 2, 3", ["kept_sections"])


@register("n5_compare_versions", oracle(
    r"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY change_ratio DESC, section) AS change_rank FROM (SELECT pair AS doc_id, section,
       array_to_string(list_sort(flatten(list(CASE WHEN shown THEN list_transform(range(greatest(now - before, 0)), lambda i: stripped) ELSE [] END))), ',') AS added,
       array_to_string(list_sort(flatten(list(CASE WHEN shown THEN list_transform(range(greatest(before - now, 0)), lambda i: stripped) ELSE [] END))), ',') AS removed,
       CAST(sum(CASE WHEN shown THEN greatest(now - before, 0) ELSE 0 END) AS BIGINT) AS added_lines, CAST(sum(CASE WHEN shown THEN greatest(before - now, 0) ELSE 0 END) AS BIGINT) AS removed_lines,
       1 - 2.0 * sum(least(now, before)) / sum(now + before) AS change_ratio FROM
       (SELECT coalesce(p.doc_id + 1, c.doc_id) AS pair, coalesce(p.section, c.section) AS section, coalesce(c.c, 0) AS now, coalesce(p.c, 0) AS before, regexp_matches(coalesce(p.line, c.line), '\S') AS shown, regexp_replace(coalesce(p.line, c.line), '^\s+|\s+$', '', 'g') AS stripped
        FROM lines p FULL JOIN lines c ON c.doc_id = p.doc_id + 1 AND c.section = p.section AND c.line = p.line)
       WHERE pair IN (SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1) GROUP BY 1, 2
       HAVING sum(CASE WHEN shown THEN abs(now - before) ELSE 0 END) > 0)""", "lines", "change_ratio"))
def _(spark, sf):
    docs = headed_docs(spark, sf)
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("previous"))
    out = filings.compare_versions(docs.withColumnRenamed("text", "current").join(before, "doc_id"), key="doc_id", previous="previous", current="current")
    return out.withColumns({c: F.sort_array(c) for c in ("added", "removed")})


@register("n6_evidence_evaluation", oracle(
    """SELECT p_partkey, CASE WHEN p_size > 10 THEN 0.5 ELSE 0.0 END AS evidence_precision, CASE WHEN p_size > 10 THEN 1.0 ELSE 0.0 END AS evidence_recall, CASE WHEN p_size > 20 THEN 20.0 / p_size ELSE 1.0 END AS numerical_accuracy FROM part""",
    "", "evidence_precision evidence_recall numerical_accuracy"))
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.array("p_brand", "p_type").alias("got"), F.when(F.col("p_size") > 10, F.array("p_type")).otherwise(F.array(F.lit("none"))).alias("want"),
        F.col("p_size").alias("claims"), F.least(F.col("p_size"), F.lit(20)).alias("supported"))
    out = filings.evaluate_evidence(rows, predicted="got", expected="want", claims="claims", supported="supported")
    return out.select("p_partkey", "evidence_precision", "evidence_recall", "numerical_accuracy")


@register("n7_structured_query", oracle(
    "SELECT security_id, finding_key, category, raw_score FROM findings WHERE raw_score >= 0.3 AND category IN ('price_anomaly', 'other') ORDER BY raw_score DESC, finding_key LIMIT 50", "findings", "raw_score"))
def _(spark, sf):
    out = research.structured_query(findings(spark, sf), categories=["price_anomaly", "other"], minimum_materiality=0.3, limit=50)
    return out.select("security_id", "finding_key", "category", "raw_score")


# -- pipelines -------------------------------------------------------------------


@register("o6_daily_cards", oracle(
    f"""SELECT security_id, {_tier('raw_score')} AS materiality_tier, CASE WHEN observations >= 252 AND completeness >= 0.35 THEN 'high' WHEN observations >= 126 THEN 'medium' ELSE 'low' END AS confidence,
        position_weight * daily_return * 10000 AS contribution_bps, benchmark_return, sector_return, CASE WHEN price THEN 'The cause of the residual move is not yet resolved.' END AS key_risk_or_opportunity FROM day_scores""",
    "day_scores", "contribution_bps benchmark_return sector_return"))
def _(spark, sf):
    return run(spark, sf).cards.select("security_id", "materiality_tier", "confidence", "contribution_bps", "benchmark_return", "sector_return", "key_risk_or_opportunity")


@register("o7_close_workflow", oracle(
    f"SELECT security_id, {', '.join(_SEVEN.split())} FROM day_last", "day_last", _SEVEN))
def _(spark, sf):
    lists = table(spark, sf, "region").select(F.lit("all").alias("coverage_list_id"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("created_at"))
    # All bars, later ones too: the request's own instants choose. The newest of all would be beyond the cutoff, so as_of is given.
    bars = instruments(spark, sf)
    positions = holdings(spark, sf).withColumn("snapshot_id", F.lit("p1"))
    snapshots = table(spark, sf, "region").agg(F.count(F.lit(1)).alias("n")).select(F.lit("p1").alias("snapshot_id"), F.lit("book").alias("portfolio_name"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("as_of"))
    out = workflows.close_workflow(coverage_lists=lists, members=coverage(spark, sf), mappings=market_mappings(spark, sf), bars=bars, snapshots=snapshots,
                                   positions=positions, source="fixture", data_cutoff_at="2001-07-01T00:00:00+00:00", as_of=REQUEST.as_of, lookback_days=5000)
    return out.snapshots.select("security_id", *_SEVEN.split())


@register("o8_weekly_screen", oracle(
    f"""SELECT security_id, row_number() OVER (ORDER BY relative_return_sector_63d DESC, security_id) AS match_rank FROM
        (SELECT security_id, max(CASE WHEN feature_name = 'relative_return_sector_63d' THEN value END) AS relative_return_sector_63d, max(CASE WHEN feature_name = 'realized_volatility_20d' THEN value END) AS v
         FROM (SELECT * FROM weekly_features WHERE available_at <= {WEEK_AT} QUALIFY row_number() OVER (PARTITION BY security_id, feature_name ORDER BY available_at DESC) = 1) GROUP BY 1)
        WHERE relative_return_sector_63d >= 0.05 AND v IS NOT NULL QUALIFY match_rank <= 25""", "weekly_features"))
def _(spark, sf):
    return workflows.weekly_screen(weekly_features(spark, sf), screens.RELATIVE_STRENGTH_BREAKOUT, as_of=WEEK_AS_OF).select("security_id", "match_rank")


@register("o9_latest_status", oracle(
    "SELECT event_type, ts AS started_at, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1", "", "value", stamps="started_at"))
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("ts").alias("started_at"), "event_id", "value")
    return workflows.latest_status(rows, by=["event_type"])
