"""Normalization, upload, contract and append queries (group A and imports of B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownby.catalog.base import bars_daily, cte, daily_returns, oracle, register, table
from knownby.catalog.pit_queries import (
    WEEK_AS_OF, WEEK_AT, identifiers, mappings, references,
)
from knownby.sources import appends, bars, contracts, identifiers as ids, uploads

cte("raw_bars", """SELECT user_id AS security_id, CAST(ts AS DATE) AS session_date, value AS open, value * 1.5 AS high,
  CASE WHEN event_type = 'error' THEN value * 2 ELSE value * 0.5 END AS low, value AS close,
  CASE WHEN event_type = 'view' THEN -1.0 ELSE 10.0 END AS volume, ts AS available_at, event_id FROM events""")


def raw_bars(spark, sf):
    """One provider row per event; errors break the range, views have negative volume."""
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("security_id"), F.to_date("ts").alias("session_date"), v.alias("open"), (v * 1.5).alias("high"),
        F.when(F.col("event_type") == "error", v * 2).otherwise(v * 0.5).alias("low"), v.alias("close"),
        F.when(F.col("event_type") == "view", -1.0).otherwise(10.0).alias("volume"), F.col("ts").alias("available_at"), "event_id")


cte("clean_bars", """SELECT * FROM raw_bars WHERE open > 0 AND volume >= 0 AND low <= least(open, high, close)
QUALIFY row_number() OVER (PARTITION BY security_id, session_date ORDER BY available_at DESC, event_id DESC) = 1""", ["raw_bars"])
_SEQ = ["available_at", "event_id"]


@register("a1_normalize_prices", oracle(
    "SELECT security_id, session_date, open, high, low, close, volume, close AS adjusted_close, event_id FROM clean_bars",
    "clean_bars", "open high low close volume adjusted_close", "session_date"))
def _(spark, sf):
    kept, _ = bars.normalize_prices(raw_bars(spark, sf), sequence=_SEQ)
    return kept.select("security_id", "session_date", "open", "high", "low", "close", "volume", "adjusted_close", "event_id")


@register("a1_price_rejections", oracle(
    """SELECT event_id, concat_ws(',', CASE WHEN open <= 0 THEN 'non_positive_price' END, CASE WHEN volume < 0 THEN 'negative_volume' END,
       CASE WHEN high < greatest(open, low, close) OR low > least(open, high, close) THEN 'inconsistent_range' END) AS violations
       FROM raw_bars WHERE open <= 0 OR volume < 0 OR high < greatest(open, low, close) OR low > least(open, high, close)""", "raw_bars"))
def _(spark, sf):
    _, rejected = bars.normalize_prices(raw_bars(spark, sf), sequence=_SEQ)
    return rejected.select("event_id", "violations")


@register("a2_quality_report", oracle(
    """SELECT r.security_id, r.n AS input_rows, c.n AS output_rows, r.n - c.n AS duplicate_rows_removed,
       (SELECT count(*) FROM days d WHERE d.session_date BETWEEN c.lo AND c.hi) - c.n AS missing_sessions,
       concat_ws(',', CASE WHEN (SELECT count(*) FROM days d WHERE d.session_date BETWEEN c.lo AND c.hi) - c.n > 0
         THEN CAST((SELECT count(*) FROM days d WHERE d.session_date BETWEEN c.lo AND c.hi) - c.n AS VARCHAR) || ' expected trading sessions are absent' END,
         'adjusted_close was unavailable; price returns will be unadjusted') AS warnings
       FROM (SELECT security_id, count(*) AS n FROM raw_bars GROUP BY 1) r
       JOIN (SELECT security_id, count(*) AS n, min(session_date) AS lo, max(session_date) AS hi FROM clean_bars GROUP BY 1) c USING (security_id)""",
    "raw_bars clean_bars days"))
def _(spark, sf):
    raw = raw_bars(spark, sf)
    kept, _ = bars.normalize_prices(raw, sequence=_SEQ)
    return bars.price_quality_report(raw, kept, calendar=raw.select("session_date").distinct())


cte("days", "SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events")


@register("a3_normalize_releases", oracle(
    """SELECT event_id, period_end, release_timestamp, value - lag1 AS surprise, CASE WHEN event_type = 'view' THEN NULL ELSE value * 0.5 END AS revision, available_at
       FROM (SELECT event_id, event_type, CAST(ts AS DATE) AS period_end, ts AS release_timestamp, ts AS available_at, value,
             CASE WHEN event_type = 'click' THEN NULL ELSE 50.0 END AS lag1 FROM events)""",
    "", "surprise revision", "period_end", "release_timestamp available_at"))
def _(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").select(
        "event_id", F.to_date("ts").cast("string").alias("period_end"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("release_timestamp"),
        v.alias("actual"), F.when(F.col("event_type") != "click", 50.0).alias("consensus"), v.alias("prior"),
        F.when(F.col("event_type") != "view", v * 1.5).alias("revised_prior"), F.col("event_type").alias("source"))
    return bars.normalize_releases(rows).select("event_id", "period_end", "release_timestamp", "surprise", "revision", "available_at")


@register("a4_a5_canonical_identifiers", oracle(
    """SELECT p_partkey, upper(trim(regexp_replace('  ' || p_name || '  x ', '\\s+', ' ', 'g'))) AS identifier,
       CASE regexp_replace(lower(trim(scheme)), '[- ]', '_', 'g') WHEN 'bbgid' THEN 'figi' WHEN 'yahoo' THEN 'yahoo_symbol' ELSE regexp_replace(lower(trim(scheme)), '[- ]', '_', 'g') END AS scheme
       FROM (SELECT *, CASE WHEN p_size > 30 THEN ' BBGID ' WHEN p_size > 15 THEN 'Yahoo' ELSE p_type || '-Ticker' END AS scheme FROM part)"""))
def _(spark, sf):
    scheme = F.when(F.col("p_size") > 30, " BBGID ").when(F.col("p_size") > 15, "Yahoo").otherwise(F.concat("p_type", F.lit("-Ticker")))
    return table(spark, sf, "part").select(
        "p_partkey", ids.canonical_identifier(F.concat(F.lit("  "), "p_name", F.lit("  x "))).alias("identifier"), ids.canonical_scheme(scheme).alias("scheme"))


def holding_rows(spark, sf):
    """Supplier rows as a holdings upload with bad weights and repeated identifiers."""
    return table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 2).alias("row_number"), F.concat(F.lit(" n"), F.col("s_nationkey").cast("string")).alias("identifier"),
        F.when(F.col("s_acctbal") > 9000, "n/a").otherwise((F.col("s_acctbal") / 500).cast("string")).alias("weight"),
        F.lit("TICKER").alias("identifier_scheme"), F.lit("").alias("provider"),
        F.when(F.col("s_acctbal") < 0, "XX").otherwise("XNYS").alias("exchange_mic"))


cte("holding_rows", """SELECT s_suppkey + 2 AS row_number, 'N' || CAST(s_nationkey AS VARCHAR) AS identifier, s_acctbal,
  s_acctbal > 9000 OR abs(s_acctbal / 500) > 10 AS bad_weight, s_acctbal < 0 AS bad_mic FROM supplier""")
cte("holding_good", "SELECT *, min(row_number) OVER (PARTITION BY identifier) AS first FROM holding_rows WHERE NOT bad_weight AND NOT bad_mic", ["holding_rows"])


@register("a6_holdings_upload", oracle(
    "SELECT row_number, identifier, round(s_acctbal / 500, 10) AS weight, 'ticker' AS identifier_scheme, 'XNYS' AS exchange_mic FROM holding_good WHERE row_number = first",
    "holding_good", "weight"))
def _(spark, sf):
    rows, _ = uploads.parse_upload(holding_rows(spark, sf), uploads.HOLDINGS)
    return rows.select("row_number", "identifier", "weight", "identifier_scheme", "exchange_mic")


@register("a6_holdings_issues", oracle(
    """SELECT row_number, 'weight' AS field, 'weight must be finite and expressed as a decimal' AS message FROM holding_rows WHERE bad_weight
       UNION ALL SELECT row_number, 'exchange_mic', 'length must be 4 to 4' FROM holding_rows WHERE bad_mic
       UNION ALL SELECT row_number, 'identifier', 'duplicate security row in the same upload' FROM holding_good WHERE row_number > first""",
    "holding_rows holding_good"))
def _(spark, sf):
    _, issues = uploads.parse_upload(holding_rows(spark, sf), uploads.HOLDINGS)
    return issues.select("row_number", "field", "message")


@register("a7_coverage_upload", oracle(
    "SELECT c_custkey + 2 AS row_number, upper(c_name) AS identifier, c_mktsegment AS peer_group FROM customer"))
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 2).alias("row_number"), F.concat(F.lit(" "), "c_name").alias("identifier"), F.col("c_mktsegment").alias("peer_group"))
    return uploads.parse_upload(rows, uploads.COVERAGE)[0].select("row_number", "identifier", "peer_group")


def universe_rows(spark, sf):
    s = table(spark, sf, "supplier")
    text = lambda c: F.col(c).cast("string")
    return s.select(
        (F.col("s_suppkey") + 2).alias("row_number"), text("s_suppkey").alias("security_id"), F.col("s_name").alias("identifier"),
        F.when(F.col("s_acctbal") > 8000, "vendor").otherwise("ticker").alias("identifier_scheme"), F.col("s_name").alias("name"),
        F.lit("common_stock").alias("security_type"), F.lit("active").alias("status"), F.lit("usd").alias("primary_currency"),
        F.lit("2020-01-01T00:00:00Z").alias("valid_from"),
        F.when(F.col("s_acctbal") < 0, "2019-01-01T00:00:00Z").alias("valid_to"),
        F.concat(F.lit("Supplier#"), F.lpad(text("s_nationkey"), 9, "0")).alias("benchmark"))


@register("a8_universe_issues", oracle(
    """SELECT s_suppkey + 2 AS row_number, 'provider' AS field, 'provider is required for vendor identifiers' AS message FROM supplier WHERE s_acctbal > 8000
       UNION ALL SELECT s_suppkey + 2, 'valid_to', 'valid_to must be later than valid_from' FROM supplier WHERE s_acctbal < 0"""))
def _(spark, sf):
    return uploads.parse_upload(universe_rows(spark, sf), uploads.UNIVERSE)[1].select("row_number", "field", "message")


@register("b22_register_universe", oracle(
    """SELECT CAST(g.s_suppkey AS VARCHAR) AS security_id, CASE WHEN b.s_suppkey IS NULL THEN 'not_found' WHEN b.s_suppkey = g.s_suppkey THEN 'benchmarks_itself' ELSE 'resolved' END AS status,
       CASE WHEN b.s_suppkey <> g.s_suppkey THEN CAST(b.s_suppkey AS VARCHAR) END AS benchmark_security_id
       FROM (SELECT * FROM supplier WHERE s_acctbal BETWEEN 0 AND 8000) g LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal BETWEEN 0 AND 8000) b
       ON b.s_name = 'Supplier#' || lpad(CAST(g.s_nationkey AS VARCHAR), 9, '0')"""))
def _(spark, sf):
    rows, _ = uploads.parse_upload(universe_rows(spark, sf), uploads.UNIVERSE)
    return uploads.register_universe(rows)[2].select("security_id", "status", "benchmark_security_id")


def _request(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("security_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("provider_identifier"),
        F.lit("2024-01-05").cast("date").alias("start_date"), F.lit("2024-01-20").cast("date").alias("end_date"),
        F.when(F.col("c_nationkey") > 12, "b-1").otherwise("b-2").alias("batch"))


def loaded(spark, sf):
    """Every customer requested; only event users have bars."""
    offered = bars_daily(spark, sf).withColumn("provider_identifier", F.concat(F.lit("U"), F.col("security_id").cast("string"))).drop("effective_at", "available_at")
    return bars.load_batch(_request(spark, sf), offered, source="fixture", batch_id=F.col("batch"), ingested_at=F.lit("2024-02-01 00:00:00").cast("timestamp"))


cte("loaded", """SELECT c_custkey AS security_id, b.session_date, b.close, CASE WHEN c_nationkey > 12 THEN 'b-1' ELSE 'b-2' END AS ingestion_batch_id,
  CASE WHEN b.session_date IS NOT NULL THEN 'estimated_timestamp,unadjusted' ELSE '' END AS quality_flags, CAST(b.session_date AS TIMESTAMP) AS effective_at,
  concat_ws(':', 'u' || CAST(c_custkey AS VARCHAR), CAST(b.session_date AS VARCHAR)) AS source_record_id
FROM customer LEFT JOIN bars_daily b ON b.security_id = c_custkey
WHERE b.session_date IS NULL OR b.session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", ["bars_daily"])


@register("a10_load_batch", oracle("SELECT *, close / close AS adjustment_factor FROM loaded", "loaded", "close adjustment_factor", "session_date", "effective_at"))
def _(spark, sf):
    return loaded(spark, sf).select("security_id", "session_date", "close", "ingestion_batch_id", "quality_flags", "effective_at", "source_record_id", "adjustment_factor")


@register("a11_batch_status", oracle(
    """SELECT ingestion_batch_id, count(session_date) AS row_count, count(*) FILTER (WHERE session_date IS NULL) AS missing_symbols,
       CASE WHEN count(session_date) = 0 AND count(*) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE session_date IS NULL) > 0 THEN 'partial' ELSE 'succeeded' END AS status
       FROM loaded GROUP BY 1""", "loaded"))
def _(spark, sf):
    return bars.batch_status(loaded(spark, sf))


@register("a12_batch_violations", oracle(
    """SELECT 'b-1' AS ingestion_batch_id, 'row_count_mismatch' AS violation, CAST(count(*) AS VARCHAR) AS detail FROM loaded WHERE session_date IS NOT NULL AND ingestion_batch_id = 'b-1'
       UNION ALL SELECT 'b-1', 'missing_fingerprint', ''
       UNION ALL SELECT DISTINCT ingestion_batch_id, 'unrequested_security', CAST(security_id AS VARCHAR) FROM loaded JOIN customer ON c_custkey = security_id WHERE session_date IS NOT NULL AND c_acctbal > 9000
       UNION ALL SELECT DISTINCT 'b-2', 'unknown_batch', 'b-2' FROM loaded WHERE session_date IS NOT NULL AND ingestion_batch_id = 'b-2'""", "loaded"))
def _(spark, sf):
    rows = loaded(spark, sf).where("session_date is not null")
    counted = rows.where("ingestion_batch_id = 'b-1'").groupBy("ingestion_batch_id").agg((F.count(F.lit(1)) + 1).alias("row_count"))
    batches = counted.select("ingestion_batch_id", "row_count", F.lit("partial").alias("status"), F.lit("").alias("request_fingerprint"))
    asked = table(spark, sf, "customer").where("c_acctbal <= 9000").select(F.col("c_custkey").alias("security_id"))
    return bars.batch_violations(batches, rows, asked)


@register("a14_bar_contract", oracle(
    """SELECT event_id, concat_ws(',', CASE WHEN available_at > ingested_at THEN 'available_after_ingested' END, CASE WHEN volume < 0 THEN 'negative_volume' END,
       CASE WHEN high < greatest(open, close, low) THEN 'high_below_others' END, CASE WHEN low > least(open, close, high) THEN 'low_above_others' END) AS violations
       FROM (SELECT *, date_trunc('day', available_at) + INTERVAL 12 HOUR AS ingested_at FROM raw_bars)""", "raw_bars"))
def _(spark, sf):
    rows = raw_bars(spark, sf).withColumn("effective_at", F.col("available_at")).withColumn(
        "ingested_at", F.date_trunc("day", "available_at") + F.expr("interval 12 hours")).withColumn(
        "adjusted_close", F.lit(None).cast("double")).withColumn("currency", F.lit("USD"))
    return contracts.check_contract(rows, "bar").select("event_id", "violations")


@register("a14_batch_contract", oracle(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderdate + INTERVAL 1 DAY < d THEN 'started_before_requested' END,
       CASE WHEN o_orderstatus = 'F' THEN 'terminal_without_completion' END) AS violations
       FROM (SELECT *, CASE WHEN o_totalprice > 200000 THEN o_orderdate + INTERVAL 2 DAY ELSE o_orderdate END AS d FROM orders)"""))
def _(spark, sf):
    day = lambda n: F.col("o_orderdate") + F.expr(f"interval {n} days")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, day(2)).otherwise(F.col("o_orderdate")).alias("requested_at"), day(1).alias("started_at"),
        F.when(F.col("o_orderstatus") != "F", day(3)).alias("completed_at"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("status"),
        F.lit(1).alias("row_count"))
    return contracts.check_contract(rows, "batch").select("o_orderkey", "violations")


def _stored_and_incoming(spark, sf):
    """Stored: bars up to the 20th. Incoming: bars from the 10th, changed on the 12th, doubled on the 25th."""
    rows = bars_daily(spark, sf).withColumn("frequency", F.lit("1d")).withColumn("source", F.lit("events")).withColumn("adjusted_close", F.col("close"))
    day = F.dayofmonth("session_date")
    stored = rows.where(day <= 20)
    fresh = rows.where(day >= 10).withColumn("close", F.when(day == 12, F.col("close") + 1).otherwise(F.col("close")))
    return stored, fresh.unionByName(fresh.where(F.dayofmonth("session_date") == 25))


@register("a15_append_bars", oracle(
    """SELECT security_id, session_date, CASE WHEN day(session_date) = 12 THEN 'conflict' WHEN day(session_date) <= 20 THEN 'repeat' ELSE 'new' END AS outcome
       FROM bars_daily WHERE day(session_date) >= 10""", "bars_daily", dates="session_date"))
def _(spark, sf):
    stored, incoming = _stored_and_incoming(spark, sf)
    return appends.classify_append(stored, incoming, appends.PRICE_BARS).select("security_id", "session_date", "outcome")


cte("record_groups", """SELECT event_type AS source, CAST(user_id AS VARCHAR) AS source_record_id, date_trunc('day', ts) AS available_at,
  min(value) AS lo, max(value) AS hi, min(round(value)) AS rlo, max(round(value)) AS rhi FROM events GROUP BY 1, 2, 3""")


def _records(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_record_id"), F.date_trunc("day", "ts").alias("available_at"),
        F.col("value").cast("string").alias("payload"), F.round("value").alias("ratio"), F.lit(None).cast("double").alias("cash_amount"))


@register("a16_append_events", oracle(
    "SELECT source, source_record_id, available_at, CASE WHEN lo <> hi THEN 'conflict' WHEN day(available_at) <= 15 THEN 'repeat' ELSE 'new' END AS outcome FROM record_groups", "record_groups", stamps="available_at"))
def _(spark, sf):
    rows = _records(spark, sf).drop("ratio", "cash_amount")
    return appends.classify_append(rows.where(F.dayofmonth("available_at") <= 15), rows, appends.COMPANY_EVENTS).select("source", "source_record_id", "available_at", "outcome")


@register("a17_append_actions", oracle(
    "SELECT source, source_record_id, available_at, CASE WHEN rlo <> rhi THEN 'conflict' ELSE 'repeat' END AS outcome FROM record_groups", "record_groups", stamps="available_at"))
def _(spark, sf):
    rows = _records(spark, sf).drop("payload")
    return appends.classify_append(rows, rows, appends.CORPORATE_ACTIONS).select("source", "source_record_id", "available_at", "outcome")


@register("a18_append_features", oracle(
    "SELECT security_id, session_date, CASE WHEN day(session_date) <= 15 THEN 'repeat' ELSE 'new' END AS outcome FROM daily_returns", "daily_returns", dates="session_date"))
def _(spark, sf):
    rows = daily_returns(spark, sf).select(
        "security_id", "session_date", F.lit("daily_return").alias("feature_name"), F.lit("v0").alias("feature_version"), "effective_at", "available_at",
        F.lit("c0").alias("code_version"), F.lit("k0").alias("config_version"), F.col("ret").alias("value"))
    return appends.classify_append(rows.where(F.dayofmonth("session_date") <= 15), rows, appends.FEATURES).select("security_id", "session_date", "outcome")


@register("a19_insert_if_absent", oracle(
    "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)"))
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "value")
    stored = events.where("event_type = 'error' and value > 100")
    return appends.insert_if_absent(stored, events.where("event_type = 'purchase'"), key=["user_id"]).select("user_id")


@register("a19_evidence_links", oracle(
    "SELECT DISTINCT l_orderkey AS card_id, CAST(e AS VARCHAR) AS evidence_id FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS e FROM lineitem)"))
def _(spark, sf):
    cards = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("card_id"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("evidence_ids"))
    return appends.evidence_links(cards, parent="card_id")


@register("a20_overwrite_security", oracle(
    """SELECT o_custkey AS security_id, o_orderpriority AS name, o_orderdate AS updated_at FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice > 200000 DESC, o_orderpriority DESC) = 1""", "", stamps="updated_at"))
def _(spark, sf):
    rows = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("security_id"), F.col("o_orderdate").alias("updated_at"), (F.col("o_totalprice") > 200000).alias("big")
    ).agg(F.max("o_orderpriority").alias("name"))
    return appends.overwrite_by_id(rows.where("not big").drop("big"), rows.where("big").drop("big")).select("security_id", "name", "updated_at")


@register("a21_request_fingerprints", oracle(
    """SELECT provider, sha256(body) AS request_fingerprint, provider || ':daily:' || substr(sha256(body), 1, 24) AS batch_key FROM
       (SELECT provider, '{"end_date":"2024-01-31","frequency":"1d","items":[' || string_agg(item, ',' ORDER BY item) || '],"start_date":"2024-01-01"}' AS body
        FROM (SELECT unnest(['all', 'p' || CAST(c_nationkey AS VARCHAR)]) AS provider, '["' || CAST(c_custkey AS VARCHAR) || '","' || c_name || '"]' AS item FROM customer) GROUP BY 1)"""))
def _(spark, sf):
    requests = table(spark, sf, "customer").select(
        # One request of everybody, and one of each nation.
        F.explode(F.array(F.lit("all"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")))).alias("provider"), F.col("c_custkey").alias("security_id"), F.col("c_name").alias("provider_identifier"),
        F.lit("2024-01-01").cast("date").alias("start_date"), F.lit("2024-01-31").cast("date").alias("end_date"), F.lit("1d").alias("frequency"))
    return ids.request_fingerprints(requests).select("provider", "request_fingerprint", "batch_key")


@register("a22_batch_content_hash", None)
def _(spark, sf):
    rows = bars_daily(spark, sf).withColumn("adjusted_close", F.col("close")).withColumn(
        "source_record_id", F.concat_ws(":", F.col("security_id").cast("string"), F.col("session_date").cast("string"))).withColumn(
        "ingestion_batch_id", F.date_format("session_date", "yyyy-MM"))
    return ids.batch_content_hash(rows)


cte("defaults", f"""SELECT r.row_number, r.security_id, r.status, c.c_mktsegment, c.c_acctbal,
  CASE WHEN c_acctbal > 8000 THEN 'T7' WHEN c_mktsegment = 'BUILDING' THEN 'T14' WHEN c_mktsegment = 'MACHINERY' THEN 'T999999' END AS wanted
FROM resolved r LEFT JOIN customer c ON c.c_custkey = r.security_id""", ["resolved"])


def _imported(spark, sf):
    rows = references(spark, sf).withColumnsRenamed({"scheme": "identifier_scheme", "value": "identifier"})
    found = uploads.resolve_upload(rows, identifiers(spark, sf), as_of=WEEK_AS_OF)
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("security_id"), F.col("c_mktsegment").alias("sector"), "c_acctbal")
    chosen = found.join(who.select("security_id", "c_acctbal"), "security_id", "left").withColumn("benchmark", F.when(F.col("c_acctbal") > 8000, "T7"))
    return chosen, who


@register("b20_import_resolution", oracle(
    "SELECT row_number, 'security_' || status AS issue FROM resolved WHERE status <> 'resolved'", "resolved"))
def _(spark, sf):
    rows = references(spark, sf).withColumnsRenamed({"scheme": "identifier_scheme", "value": "identifier"}).withColumn("benchmark", F.lit(None).cast("string"))
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("security_id"), F.col("c_mktsegment").alias("sector"))
    # No benchmark is asked for, so only unresolved securities are reported.
    accepted, issues = uploads.import_rows(rows, identifiers(spark, sf), who, mappings(spark, sf), as_of=WEEK_AS_OF)
    return issues.select("row_number", "issue").unionByName(accepted.select("row_number", F.lit("accepted").alias("issue")))


@register("b21_benchmark_choice", oracle(
    f"""SELECT d.row_number, CASE WHEN d.wanted IS NULL THEN 'mapped' ELSE CASE (SELECT count(DISTINCT i.security_id) FROM identifiers i WHERE i.value = d.wanted
         AND i.valid_from <= {WEEK_AT} AND (i.valid_to IS NULL OR i.valid_to > {WEEK_AT})) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END END AS benchmark_status,
       CASE WHEN d.wanted IS NULL THEN m.benchmark_security_id ELSE (SELECT CASE WHEN count(DISTINCT i.security_id) = 1 THEN min(i.security_id) END FROM identifiers i WHERE i.value = d.wanted
         AND i.valid_from <= {WEEK_AT} AND (i.valid_to IS NULL OR i.valid_to > {WEEK_AT})) END AS benchmark_security_id
       FROM defaults d LEFT JOIN (SELECT * FROM mappings WHERE kind = 'market' AND valid_from <= {WEEK_AT} AND (valid_to IS NULL OR valid_to > {WEEK_AT})
         QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY valid_from DESC) = 1) m ON m.security_id = d.security_id""", "defaults mappings"))
def _(spark, sf):
    chosen, who = _imported(spark, sf)
    out = uploads.benchmark_choice(chosen, who, mappings(spark, sf), identifiers(spark, sf), as_of=WEEK_AS_OF,
                                   sector_defaults={"BUILDING": "T14", "MACHINERY": "T999999"})
    return out.select("row_number", "benchmark_status", "benchmark_security_id")
