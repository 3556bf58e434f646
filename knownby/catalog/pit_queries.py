"""Point-in-time selection and interval queries (group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownby.catalog.base import (
    bars_daily, contributors, cte, cutoff_values, intervals, oracle, register, table, vintages, weekly_features,
)
from knownby.operators import intervals as iv
from knownby.operators import pit
from knownby.operators.scale import attach

AS_OF = "2024-01-15T12:00:00+00:00"
AT = "TIMESTAMP '2024-01-15 12:00:00'"
WEEK_AS_OF, WEEK_AT = "2000-06-30T00:00:00+00:00", "TIMESTAMP '2000-06-30 00:00:00'"
DAYS = [f"2024-01-{d:02d}T00:00:00+00:00" for d in range(3, 31, 3)] + ["2024-01-30T09:00:00+00:00", "2024-01-30T18:00:00+00:00"]
QUARTERS = [f"{y}-{m:02d}-01T00:00:00+00:00" for y in range(1995, 2002) for m in (3, 6, 9, 12)]


def newest(source: str, keys: str, order: str, where: str = "true") -> str:
    return f"SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


_NEW = "available_at DESC, event_id DESC"


@register("b1_latest_vintage", oracle(newest("vintages", "security_id, metric", _NEW, f"available_at <= {AT}"),
                                      "vintages", "value", stamps="available_at"))
def _(spark, sf):
    return pit.latest_vintage_as_of(vintages(spark, sf), as_of=AS_OF, keys=["security_id", "metric"], tie_break=["event_id"])


@register("b2_select_snapshots", oracle(newest("vintages", "security_id", _NEW, f"available_at <= {AT}"),
                                        "vintages", "value", stamps="available_at"))
def _(spark, sf):
    text = vintages(spark, sf).withColumn("available_at", F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return pit.select_snapshots_as_of(text, as_of=AS_OF, entities=["security_id"], tie_break=["event_id"])


@register("b3_latest_estimates", oracle(
    newest("contributors", "security_id, metric, fiscal_period", _NEW, f"available_at <= {AT}"),
    "contributors", "estimate", stamps="available_at"))
def _(spark, sf):
    return pit.latest_estimates_as_of(contributors(spark, sf), as_of=AS_OF, tie_break=["event_id"])


@register("b4_latest_macro_vintages", oracle(
    newest("(SELECT event_type AS series_id, CAST(date_trunc('day', ts) AS DATE) AS period_end, ts AS available_at, value, event_id FROM events)",
           "series_id, period_end", _NEW, f"available_at <= {AT}"), "", "value", "period_end", "available_at"))
def _(spark, sf):
    releases = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.to_date("ts").alias("period_end"), F.col("ts").alias("available_at"), "value", "event_id")
    return pit.latest_macro_vintages_as_of(releases, as_of=AS_OF, tie_break=["event_id"])


@register("b5_latest_ownership", oracle(
    newest("(SELECT o_custkey AS security_id, o_totalprice AS holding, o_orderdate AS available_at, o_orderkey FROM orders)",
           "security_id", "available_at DESC, o_orderkey DESC", f"available_at <= {WEEK_AT}"), "", "holding", stamps="available_at"))
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("security_id"), F.col("o_totalprice").alias("holding"), F.col("o_orderdate").alias("available_at"), "o_orderkey")
    return pit.latest_ownership_snapshots_as_of(rows, as_of=WEEK_AS_OF, tie_break=["o_orderkey"])


@register("b6_vintage_history", oracle(
    f"""SELECT c.as_of, v.* FROM (VALUES {cutoff_values(DAYS)}) c(as_of) JOIN vintages v ON v.available_at <= c.as_of
        QUALIFY row_number() OVER (PARTITION BY c.as_of, security_id, metric ORDER BY {_NEW}) = 1""",
    "vintages", "value", stamps="as_of available_at"))
def _(spark, sf):
    return pit.latest_vintage_history(vintages(spark, sf), cutoffs=DAYS, keys=["security_id", "metric"], tie_break=["event_id"])


_BARS = """SELECT security_id, '1d' AS frequency, 'events' AS source, CAST(session_date AS TIMESTAMP) AS effective_at, available_at, close FROM bars_daily
UNION ALL SELECT security_id, '1d', 'events', CAST(session_date AS TIMESTAMP), available_at + INTERVAL 3 DAY, close * 2 FROM bars_daily"""
cte("bar_vintages", _BARS, ["bars_daily"])


def bar_vintages(spark, sf):
    """Each daily bar and a correction published three days later."""
    first = bars_daily(spark, sf).select(
        "security_id", F.lit("1d").alias("frequency"), F.lit("events").alias("source"),
        F.col("session_date").cast("timestamp").alias("effective_at"), "available_at", "close")
    later = first.withColumn("available_at", F.col("available_at") + F.expr("interval 3 days")).withColumn("close", F.col("close") * 2)
    return first.unionByName(later)


@register("b7_price_history", oracle(
    newest("bar_vintages", "security_id, frequency, source, effective_at", "available_at DESC",
           f"effective_at >= TIMESTAMP '2024-01-05' AND effective_at <= TIMESTAMP '2024-01-20' AND available_at <= {AT}"),
    "bar_vintages", "close", stamps="effective_at available_at"))
def _(spark, sf):
    return pit.price_history_as_of(bar_vintages(spark, sf), start="2024-01-05T00:00:00+00:00", end="2024-01-20T00:00:00+00:00",
                                   knowledge_time=AS_OF, source="events")


@register("b8_events_as_of", oracle(
    newest("(SELECT event_type AS source, CAST(user_id AS VARCHAR) AS source_record_id, ts AS effective_at, ts + INTERVAL 1 HOUR AS available_at, value, event_id FROM events)",
           "source, source_record_id", _NEW, f"effective_at >= TIMESTAMP '2024-01-03' AND effective_at <= {AT} AND available_at <= {AT}"),
    "", "value", stamps="effective_at available_at"))
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_record_id"), F.col("ts").alias("effective_at"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("available_at"), "value", "event_id")
    return pit.events_as_of(rows, effective_start="2024-01-03T00:00:00+00:00", effective_end=AS_OF, knowledge_time=AS_OF, tie_break=["event_id"])


_FCOLS = "security_id, feature_name, feature_version, value, effective_at, available_at, calculated_at"


@register("b9_latest_features", oracle(
    f"SELECT {_FCOLS} FROM ({newest('weekly_features', 'security_id, feature_name', 'effective_at DESC, available_at DESC, calculated_at DESC', f'effective_at <= {WEEK_AT} AND available_at <= {WEEK_AT} AND calculated_at <= {WEEK_AT}')})",
    "weekly_features", "value", stamps="effective_at available_at calculated_at"))
def _(spark, sf):
    out = pit.latest_features_as_of(weekly_features(spark, sf), effective_at=WEEK_AS_OF, knowledge_time=WEEK_AS_OF)
    return out.select(*[c.strip() for c in _FCOLS.split(",")])


_PINS = {"residual_return_zscore_1d": "price-mvp-v0", "realized_volatility_20d": "price-mvp-v0"}


@register("b10_panel_as_of", oracle(
    f"""SELECT {_FCOLS}, CAST(count(*) OVER (PARTITION BY security_id, feature_name) AS BIGINT) AS candidates
        FROM (SELECT *, dense_rank() OVER (PARTITION BY security_id, feature_name ORDER BY effective_at DESC, available_at DESC, calculated_at DESC) AS rk
              FROM weekly_features WHERE effective_at <= {WEEK_AT} AND available_at <= {WEEK_AT} AND calculated_at <= {WEEK_AT}
              AND feature_name IN ('residual_return_zscore_1d', 'realized_volatility_20d') AND feature_version = 'price-mvp-v0') WHERE rk = 1""",
    "weekly_features", "value", stamps="effective_at available_at calculated_at"))
def _(spark, sf):
    pins = spark.createDataFrame(list(_PINS.items()), "feature_name string, feature_version string")
    panel = pit.panel_as_of(weekly_features(spark, sf), pins=pins, as_of=WEEK_AS_OF, config_version="equity-mvp-v0")
    return pit.require_unambiguous(panel).select(*[c.strip() for c in _FCOLS.split(",")], "candidates")


@register("b11_cards_as_of", oracle(
    f"""SELECT o_orderkey AS card_id, o_custkey AS security_id, o_orderdate AS as_of FROM orders
        WHERE o_orderdate + INTERVAL 1 DAY <= {WEEK_AT} AND o_orderdate + INTERVAL 2 DAY <= {WEEK_AT}""", "", stamps="as_of"))
def _(spark, sf):
    day = lambda n: F.col("o_orderdate") + F.expr(f"interval {n} days")
    cards = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("security_id"), F.col("o_orderdate").alias("as_of"),
        day(1).alias("data_cutoff_at"), day(2).alias("created_at"))
    return pit.cards_as_of(cards, knowledge_time=WEEK_AS_OF).select("card_id", "security_id", "as_of")


@register("b12_availability_violations", oracle(
    "SELECT event_id, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS decision_at, ts AS available_at FROM events WHERE ts > date_trunc('hour', ts) + INTERVAL 30 MINUTE",
    "", stamps="decision_at available_at"))
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", (F.date_trunc("hour", "ts") + F.expr("interval 30 minutes")).alias("decision_at"), F.col("ts").alias("available_at"))
    return pit.availability_violations(rows)


@register("b13_normalize_utc", oracle(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS stamp, event_type = 'error' AS stamp_invalid FROM events""",
    "", stamps="stamp"))
def _(spark, sf):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("not a time "), F.col("event_id").cast("string"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    return pit.normalize_utc(table(spark, sf, "events").select("event_id", text.alias("stamp")), "stamp")


@register("b15_members_as_of", oracle(
    f"SELECT security_id, valid_from, valid_to, order_key FROM intervals WHERE valid_from <= {WEEK_AT} AND (valid_to IS NULL OR valid_to > {WEEK_AT})",
    "intervals", stamps="valid_from valid_to"))
def _(spark, sf):
    return iv.members_as_of(intervals(spark, sf), as_of=WEEK_AS_OF).select("security_id", "valid_from", "valid_to", "order_key")


@register("b15_members_history", oracle(
    f"""SELECT c.as_of, security_id, order_key FROM (VALUES {cutoff_values(QUARTERS)}) c(as_of)
        JOIN intervals ON valid_from <= c.as_of AND (valid_to IS NULL OR valid_to > c.as_of)""", "intervals", stamps="as_of"))
def _(spark, sf):
    return iv.members_history(intervals(spark, sf), cutoffs=QUARTERS).select("as_of", "security_id", "order_key")


@register("b16_active_coverage", oracle(
    f"""SELECT security_id, priority AS coverage_list_id, valid_from FROM intervals WHERE priority = '1-URGENT'
        AND valid_from <= {WEEK_AT} AND (valid_to IS NULL OR valid_to > {WEEK_AT})""", "intervals", stamps="valid_from"))
def _(spark, sf):
    rows = intervals(spark, sf).withColumnRenamed("priority", "coverage_list_id")
    return iv.active_coverage_members(rows, coverage_list_id="1-URGENT", as_of=WEEK_AS_OF).select("security_id", "coverage_list_id", "valid_from")


cte("mappings", "SELECT security_id, CASE WHEN status = 'F' THEN 'sector' ELSE 'market' END AS kind, order_key % 997 AS benchmark_security_id, valid_from, valid_to + INTERVAL 200 DAY AS valid_to FROM intervals", ["intervals"])


def mappings(spark, sf):
    """Overlapping benchmark mappings of two kinds."""
    return intervals(spark, sf).select(
        "security_id", F.when(F.col("status") == "F", "sector").otherwise("market").alias("kind"),
        (F.col("order_key") % 997).alias("benchmark_security_id"), "valid_from", (F.col("valid_to") + F.expr("interval 200 days")).alias("valid_to"))


@register("b17_benchmark_as_of", oracle(
    newest("mappings", "security_id, kind", "valid_from DESC", f"valid_from <= {WEEK_AT} AND (valid_to IS NULL OR valid_to > {WEEK_AT})"),
    "mappings", stamps="valid_from valid_to"))
def _(spark, sf):
    return iv.benchmark_as_of(mappings(spark, sf), as_of=WEEK_AS_OF)


cte("identifiers", """SELECT security_id, 'ticker' AS scheme, 'T' || CAST(security_id * 7 % 1300 AS VARCHAR) AS value,
lower(status) AS provider, substr(priority, 1, 1) AS exchange_mic, valid_from, valid_to FROM intervals""", ["intervals"])


def identifiers(spark, sf):
    """Tickers that customers hold for an interval; some are shared at the same time."""
    return intervals(spark, sf).select(
        "security_id", F.lit("ticker").alias("scheme"), F.concat(F.lit("T"), (F.col("security_id") * 7 % 1300).cast("string")).alias("value"),
        F.lower("status").alias("provider"), F.substring("priority", 1, 1).alias("exchange_mic"), "valid_from", "valid_to")


_REFS = """SELECT c_custkey AS row_number, CASE WHEN c_acctbal > 5000 THEN 'ticker' END AS scheme,
'T' || CAST(c_custkey AS VARCHAR) AS value, CASE WHEN c_nationkey > 12 THEN 'f' END AS provider, CAST(NULL AS VARCHAR) AS exchange_mic FROM customer"""
cte("references_", _REFS)


def references(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_number"), F.when(F.col("c_acctbal") > 5000, "ticker").alias("scheme"),
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("value"),
        F.when(F.col("c_nationkey") > 12, "f").alias("provider"), F.lit(None).cast("string").alias("exchange_mic"))


_RESOLVED = f"""SELECT r.row_number, r.value, count(DISTINCT i.security_id) AS candidates,
CASE WHEN count(DISTINCT i.security_id) = 1 THEN min(i.security_id) END AS security_id,
CASE count(DISTINCT i.security_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status
FROM references_ r LEFT JOIN identifiers i ON i.value = r.value AND (r.scheme IS NULL OR r.scheme = i.scheme)
 AND (r.provider IS NULL OR r.provider = i.provider) AND i.valid_from <= {WEEK_AT} AND (i.valid_to IS NULL OR i.valid_to > {WEEK_AT})
GROUP BY 1, 2"""
cte("resolved", _RESOLVED, ["references_", "identifiers"])


@register("b18_resolve_identifiers", oracle("SELECT * FROM resolved", "resolved"))
def _(spark, sf):
    out = iv.resolve(references(spark, sf), identifiers(spark, sf), as_of=WEEK_AS_OF)
    return out.select("row_number", "value", "candidates", "security_id", "status")


@register("b19_interval_overlaps", oracle(
    """SELECT security_id, kind, valid_from, reach AS overlaps_until FROM (SELECT *, max(coalesce(valid_to, TIMESTAMP '9999-01-01')) OVER
       (PARTITION BY security_id, kind ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mappings) WHERE reach > valid_from""",
    "mappings", stamps="valid_from overlaps_until"))
def _(spark, sf):
    out = iv.overlapping_intervals(mappings(spark, sf), keys=["security_id", "kind"], tie_break=["benchmark_security_id"])
    return out.select("security_id", "kind", "valid_from", "overlaps_until")


@register("b19_interval_import", oracle(
    """SELECT n.security_id, n.valid_from, bool_or(o.security_id IS NOT NULL) AS rejected FROM
       (SELECT security_id, valid_from + INTERVAL 3 DAY AS valid_from, valid_from + INTERVAL 40 DAY AS valid_to, order_key FROM intervals WHERE status <> 'F') n
       LEFT JOIN (SELECT security_id, valid_from, valid_to, order_key, false AS new FROM intervals WHERE status = 'F'
          UNION ALL SELECT security_id, valid_from + INTERVAL 3 DAY, valid_from + INTERVAL 40 DAY, order_key, true FROM intervals WHERE status <> 'F') o
       ON o.security_id = n.security_id AND NOT (o.new AND o.order_key = n.order_key)
          AND n.valid_from < coalesce(o.valid_to, TIMESTAMP '9999-01-01') AND o.valid_from < n.valid_to GROUP BY 1, 2""",
    "intervals", stamps="valid_from"))
def _(spark, sf):
    rows = intervals(spark, sf).select("security_id", "valid_from", "valid_to", "order_key", "status")
    stored = rows.where("status = 'F'").drop("status")
    shift = lambda n: F.col("valid_from") + F.expr(f"interval {n} days")
    incoming = rows.where("status <> 'F'").select("security_id", shift(3).alias("valid_from"), shift(40).alias("valid_to"), "order_key")
    kept, rejected = iv.insert_intervals(stored, incoming, keys=["security_id"], tie_break=["order_key"], payload=["order_key"])
    return kept.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True))).select("security_id", "valid_from", "rejected")


@register("b23_portfolio_snapshot_append", oracle(
    """SELECT portfolio_name, as_of, CASE WHEN count(DISTINCT source_hash) > 1 OR (year(as_of) < 1998 AND month(as_of) = 2) THEN 'conflict' WHEN year(as_of) < 1998 THEN 'repeat' ELSE 'new' END AS outcome
       FROM (SELECT o_orderpriority AS portfolio_name, date_trunc('month', o_orderdate) AS as_of, o_orderstatus AS source_hash FROM orders) GROUP BY 1, 2""",
    "", stamps="as_of"))
def _(spark, sf):
    from knownby.sources.appends import PORTFOLIO_SNAPSHOTS, classify_append

    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("portfolio_name"), F.date_trunc("month", "o_orderdate").alias("as_of"), F.col("o_orderstatus").alias("source_hash"))
    # Years before 1998 are stored, their Februaries with another content.
    stored = rows.where(F.year("as_of") < 1998).groupBy("portfolio_name", "as_of").agg(F.min("source_hash").alias("source_hash"))
    stored = stored.withColumn("source_hash", F.when(F.month("as_of") == 2, "another").otherwise(F.col("source_hash")))
    return classify_append(stored, rows, PORTFOLIO_SNAPSHOTS).select("portfolio_name", "as_of", "outcome")


@register("b24_latest_weights", oracle(
    f"""SELECT portfolio_name, as_of, security_id, weight FROM (SELECT c_mktsegment AS portfolio_name, o_orderdate AS as_of, max(o_orderkey) AS snapshot_id
         FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= {WEEK_AT} GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC) = 1)
        JOIN (SELECT l_orderkey AS snapshot_id, l_partkey AS security_id, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2) USING (snapshot_id)""",
    "", "weight", stamps="as_of"))
def _(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    snapshots = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(
        F.col("c_mktsegment").alias("portfolio_name"), F.col("o_orderdate").alias("as_of")).agg(F.max("o_orderkey").alias("snapshot_id"))
    positions = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("snapshot_id"), F.col("l_partkey").alias("security_id")).agg(
        F.sum(F.col("l_discount").cast("decimal(18,4)")).alias("weight"))
    return iv.latest_portfolio_weights(snapshots, positions, as_of=WEEK_AS_OF)


@register("b25_active_thesis_version", oracle(
    f"""SELECT security_id AS thesis_id, order_key AS version, valid_from AS approved_at FROM mappings_thesis WHERE valid_from <= {WEEK_AT}
        AND (valid_to IS NULL OR valid_to > {WEEK_AT}) AND approved <= {WEEK_AT}
        QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY order_key DESC, approved DESC) = 1""", "mappings_thesis", stamps="approved_at"))
def _(spark, sf):
    rows = intervals(spark, sf).select(
        F.col("security_id").alias("thesis_id"), F.col("order_key").alias("version"), "valid_from",
        (F.col("valid_to") + F.expr("interval 400 days")).alias("valid_to"), (F.col("valid_from") + F.expr("interval 10 days")).alias("approved_at"))
    return iv.active_thesis_version(rows, as_of=WEEK_AS_OF).select("thesis_id", "version", F.col("valid_from").alias("approved_at"))


cte("mappings_thesis", "SELECT security_id, order_key, valid_from, valid_to + INTERVAL 400 DAY AS valid_to, valid_from + INTERVAL 10 DAY AS approved FROM intervals", ["intervals"])


@register("b26_latest_snapshot_rows", oracle(
    f"""SELECT l_suppkey AS security_id, snap AS available_at, l_orderkey, l_quantity FROM
        (SELECT *, date_trunc('month', l_shipdate) AS snap FROM lineitem WHERE date_trunc('month', l_shipdate) <= {WEEK_AT})
        QUALIFY snap = max(snap) OVER (PARTITION BY l_suppkey)""", "", "l_quantity", stamps="available_at"))
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("security_id"), F.date_trunc("month", "l_shipdate").alias("available_at"), "l_orderkey", "l_quantity")
    return pit.latest_snapshot_rows(rows, keys=["security_id"], as_of=WEEK_AS_OF)


@register("b27_list_securities", oracle(
    "SELECT s_suppkey AS security_id, s_name AS name FROM supplier WHERE s_acctbal > 0"))
def _(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("active"))
    return pit.list_securities(rows).select("security_id", "name")
