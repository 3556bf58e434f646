"""Streaming queries (group Q) and workflows that write tables before returning them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from knownby.catalog.base import oracle, register, table, weekly_features
from knownby.catalog.panel_queries import _BN, _BREAK, pivot_sql, wide_sql
from knownby.catalog.pit_queries import WEEK_AS_OF, WEEK_AT
from knownby.catalog.research_queries import REQUEST, _SEVEN, coverage, instruments, market_mappings
from knownby.operators import screens
from knownby.plans import daily, workflows
from knownby.session import checkpoint_dir, materialize
from knownby.catalog.domain_queries import WINDOWS, company_events, week_bars
from knownby.catalog.source_queries import _request, loaded
from knownby.sources import bars as bar_sources
from knownby.sources.appends import FEATURES, PRICE_BARS, VintageTable, read_vintages
from knownby.streaming import live


def scratch(spark) -> str:
    """A new folder on the shared checkpoint file system."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def table_stream(spark, sf, name):
    """A driver table as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def drained(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def replay(spark, df, root):
    """Write a derived table once and stream its files."""
    df.write.parquet(f"{root}/source")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/source")


_TYPES = {"click": "earnings", "view": "filing", "signup": "cpi", "purchase": "guidance", "error": "management"}


@register("q1_event_routing", oracle(
    "SELECT event_id, unnest(CASE event_type " + " ".join(
        f"WHEN '{k}' THEN [{', '.join(repr(m) for m in live.AFFECTED_MODULES.get(v, live.DEFAULT_MODULES))}]" for k, v in _TYPES.items()) + " END) AS module FROM events"))
def _(spark, sf):
    root = scratch(spark)
    kind = F.lit(None).cast("string")
    for name, event in _TYPES.items():
        kind = F.when(F.col("event_type") == name, event).otherwise(kind)
    stream = table_stream(spark, sf, "events").select("event_id", kind.alias("event_type"))
    query = live.route_events(stream).select("event_id", "module").writeStream.format("parquet").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/sink")
    drained(query)
    return spark.read.parquet(f"{root}/sink")


@register("q2_vintage_ingest", oracle(
    "SELECT DISTINCT user_id AS security_id, event_type AS metric, ts AS available_at, value FROM events", "", "value", stamps="available_at"))
def _(spark, sf):
    root = scratch(spark)
    spec = VintageTable("vintage", ("security_id", "metric", "available_at"), ("value",))
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("security_id"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("available_at"), "value")
    # Several micro-batches; each row comes twice, and old vintages arrive after new ones.
    doubled = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).repartition(12, F.pmod(F.xxhash64("security_id", "available_at", "copy"), F.lit(12))).drop("copy")
    drained(live.ingest_vintages(replay(spark, doubled, root), spec, path=f"{root}/sink", checkpoint=f"{root}/checkpoint"))
    return read_vintages(spark, f"{root}/sink")


@register("q3_live_screen", oracle(
    wide_sql(_BN, _BREAK, pivot_sql(_BN, f"WHERE available_at <= {WEEK_AT}")), "weekly_features", " ".join(_BN)))
def _(spark, sf):
    root = scratch(spark)
    stream = replay(spark, weekly_features(spark, sf), root)
    drained(live.live_screen(stream, screens.RELATIVE_STRENGTH_BREAKOUT, results_path=f"{root}/results", checkpoint=f"{root}/checkpoint", as_of=WEEK_AS_OF))
    return live.current_screen(spark, f"{root}/results").drop("as_of")


@register("q4_recompute_touched", oracle(
    f"SELECT security_id, {', '.join(_SEVEN.split())} FROM day_last_all", "day_last_all", _SEVEN))
def _(spark, sf):
    root = scratch(spark)
    bars = instruments(spark, sf).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    # Three micro-batches, each with weeks of all years and of every security. As many files as the plan has partitions would be
    # more batches for a larger table, each of which recomputes all that is stored.
    bars = bars.repartition(12, "security_id", "session_date")
    benchmarks = daily.member_benchmarks(coverage(spark, sf), market_mappings(spark, sf), as_of=REQUEST.as_of)
    factors = materialize(benchmarks.select("security_id", "market_id", "sector_id"))
    drained(live.recompute_touched(replay(spark, bars, root), bars_path=f"{root}/bars", factors=factors, results_path=f"{root}/results",
                                   checkpoint=f"{root}/checkpoint", table=PRICE_BARS))
    results = spark.read.parquet(f"{root}/results")
    # The newest batch that touched a security holds its current features.
    newest = results.groupBy("security_id").agg(F.max("batch").alias("batch"))
    return results.join(newest, ["security_id", "batch"]).select("security_id", *_SEVEN.split())


@register("a13_ingest_prices", oracle(
    "SELECT security_id, session_date, close, ingestion_batch_id, source_record_id FROM loaded WHERE session_date IS NOT NULL", "loaded", "close", "session_date"))
def _(spark, sf):
    root = scratch(spark)
    rows = loaded(spark, sf)
    batches = bar_sources.batch_status(rows).withColumn("request_fingerprint", F.lit("fingerprint"))
    for _attempt in range(2):  # a retry appends nothing
        workflows.ingest_prices(spark, f"{root}/bars", rows, _request(spark, sf), batches)
    return spark.read.parquet(f"{root}/bars").select("security_id", "session_date", "close", "ingestion_batch_id", "source_record_id")


@register("o8_earnings_study", oracle(
    f"SELECT event_id, s AS response_session, {', '.join(WINDOWS)}, overnight_gap, is_complete FROM study", "study", " ".join(WINDOWS) + " overnight_gap", "response_session"))
def _(spark, sf):
    out, _spec = workflows.earnings_study(week_bars(spark, sf), company_events(spark, sf), pre_sessions=3, post_sessions=3)
    return out.select("event_id", "response_session", *WINDOWS, "overnight_gap", "is_complete")
