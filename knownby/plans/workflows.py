"""Workflow entry points around the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.operators.events import EventStudySpec, earnings_event_features, standard_event_spec
from knownby.operators.intervals import latest_portfolio_weights
from knownby.operators.pit import Instant
from knownby.operators.research import Materiality
from knownby.operators.screens import Screen, run_screen, screen_matches
from knownby.plans.daily import DailyRequest, DailyRun, daily_research
from knownby.sources.appends import PRICE_BARS, append_vintages
from knownby.session import materialize
from knownby.sources.bars import batch_status, batch_violations


def close_workflow(*, coverage_lists: DataFrame, members: DataFrame, mappings: DataFrame, bars: DataFrame,
                   snapshots: DataFrame, positions: DataFrame, source: str, data_cutoff_at: Instant,
                   coverage_list_id: str | None = None, as_of: Instant | None = None,
                   lookback_days: int = 550, materiality: Materiality | None = None) -> DailyRun:
    """Daily run over the newest coverage list, the newest bar instant and the newest weights.

    Two single-row lookups fix the request before the plan is built.
    """
    if coverage_list_id is None:
        row = coverage_lists.agg(F.max_by("coverage_list_id", "created_at").alias("id")).first()
        if row["id"] is None:
            raise ValueError("no coverage list exists")
        coverage_list_id = row["id"]
    if as_of is None:
        row = bars.where(F.col("source") == source).agg(
            F.date_format(F.max("effective_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at")
        ).first()
        if row["at"] is None:
            raise ValueError("no normalized price bars exist for the source")
        as_of = row["at"] + "+00:00"
    # The newest snapshot of any portfolio supplies the weights.
    everything = latest_portfolio_weights(
        snapshots.withColumn("portfolio_name", F.lit("latest")), positions, as_of=as_of
    )
    request = DailyRequest(coverage_list_id, as_of, data_cutoff_at, source, lookback_days=lookback_days)
    return daily_research(request, members=members, mappings=mappings, bars=bars,
                          weights=everything.select("security_id", "weight"), materiality=materiality)


def earnings_study(bars: DataFrame, events: DataFrame, *, pre_sessions: int = 5, post_sessions: int = 5,
                   as_of: Instant | None = None) -> tuple[DataFrame, EventStudySpec]:
    spec = standard_event_spec(pre_sessions=pre_sessions, post_sessions=post_sessions)
    return earnings_event_features(bars, events, spec, as_of=as_of), spec


def weekly_screen(features: DataFrame, screen: Screen, *, as_of: Instant, tie_break: Sequence[str] = ()) -> DataFrame:
    return screen_matches(run_screen(features, screen, as_of=as_of, tie_break=tie_break), screen)


def ingest_prices(spark: SparkSession, path: str, loaded: DataFrame, request: DataFrame,
                  batches: DataFrame) -> dict[str, object]:
    """Validate a loaded batch, then append its bars; returns received and inserted counts."""
    loaded = materialize(loaded)  # checked, counted and appended
    rows = loaded.where("session_date is not null").withColumn("frequency", F.lit("1d"))
    broken = batch_violations(batches, rows, request).limit(1).collect()
    if broken:
        raise ValueError(f"price batch rejected: {broken[0].asDict()}")
    severity = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status")), F.lit(0))
    summary = batch_status(loaded, requested=batches).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"), F.max_by("status", severity).alias("s")).first()
    inserted = append_vintages(spark, path, rows, PRICE_BARS)
    return {"received": int(summary["n"]), "inserted": inserted, "status": summary["s"]}


#: Statuses of a batch from good to bad; the worst speaks for a load.
SEVERITY = ("succeeded", "partial", "failed")


def latest_status(records: DataFrame, *, order: str = "started_at", by: Sequence[str] = ()) -> DataFrame:
    """The newest record per provider or overall, by one aggregation."""
    rest = [c for c in records.columns if c not in by]
    newest = records.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return newest.select(*by, "__r.*")
