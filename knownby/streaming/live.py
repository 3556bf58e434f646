"""Structured Streaming front ends. The vintage table is the state, so each batch
reuses the batch operators unchanged."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knownby.operators.pit import Instant, instant, latest_by
from knownby.operators.screens import Screen, judged, newest_values, require_enabled
from knownby.plans.daily import SESSIONS, latest_features, session_returns
from knownby.session import materialize
from knownby.sources.appends import PERIOD, VintageTable, append_vintages

# Analyses invalidated by each kind of event.
AFFECTED_MODULES = {
    "earnings": ("earnings", "estimates", "price_anomaly", "valuation"),
    "guidance": ("estimates", "price_anomaly", "valuation"),
    "filing": ("filing_diff", "fundamental_change"),
    "fomc": ("macro_sensitivity", "price_anomaly"),
    "cpi": ("macro_sensitivity", "price_anomaly"),
    "macro_release": ("macro_sensitivity", "price_anomaly"),
}
DEFAULT_MODULES = ("price_anomaly",)


def route_events(events: DataFrame, *, event_type: str = "event_type") -> DataFrame:
    """One row per affected module; the same projection on a batch or a stream."""
    modules = F.array(*[F.lit(m) for m in DEFAULT_MODULES])
    for kind, affected in AFFECTED_MODULES.items():
        modules = F.when(F.col(event_type) == kind, F.array(*[F.lit(m) for m in affected])).otherwise(modules)
    return events.withColumn("module", F.explode(modules))


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], *, checkpoint: str,
          once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ingest_vintages(stream: DataFrame, table: VintageTable, *, path: str, checkpoint: str) -> StreamingQuery:
    """Idempotent vintage ingest; a conflicting vintage fails its batch.

    The stored table is the state, and the append knows repeats however old they
    are. So there is no watermark, and a vintage that arrives late is stored.
    """
    def handle(batch: DataFrame, _: int) -> None:
        append_vintages(batch.sparkSession, path, batch, table)

    return start(stream, handle, checkpoint=checkpoint)


def live_screen(stream: DataFrame, screen: Screen, *, results_path: str, checkpoint: str, as_of: Instant,
                tie_break: Sequence[str] = ()) -> StreamingQuery:
    """A screen kept up to date by arriving features; each micro-batch writes the securities that it changes.

    The state is one row per security, the newest vintage of each feature of the screen, so a
    batch costs its own rows and no table is read. A vintage that arrives late replaces nothing newer, and a repeat changes
    nothing. A retried batch overwrites its own result; ``current_screen`` reads the newest row of each security.
    ``ingest_vintages`` stores the same stream and refuses conflicting vintages.
    """
    require_enabled(screen)
    known = stream.where(F.col("feature_name").isin(*screen.features) & (F.col("available_at") <= instant(as_of)))

    def handle(batch: DataFrame, number: int) -> None:
        judged(batch, screen, as_of=as_of).write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    writer = newest_values(known, screen, tie_break).writeStream.outputMode("update").foreachBatch(handle)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_screen(spark: SparkSession, results_path: str) -> DataFrame:
    """The newest result of each security that ``live_screen`` has written."""
    return latest_by(spark.read.parquet(results_path), keys=["security_id"], order=["batch"]).drop("batch")


def trailing_bars(spark: SparkSession, path: str, securities: DataFrame, sessions: int) -> DataFrame:
    """Stored bars of the last months, as many as hold that many sessions of every security that has them.

    Months are added, twice as many each time, by the folders' names; counting reads two columns of the
    months not counted yet and sums them with what earlier turns found.
    """
    stored = spark.read.parquet(path)
    months = sorted((row[0] for row in stored.select(PERIOD).distinct().collect()), reverse=True)  # at most the months there are
    counted, taken, step = None, 0, 2 * sessions // 21 + 1
    while taken + step < len(months):  # once the oldest month is taken, no count would change what is read
        fresh = stored.where(F.col(PERIOD).isin(months[taken:taken + step])).join(securities, "security_id", "left_semi")
        fresh = fresh.groupBy("security_id").agg(F.count_distinct("session_date").alias("n"))
        counted = materialize(fresh if counted is None else counted.unionByName(fresh).groupBy("security_id").agg(F.sum("n").alias("n")))
        taken, step = taken + step, step * 2
        if securities.join(counted.where(F.col("n") >= sessions), "security_id", "left_anti").isEmpty():
            break
    else:
        taken = len(months)
    return stored.where(F.col(PERIOD).isin(months[:taken])).drop(PERIOD)


def recompute_touched(stream: DataFrame, *, bars_path: str, factors: DataFrame, results_path: str,
                      checkpoint: str, table: VintageTable) -> StreamingQuery:
    """Append arriving bars and recompute features only for the securities they touch.

    A security is touched by its own bars or by those of its benchmarks. Stored bars are laid out by
    month, and only the months that hold the sessions the features look at are read (``trailing_bars``).
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        append_vintages(spark, bars_path, batch, table)
        arrived = batch.select("security_id").distinct()
        sides = factors.withColumn("__side", F.explode(F.array("security_id", "market_id", "sector_id")))
        hit = sides.join(arrived.withColumnRenamed("security_id", "__side"), "__side", "left_semi").drop("__side")
        hit = materialize(hit.distinct())  # read by every step below; the batch is not
        needed = hit.select(F.explode(F.array("security_id", "market_id", "sector_id")).alias("security_id")).where(
            "security_id is not null"
        ).distinct()
        bars = trailing_bars(spark, bars_path, hit.select("security_id").distinct(), SESSIONS + 1).join(needed, "security_id", "left_semi")
        # Counts of whole histories are not known from their ends.
        result = latest_features(session_returns(bars), hit).drop("bars", "observations")
        result.write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    return start(stream, handle, checkpoint=checkpoint)
