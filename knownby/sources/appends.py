"""Append-only tables: idempotent vintage appends with conflict detection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from knownby.functions.numeric import all_of
from knownby.operators.pit import latest_by


@dataclass(frozen=True)
class VintageTable:
    """Natural key of a record vintage and the columns that must agree on a repeat."""

    name: str
    key: tuple[str, ...]
    content: tuple[str, ...]

    @property
    def clock(self) -> str | None:
        """The instant of the key that files are laid out by; equal keys lie in one period."""
        return next((c for c in ("effective_at", "available_at", "as_of") if c in self.key), None)


#: Partition column of stored tables: the month of the key's instant.
PERIOD = "period"


def period_of(table: VintageTable) -> Column:
    return F.date_format(F.col(table.clock), "'m'yyyyMM") if table.clock else F.lit("all")


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    """A stored table without its layout column."""
    return spark.read.parquet(path).drop(PERIOD)


def touched_periods(existing: DataFrame, incoming: DataFrame, table: VintageTable) -> DataFrame:
    """Stored rows of the months that the increment touches: a filter on the layout, so other files are not read."""
    if PERIOD not in existing.columns:
        return existing
    months = [row[0] for row in incoming.select(period_of(table)).distinct().collect()]  # at most the months there are
    wanted = F.col(PERIOD).isin([m for m in months if m is not None])
    return existing.where(wanted | F.col(PERIOD).isNull() if None in months else wanted).drop(PERIOD)


PRICE_BARS = VintageTable(
    "price_bar", ("security_id", "frequency", "source", "effective_at", "available_at"),
    ("open", "high", "low", "close", "adjusted_close", "volume"),
)
COMPANY_EVENTS = VintageTable("company_event", ("source", "source_record_id", "available_at"), ("payload",))
CORPORATE_ACTIONS = VintageTable(
    "corporate_action", ("source", "source_record_id", "available_at"), ("ratio", "cash_amount")
)
FEATURES = VintageTable(
    "feature_snapshot",
    ("security_id", "feature_name", "feature_version", "effective_at", "available_at", "code_version", "config_version"),
    ("value",),
)
PORTFOLIO_SNAPSHOTS = VintageTable("portfolio_snapshot", ("portfolio_name", "as_of"), ("source_hash",))


def classify_append(existing: DataFrame, incoming: DataFrame, table: VintageTable) -> DataFrame:
    """One row per incoming vintage with ``outcome`` new, repeat or conflict.

    Stored rows are first cut to the incoming keys (a small increment is
    broadcast, so the big table is only scanned), then both sides meet in one
    aggregation that compares smallest and largest content and carries the rest
    of the row. Repeats inside the increment are judged the same way. Rows that
    lack a part of the key are no vintages.
    """
    keys = list(table.key)
    content = F.struct(*table.content)
    rest = [c for c in incoming.columns if c not in keys]
    row = F.struct(*table.content, *[c for c in rest if c not in table.content])
    named = incoming.where(all_of([F.col(k).isNotNull() for k in keys]))
    arrived = named.select(*keys, content.alias("__c"), row.alias("__r"), F.lit(0).alias("__old"))
    touched = existing.join(named.select(*keys), keys, "left_semi")
    both = arrived.unionByName(touched.select(*keys, content.alias("__c"), F.lit(None).cast(arrived.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__old")))
    verdict = both.groupBy(*keys).agg(
        F.min("__c").alias("__lo"), F.max("__c").alias("__hi"), F.max("__old").alias("__stored"), F.min("__r").alias("__r")
    )
    outcome = F.when(~F.col("__lo").eqNullSafe(F.col("__hi")), "conflict").when(F.col("__stored") == 1, "repeat").otherwise("new")
    return verdict.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in incoming.columns], outcome.alias("outcome"))


def new_vintages(existing: DataFrame, incoming: DataFrame, table: VintageTable) -> DataFrame:
    """Rows to append; evaluating them fails on the first conflict."""
    judged = classify_append(existing, incoming, table)
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in table.key])
    checked = judged.withColumn(
        "outcome",
        F.when(
            F.col("outcome") == "conflict",
            F.raise_error(F.concat(F.lit(f"conflicting {table.name} vintage: "), label)),
        ).otherwise(F.col("outcome")),
    )
    return checked.where("outcome = 'new'").drop("outcome")


def append_vintages(spark: SparkSession, path: str, incoming: DataFrame, table: VintageTable, *,
                    partition_by: Sequence[str] = ()) -> int:
    """Append an increment to a Parquet table in one pass; returns the inserted count.

    Files are laid out by the month of the key's instant, and only the months of the
    increment are read. Rows are brought together by month before they are written, so an
    increment adds a file or few to each of its months, not one from every task. A conflict fails
    the write job before its commit, so nothing is stored; a retried increment appends nothing.
    """
    try:
        existing = touched_periods(spark.read.parquet(path), incoming, table)
    except Exception as error:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        existing = incoming.where(F.lit(False))
    seen = Observation("append")
    rows = new_vintages(existing, incoming, table).withColumn(PERIOD, period_of(table)).hint("rebalance", PERIOD, *partition_by)
    rows.observe(seen, F.count(F.lit(1)).alias("inserted")).write.mode("append").partitionBy(PERIOD, *partition_by).parquet(path)
    return int(seen.get["inserted"])


def insert_if_absent(existing: DataFrame, incoming: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    return incoming.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def evidence_links(parents: DataFrame, *, parent: str, ids: str = "evidence_ids", child: str = "evidence_id") -> DataFrame:
    """Link table rows of an id array."""
    return parents.select(parent, F.explode(ids).alias(child)).distinct()


def overwrite_by_id(existing: DataFrame, incoming: DataFrame, *, key: Sequence[str] = ("security_id",),
                    updated: str = "updated_at") -> DataFrame:
    """Latest description per stable id; an incoming row wins a tie."""
    both = existing.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)))
    return latest_by(both, keys=list(key), order=[updated, "__in"]).drop("__in")
