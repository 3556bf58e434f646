"""Half-open validity intervals: membership, identifier resolution, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownby.operators.pit import (
    Instant, cutoff_table, instant, latest_by, ordered_cutoffs, with_first_cutoff,
)
from knownby.operators.scale import running_fold


def valid_at(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """``start <= at < end`` with a null end meaning open."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def members_as_of(
    intervals: DataFrame, *, as_of: Instant, start: str = "valid_from", end: str = "valid_to"
) -> DataFrame:
    return intervals.where(valid_at(instant(as_of), start, end))


def members_history(
    intervals: DataFrame, *, cutoffs: Sequence[Instant],
    start: str = "valid_from", end: str = "valid_to",
) -> DataFrame:
    """Members at every cutoff: each interval covers a contiguous run of cutoff numbers.

    Both ends are looked up by day equality, so no interval is compared with a
    cutoff it does not contain.
    """
    total = len(ordered_cutoffs(cutoffs))
    far = F.lit("9999-01-01").cast("timestamp")
    rows = with_first_cutoff(intervals, cutoffs, available=start, name="__lo")
    last = instant(ordered_cutoffs(cutoffs)[-1])
    # An interval ending after the last cutoff (or open) reaches the last cutoff.
    closing = rows.withColumn("__stop", F.coalesce(F.col(end), far))
    ended = closing.where(F.col("__stop") <= last)
    open_ended = closing.where(F.col("__stop") > last).withColumn("__hi", F.lit(total))
    ended = with_first_cutoff(ended, cutoffs, available="__stop", name="__hi")
    both = ended.unionByName(open_ended).where(F.col("__hi") > F.col("__lo"))
    return (
        both.withColumn("cutoff_index", F.explode(F.sequence(F.col("__lo"), F.col("__hi") - 1)))
        .join(cutoff_table(intervals.sparkSession, cutoffs), "cutoff_index")
        .select("as_of", *intervals.columns)
    )


def active_coverage_members(members: DataFrame, *, coverage_list_id: object, as_of: Instant) -> DataFrame:
    return (
        members.where(F.col("coverage_list_id") == F.lit(coverage_list_id))
        .where(valid_at(instant(as_of)))
        .orderBy("security_id")
    )


def benchmark_as_of(mappings: DataFrame, *, as_of: Instant, tie_break: Sequence[str] = ()) -> DataFrame:
    """The benchmark in force per (security, kind); the latest start wins."""
    return latest_by(
        members_as_of(mappings, as_of=as_of),
        keys=["security_id", "kind"],
        order=["valid_from", *tie_break],
    )


def resolve(references: DataFrame, identifiers: DataFrame, *, as_of: Column | Instant) -> DataFrame:
    """Resolve identifier references to securities with a status per reference.

    References are (scheme, value, provider, exchange_mic), the last two optional
    (and scheme too). ``status`` is resolved, not_found or ambiguous. Equal
    references are resolved once, so a reference repeated on a third of all rows
    is still one lookup.
    """
    at = as_of if isinstance(as_of, Column) else instant(as_of)
    names = ["scheme", "value", "provider", "exchange_mic"]
    wanted = references.select(*names).distinct()
    known = identifiers.where(valid_at(at)).select(
        "security_id", *[F.col(c).alias(f"__i_{c}") for c in names]
    )
    match = F.col("value") == F.col("__i_value")
    for optional in ("scheme", "provider", "exchange_mic"):
        match = match & (F.col(optional).isNull() | (F.col(optional) == F.col(f"__i_{optional}")))
    found = (
        wanted.join(known, match, "left")
        .groupBy(*names)
        .agg(
            F.count_distinct("security_id").alias("candidates"),
            F.min("security_id").alias("__security"),
        )
    )
    answers = found.select(
        *[F.col(c).alias(f"__r_{c}") for c in names],
        F.when(F.col("candidates") == 1, F.col("__security")).alias("security_id"),
        "candidates",
        F.when(F.col("candidates") == 0, "not_found")
        .when(F.col("candidates") == 1, "resolved")
        .otherwise("ambiguous")
        .alias("status"),
    )
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return references.join(answers, on, "left").drop(*[f"__r_{c}" for c in names])


def _hour(at: Column) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / F.lit(3600))


def overlapping_intervals(
    intervals: DataFrame, *, keys: Sequence[str], tie_break: Sequence[str],
    start: str = "valid_from", end: str = "valid_to", payload: Sequence[str] = (),
) -> DataFrame:
    """Intervals that start before an earlier interval of the same key has ended.

    A running maximum of the ends, carried over hourly buckets, replaces the
    pairwise comparison. A repeat of an interval is a retry, not an overlap, if
    it says the same: ``payload`` names what it says (default: ``tie_break``).
    """
    distinct = intervals.dropDuplicates([*dict.fromkeys([*keys, start, end, *(payload or tie_break)])])
    far = F.lit("9999-01-01").cast("timestamp")
    swept = running_fold(
        distinct,
        keys=keys,
        order=[start, *tie_break],
        bucket=_hour(F.col(start)),
        value=F.coalesce(F.col(end).cast("timestamp"), far),
        kind="max",
        name="__reach",
        inclusive=False,
    )
    return swept.where(F.col("__reach") > F.col(start)).withColumnRenamed("__reach", "overlaps_until")


def insert_intervals(
    existing: DataFrame, incoming: DataFrame, *, keys: Sequence[str], tie_break: Sequence[str],
    payload: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Split an interval import into rows to append and rejected overlaps, with all columns of the import.

    Re-importing an identical row is a retry and appends nothing. Of rows that differ in
    nothing but columns that say nothing on the interval, the one with the smallest of those is taken.
    """
    identity = list(dict.fromkeys([*keys, "valid_from", "valid_to", *payload, *tie_break]))
    rest = [c for c in incoming.columns if c not in identity]
    once = incoming.groupBy(*identity).agg((F.min(F.struct(*rest)) if rest else F.lit(None)).alias("__rest"))
    identity = [*keys, "valid_from", "valid_to", *payload]
    on = F.lit(True)
    for c in identity:
        on = on & F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}"))
    fresh = once.dropDuplicates(identity).alias("n").join(existing.alias("e"), on, "left_anti")
    columns = [*identity, *[c for c in tie_break if c not in identity]]
    marked = existing.select(*columns, F.lit(None).cast(once.schema["__rest"].dataType).alias("__rest"), F.lit(0).alias("__new")).unionByName(
        fresh.select(*columns, "__rest", F.lit(1).alias("__new"))
    )
    far = F.lit("9999-01-01").cast("timestamp")
    hour = _hour(F.col("valid_from"))
    swept = running_fold(
        marked, keys=keys, order=["valid_from", *tie_break], bucket=hour, value=F.coalesce("valid_to", far),
        kind="max", name="__before", inclusive=False,
    )
    # Looking backward from the far end finds a later-starting neighbour.
    swept = running_fold(
        swept,
        keys=keys,
        order=[F.col("valid_from").desc(), *[F.col(c).desc() for c in tie_break]],
        bucket=-hour,
        value=F.col("valid_from"),
        kind="min",
        name="__after",
        inclusive=False,
    )
    clash = (F.coalesce(F.col("__before") > F.col("valid_from"), F.lit(False))) | F.coalesce(
        F.col("__after") < F.coalesce("valid_to", far), F.lit(False)
    )
    judged = swept.where("__new = 1").select(clash.alias("__clash"), *[F.col(f"__rest.{c}").alias(c) if c in rest else F.col(c) for c in incoming.columns])
    return judged.where(~F.col("__clash")).drop("__clash"), judged.where("__clash").drop("__clash")


def active_thesis_version(versions: DataFrame, *, as_of: Instant) -> DataFrame:
    """The approved, in-force thesis version per thesis: highest version, then latest approval."""
    at = instant(as_of)
    usable = versions.where(
        valid_at(at) & F.col("approved_at").isNotNull() & (F.col("approved_at") <= at)
    )
    return latest_by(usable, keys=["thesis_id"], order=["version", "approved_at"])


def latest_portfolio_weights(snapshots: DataFrame, positions: DataFrame, *, as_of: Instant) -> DataFrame:
    """Weights of each portfolio's latest snapshot effective by the cutoff."""
    latest = latest_by(
        snapshots.where(F.col("as_of") <= instant(as_of)), keys=["portfolio_name"],
        order=["as_of", "snapshot_id"],
    )
    return (
        positions.join(latest.select("snapshot_id", "portfolio_name", "as_of"), "snapshot_id")
        .select("portfolio_name", "as_of", "security_id", "weight")
    )
