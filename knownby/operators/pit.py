"""Point-in-time selection: the record vintage knowable at a cutoff.

A vintage is selected with an aggregate (largest ordering struct per key), not
with a full window sort: map-side partial aggregation leaves at most one row per
key and map task to shuffle, so a key with a third of all vintages costs no more
than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from knownby.operators.scale import attach
from knownby.session import materialize

Instant = datetime | str


def utc(value: Instant) -> datetime:
    """A timezone-aware cutoff in UTC; a naive datetime is rejected."""
    parsed = datetime.fromisoformat(value) if isinstance(value, str) else value
    if parsed.tzinfo is None or parsed.utcoffset() is None:
        raise ValueError("cutoff must be timezone-aware")
    return parsed.astimezone(timezone.utc)


def instant(value: Instant) -> Column:
    return F.lit(utc(value).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def latest_by(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ordering tuple per key (nulls order first)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = F.struct(*order)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def latest_vintage_as_of(
    df: DataFrame,
    *,
    as_of: Instant,
    keys: Sequence[str],
    available: str = "available_at",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Latest row per key with ``available <= as_of``.

    Input order has no meaning in a distributed table, so rows published at the
    same instant are ordered by ``tie_break``, the larger tuple winning.
    """
    require_columns(df, [*keys, available, *tie_break])
    return latest_by(
        df.where(F.col(available) <= instant(as_of)), keys=keys, order=[available, *tie_break]
    )


def select_snapshots_as_of(
    df: DataFrame, *, as_of: Instant, entities: Sequence[str], available: str = "available_at",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Latest snapshot per entity; text timestamps that do not parse fail the job."""
    parsed = normalize_utc(df, available, strict=True)
    return latest_vintage_as_of(
        parsed, as_of=as_of, keys=entities, available=available, tie_break=tie_break
    )


def latest_estimates_as_of(
    df: DataFrame, *, as_of: Instant,
    keys: Sequence[str] = ("security_id", "metric", "fiscal_period"),
    available: str = "available_at", tie_break: Sequence[str] = (),
) -> DataFrame:
    return latest_vintage_as_of(df, as_of=as_of, keys=keys, available=available, tie_break=tie_break)


def latest_macro_vintages_as_of(
    df: DataFrame, *, as_of: Instant, keys: Sequence[str] = ("series_id", "period_end"),
    available: str = "available_at", tie_break: Sequence[str] = (),
) -> DataFrame:
    return latest_vintage_as_of(df, as_of=as_of, keys=keys, available=available, tie_break=tie_break)


def latest_ownership_snapshots_as_of(
    df: DataFrame, *, as_of: Instant, keys: Sequence[str] = ("security_id",),
    available: str = "available_at", tie_break: Sequence[str] = (),
) -> DataFrame:
    return latest_vintage_as_of(df, as_of=as_of, keys=keys, available=available, tie_break=tie_break)


def ordered_cutoffs(cutoffs: Sequence[Instant]) -> list[datetime]:
    """Cutoffs in UTC; they must be strictly increasing."""
    values = [utc(c) for c in cutoffs]
    if not values or any(a >= b for a, b in zip(values, values[1:])):
        raise ValueError("cutoffs must be non-empty and strictly increasing")
    return values


def cutoff_calendar(spark: SparkSession, cutoffs: Sequence[Instant]) -> DataFrame:
    """One row per calendar day up to the last cutoff: cutoffs inside the day, and the next one.

    The table has (last day - first day + 1) rows, so the lookup of the first
    cutoff at or after an instant is an equi-join on the day for any number of
    cutoffs, with no range join. It goes to every task: rows that share a day never meet.
    """
    values = ordered_cutoffs(cutoffs)
    naive = [v.replace(tzinfo=None) for v in values]
    days: dict[date, list[tuple[int, datetime]]] = {}
    for index, value in enumerate(naive):
        days.setdefault(value.date(), []).append((index, value))
    first, last = naive[0].date(), naive[-1].date()
    rows = []
    following: int | None = None
    day = last
    while day >= first:
        inside = days.get(day, [])
        rows.append((day, [i for i, _ in inside], [v for _, v in inside], following))
        if inside:
            following = inside[0][0]
        day -= timedelta(days=1)
    return F.broadcast(spark.createDataFrame(
        rows,
        "cutoff_day date, inside_index array<int>, inside_at array<timestamp_ntz>, next_index int",
    ))


def with_first_cutoff(
    df: DataFrame, cutoffs: Sequence[Instant], *, available: str, name: str = "cutoff_index"
) -> DataFrame:
    """Index of the first cutoff at which each row is knowable; later rows are dropped."""
    values = ordered_cutoffs(cutoffs)
    calendar = cutoff_calendar(df.sparkSession, cutoffs)
    stamp = F.col(available).cast("timestamp")
    start = F.lit(values[0].date())
    naive = stamp.cast("timestamp_ntz")
    joined = df.where(stamp <= instant(values[-1])).withColumn(
        "__day", F.greatest(F.to_date(stamp), start)
    ).join(calendar, F.col("__day") == F.col("cutoff_day"), "inner")
    earlier = F.size(F.filter("inside_at", lambda x: x < naive))
    index = F.when(
        earlier < F.size("inside_at"), F.try_element_at("inside_index", earlier + 1)
    ).otherwise(F.col("next_index"))
    return joined.withColumn(name, index).drop(
        "__day", "cutoff_day", "inside_index", "inside_at", "next_index"
    )


def cutoff_table(spark: SparkSession, cutoffs: Sequence[Instant]) -> DataFrame:
    rows = [(i, v.replace(tzinfo=None)) for i, v in enumerate(ordered_cutoffs(cutoffs))]
    return F.broadcast(spark.createDataFrame(rows, "cutoff_index int, __at timestamp_ntz").select(
        "cutoff_index", F.col("__at").cast("timestamp").alias("as_of")
    ))


def latest_vintage_history(
    df: DataFrame,
    *,
    cutoffs: Sequence[Instant],
    keys: Sequence[str],
    available: str = "available_at",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Latest vintage per key at every cutoff, in one plan.

    Vintages are first reduced to the newest one per (key, first cutoff that
    knows it); each survivor then stands until the key's next survivor. The
    window sees at most one row per cutoff, never the raw vintages.
    """
    require_columns(df, [*keys, available, *tie_break])
    total = len(ordered_cutoffs(cutoffs))
    indexed = with_first_cutoff(df, cutoffs, available=available)
    reduced = latest_by(indexed, keys=[*keys, "cutoff_index"], order=[available, *tie_break])
    until = F.lead("cutoff_index", 1, total).over(Window.partitionBy(*keys).orderBy("cutoff_index"))
    spread = reduced.withColumn("__until", until).withColumn(
        "cutoff_index", F.explode(F.sequence(F.col("cutoff_index"), F.col("__until") - 1))
    )
    table = cutoff_table(df.sparkSession, cutoffs)
    return spread.join(table, "cutoff_index").select("as_of", *df.columns)


def price_history_as_of(
    bars: DataFrame,
    *,
    start: Instant,
    end: Instant,
    knowledge_time: Instant,
    securities: DataFrame | None = None,
    source: str | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Latest bar vintage per (security, frequency, source, effective instant)."""
    picked = bars.where(
        (F.col("effective_at") >= instant(start))
        & (F.col("effective_at") <= instant(end))
        & (F.col("available_at") <= instant(knowledge_time))
    )
    if source is not None:
        picked = picked.where(F.col("source") == source)
    if securities is not None:
        picked = picked.join(securities.select("security_id").distinct(), "security_id", "left_semi")
    keys = ["security_id", "frequency", "source", "effective_at"]
    return latest_by(picked, keys=keys, order=["available_at", *tie_break])


def events_as_of(
    events: DataFrame,
    *,
    effective_start: Instant,
    effective_end: Instant,
    knowledge_time: Instant,
    security_id: object | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Latest vintage per (source, source record) effective in a range."""
    picked = events.where(
        (F.col("effective_at") >= instant(effective_start))
        & (F.col("effective_at") <= instant(effective_end))
        & (F.col("available_at") <= instant(knowledge_time))
    )
    if security_id is not None:
        picked = picked.where(F.col("security_id") == F.lit(security_id))
    return latest_by(picked, keys=["source", "source_record_id"], order=["available_at", *tie_break])


def latest_features_as_of(
    features: DataFrame,
    *,
    effective_at: Instant,
    knowledge_time: Instant,
    feature_names: Sequence[str] | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Newest snapshot per (security, feature): effective, then available, then calculated."""
    picked = features.where(
        (F.col("effective_at") <= instant(effective_at))
        & (F.col("available_at") <= instant(knowledge_time))
        & (F.col("calculated_at") <= instant(knowledge_time))
    )
    if feature_names is not None:
        picked = picked.where(F.col("feature_name").isin(*feature_names))
    return latest_by(
        picked,
        keys=["security_id", "feature_name"],
        order=["effective_at", "available_at", "calculated_at", *tie_break],
    )


def panel_as_of(
    features: DataFrame,
    *,
    pins: DataFrame,
    as_of: Instant,
    config_version: str | None = None,
    securities: DataFrame | None = None,
) -> DataFrame:
    """Version-pinned cross-section with an ambiguity count per (security, feature).

    ``pins`` has (feature_name, feature_version). ``candidates`` counts the rows
    sharing the winning (effective, available, calculated) tuple; more than one
    means the panel is ambiguous (see ``require_unambiguous``). Pins go to every
    task (one row per pinned feature), and snapshots are never grouped by feature.
    """
    cutoff = instant(as_of)
    picked = features.where(
        (F.col("effective_at") <= cutoff)
        & (F.col("available_at") <= cutoff)
        & (F.col("calculated_at") <= cutoff)
    )
    if config_version is not None:
        picked = picked.where(F.col("config_version") == config_version)
    # Spark does not know how small a table made of Python rows is; without the hint it would shuffle all snapshots by feature
    # and version, of which there are few: a task would sort every row of a feature.
    picked = picked.join(F.broadcast(pins), ["feature_name", "feature_version"], "left_semi")
    if securities is not None:
        picked = picked.join(securities.select("security_id").distinct(), "security_id", "left_semi")
    keys = ["security_id", "feature_name"]
    order = ["effective_at", "available_at", "calculated_at"]
    # Counting per full ordering tuple first keeps ties and hot keys map-side.
    rest = [c for c in features.columns if c not in [*keys, *order]]
    tied = picked.groupBy(*keys, *order).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max(F.struct(*rest)).alias("__rest") if rest else F.lit(None).alias("__rest"),
    )
    best = latest_by(tied, keys=keys, order=order)
    return best.select(
        *[
            F.col(c) if c in [*keys, *order] else F.col(f"__rest.{c}").alias(c)
            for c in features.columns
        ],
        "candidates",
    )


def refuse(violations: DataFrame, message: str) -> None:
    """Raise if there is any violation.

    The check is an action of its own, before the result exists. A check inside a
    column or a filter of the result goes as soon as the caller does not read it,
    or Spark moves another filter below it.
    """
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def stored_once(df: DataFrame, *, violates: Column, shown: Sequence[str], message: str,
                then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Store ``then`` of the rows and raise if any row violates, in one evaluation of them.

    Violations are counted by an observation below ``then``: neither its filters nor the columns it leaves out keep a
    row from being looked at. The rows come back from the stored file.
    """
    seen = Observation()
    example = F.max(F.when(violates, F.to_json(F.struct(*shown))))
    watched = df.observe(seen, F.count_if(F.coalesce(violates, F.lit(True))).alias("violations"), example.alias("example"))
    rows = materialize(then(watched))
    found = seen.get
    if found["violations"]:
        raise ValueError(f"{message}: {found['example']} ({found['violations']} rows)")
    return rows


def require_unambiguous(panel: DataFrame) -> DataFrame:
    """The panel, stored once, if no cell of it has several winning snapshots."""
    shared = F.coalesce(F.col("candidates"), F.lit(0)) != 1
    return stored_once(panel, violates=shared, shown=["security_id", "feature_name", "candidates"], message="ambiguous feature snapshots")


def cards_as_of(
    cards: DataFrame, *, knowledge_time: Instant, security_id: object | None = None
) -> DataFrame:
    """Cards built and cut off by the knowledge time, newest first."""
    cutoff = instant(knowledge_time)
    picked = cards.where((F.col("data_cutoff_at") <= cutoff) & (F.col("created_at") <= cutoff))
    if security_id is not None:
        picked = picked.where(F.col("security_id") == F.lit(security_id))
    return picked.orderBy(F.col("as_of").desc(), F.col("card_id"))


def availability_violations(
    df: DataFrame, *, decision: str = "decision_at", available: str = "available_at"
) -> DataFrame:
    """Rows that were not knowable when the decision was taken (or lack an instant)."""
    require_columns(df, [decision, available])
    return df.where(unavailable(decision, available))


def unavailable(decision: str = "decision_at", available: str = "available_at") -> Column:
    return F.col(decision).isNull() | F.col(available).isNull() | (F.col(available) > F.col(decision))


def assert_available_by_decision(
    df: DataFrame, *, decision: str = "decision_at", available: str = "available_at"
) -> DataFrame:
    """The rows, once none of them became known after its decision."""
    late = availability_violations(df, decision=decision, available=available)
    refuse(late.select(decision, available), "rows unavailable at decision time")
    return df



def normalize_utc(df: DataFrame, column: str, *, strict: bool = False) -> DataFrame:
    """Parse a column to a UTC instant; ``<column>_invalid`` marks unparseable input."""
    parsed = F.try_to_timestamp(F.col(column).cast("string"))
    invalid = parsed.isNull()
    if strict:
        return df.withColumn(
            column,
            F.when(
                invalid, F.raise_error(F.lit(f"{column} contains invalid timestamps")).cast("timestamp")
            ).otherwise(parsed),
        )
    return df.withColumn(f"{column}_invalid", invalid).withColumn(column, parsed)


def latest_snapshot_rows(
    df: DataFrame, *, keys: Sequence[str], available: str = "available_at", as_of: Instant | None = None
) -> DataFrame:
    """All rows of each key's single latest snapshot instant."""
    known = df if as_of is None else df.where(F.col(available) <= instant(as_of))
    newest = known.groupBy(*keys).agg(F.max(available).alias("__newest"))
    return (
        attach(known, newest, keys, "inner").where(F.col(available) == F.col("__newest")).drop("__newest")
    )


def list_securities(securities: DataFrame, *, active_only: bool = True) -> DataFrame:
    picked = securities.where("active") if active_only else securities
    return picked.orderBy("name", "security_id")
