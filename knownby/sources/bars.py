"""Price-bar and release normalization, batch loading and batch checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownby.functions.ids import iso_instant
from knownby.functions.numeric import finite
from knownby.operators.pit import latest_by, require_columns
from knownby.operators.scale import attach

PRICE_COLUMNS = ("session_date", "open", "high", "low", "close", "volume")
NO_ADJUSTED = "adjusted_close was unavailable; price returns will be unadjusted"  # fixed value


def price_violations(df: DataFrame) -> Column:
    """Names of the rules a raw bar breaks."""
    prices = ["open", "high", "low", "close"] + (["adjusted_close"] if "adjusted_close" in df.columns else [])
    numbers = [*prices, "volume"]
    bad_number = F.lit(False)
    for c in numbers:
        bad_number = bad_number | finite(c).isNull()
    not_positive = F.lit(False)
    for c in prices:
        not_positive = not_positive | (finite(c) <= 0)
    o, h, l, c = (finite(x) for x in ("open", "high", "low", "close"))
    out_of_range = (h < F.greatest(o, l, c)) | (l > F.least(o, h, c))
    rules = [
        (F.col("session_date").try_cast("date").isNull(), "invalid_session_date"),
        (bad_number, "missing_or_non_finite_value"),
        (not_positive, "non_positive_price"),
        (finite("volume") < 0, "negative_volume"),
        (out_of_range, "inconsistent_range"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(n)) for b, n in rules]))


def normalize_prices(df: DataFrame, *, keys: Sequence[str] = ("security_id",),
                     sequence: Sequence[str] = ("available_at",)) -> tuple[DataFrame, DataFrame]:
    """Canonical daily bars and the rows rejected with their reasons.

    Of rows repeating a session the one last in ``sequence`` is kept. A missing
    adjusted close falls back to the close.
    """
    require_columns(df, [*keys, *PRICE_COLUMNS])
    marked = df.withColumn("violations", price_violations(df))
    rejected = marked.where(F.size("violations") > 0)
    good = marked.where(F.size("violations") == 0).drop("violations").withColumn(
        "session_date", F.col("session_date").try_cast("date")
    )
    numbers = {c: finite(c) for c in ("open", "high", "low", "close", "volume")}
    adjusted = finite("adjusted_close") if "adjusted_close" in df.columns else finite("close")
    kept = latest_by(good, keys=[*keys, "session_date"], order=list(sequence))
    return kept.withColumns({**numbers, "adjusted_close": adjusted}), rejected


def price_quality_report(raw: DataFrame, normalized: DataFrame, *, keys: Sequence[str] = ("security_id",),
                         calendar: DataFrame | None = None) -> DataFrame:
    """Per key: input and output rows, repeats removed, missing sessions, warnings."""
    seen = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("input_rows"))
    kept = normalized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("output_rows"), F.min("session_date").alias("__lo"),
        F.max("session_date").alias("__hi"),
    )
    report = attach(seen, kept, keys).withColumn("output_rows", F.coalesce("output_rows", F.lit(0)))
    report = report.withColumn("duplicate_rows_removed", F.col("input_rows") - F.col("output_rows"))
    if calendar is None:
        report = report.withColumn("missing_sessions", F.lit(0).cast("bigint"))
    else:
        # Calendar positions of the first and last session bound the expected count,
        # so no session list is expanded per security.
        from pyspark.sql import Window

        days = calendar.select(F.col("session_date").try_cast("date").alias("session_date")).distinct()
        ranked = days.withColumn("__pos", F.row_number().over(Window.orderBy("session_date")))
        on_calendar = normalized.join(ranked, "session_date").groupBy(*keys).agg(
            F.count_distinct("session_date").alias("__seen"), F.min("__pos").alias("__first"),
            F.max("__pos").alias("__last"),
        )
        report = attach(report, on_calendar, keys).withColumn(
            "missing_sessions",
            F.coalesce(F.col("__last") - F.col("__first") + 1 - F.col("__seen"), F.lit(0)).cast("bigint"),
        ).drop("__seen", "__first", "__last")
    absent = F.when(
        F.col("missing_sessions") > 0,
        F.concat(F.col("missing_sessions").cast("string"), F.lit(" expected trading sessions are absent")),
    )
    fallback = F.lit(None) if "adjusted_close" in raw.columns else F.lit(NO_ADJUSTED)
    return report.withColumn("warnings", F.array_compact(F.array(absent, fallback.cast("string")))).drop("__lo", "__hi")


def normalize_releases(df: DataFrame) -> DataFrame:
    """Economic releases with surprise, revision and availability; bad dates are flagged."""
    require_columns(df, ["event_id", "period_end", "release_timestamp", "actual", "source"])
    for c in ("consensus", "prior", "revised_prior"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    out = df.withColumns({c: finite(c) for c in ("actual", "consensus", "prior", "revised_prior")})
    out = out.withColumn("period_end", F.try_to_date(F.col("period_end").cast("string"))).withColumn(
        "release_timestamp", F.try_to_timestamp(F.col("release_timestamp").cast("string"))
    )
    return out.withColumns(
        {
            "surprise": F.col("actual") - F.col("consensus"),
            "revision": F.col("revised_prior") - F.col("prior"),
            "available_at": F.col("release_timestamp"),
            "date_invalid": F.col("period_end").isNull() | F.col("release_timestamp").isNull(),
        }
    )


def load_batch(request: DataFrame, bars: DataFrame, *, source: str, batch_id: Column,
               ingested_at: Column, currency: str = "USD") -> DataFrame:
    """Bars of the requested symbols and dates with lineage columns.

    ``request`` has (security_id, provider_identifier, start_date, end_date);
    ``bars`` has provider_identifier and normalized prices. A requested symbol
    without any bar yields one row with null prices (see ``batch_status``).
    """
    wanted = request.withColumn("__symbol", F.upper("provider_identifier"))
    offered = bars.withColumn("__symbol", F.upper("provider_identifier")).drop("provider_identifier", "security_id")
    within = (F.col("session_date") >= F.col("start_date")) & (F.col("session_date") <= F.col("end_date"))
    joined = wanted.join(offered, "__symbol", "left").where(F.col("session_date").isNull() | within)
    has = lambda c: c in bars.columns
    midnight = F.col("session_date").cast("timestamp")
    given = F.col("effective_at") if has("effective_at") else F.lit(None).cast("timestamp")
    adjusted = F.col("adjusted_close") if has("adjusted_close") else F.lit(None).cast("double")
    known = F.col("available_at") if has("available_at") else F.lit(None).cast("timestamp")
    found = F.col("session_date").isNotNull()
    return joined.select(
        "security_id", "provider_identifier", "session_date",
        F.coalesce(given, midnight).alias("effective_at"),
        F.coalesce(known, given, midnight).alias("available_at"),
        F.when(found, ingested_at).alias("ingested_at"),
        "open", "high", "low", "close",
        F.coalesce(adjusted, F.col("close")).alias("adjusted_close"), "volume",
        (F.coalesce(F.col("currency"), F.lit(currency)) if has("currency") else F.lit(currency)).alias("currency"),
        F.try_divide(F.coalesce(adjusted, F.col("close")), F.col("close")).alias("adjustment_factor"),
        F.lit(source).alias("source"),
        F.concat_ws(":", "provider_identifier", F.date_format("session_date", "yyyy-MM-dd")).alias("source_record_id"),
        batch_id.alias("ingestion_batch_id"),
        F.array_compact(
            F.array(
                F.when(found & given.isNull(), F.lit("estimated_timestamp")),
                F.when(found & adjusted.isNull(), F.lit("unadjusted")),
            )
        ).alias("quality_flags"),
    )


def batch_status(loaded: DataFrame, *, strict_failure: bool = True, requested: DataFrame | None = None) -> DataFrame:
    """Status of each batch from its loaded rows.

    With ``strict_failure`` a batch that got nothing has failed; otherwise missing
    symbols only make it partial. ``requested`` (ingestion_batch_id) names the batches
    that were asked for: one whose symbols all have bars, but none in the range, has
    no loaded row and has succeeded with none.
    """
    found = F.col("session_date").isNotNull()
    counts = loaded.groupBy("ingestion_batch_id").agg(
        F.count_if(found).alias("row_count"),
        F.count_distinct(F.when(~found, F.col("provider_identifier"))).alias("missing_symbols"),
    )
    if requested is not None:
        named = requested.select("ingestion_batch_id").distinct()
        counts = named.join(counts, "ingestion_batch_id", "left").na.fill(0, ["row_count", "missing_symbols"])
    failed = (F.col("row_count") == 0) & (F.col("missing_symbols") > 0) & F.lit(strict_failure)
    return counts.withColumn(
        "status",
        F.when(failed, "failed").when(F.col("missing_symbols") > 0, "partial").otherwise("succeeded"),
    )


def batch_violations(batches: DataFrame, bars: DataFrame, request: DataFrame) -> DataFrame:
    """Broken promises of a provider response: (ingestion_batch_id, violation, detail).

    ``batches`` has (ingestion_batch_id, row_count, status, request_fingerprint).
    """
    name = "ingestion_batch_id"
    counted = bars.groupBy(name).agg(F.count(F.lit(1)).alias("__rows"))
    joined = batches.join(counted, name, "left").withColumn("__rows", F.coalesce("__rows", F.lit(0)))
    row_issue = lambda c, text, detail: joined.where(c).select(name, F.lit(text).alias("violation"), detail.alias("detail"))
    counts = row_issue(F.col("__rows") != F.col("row_count"), "row_count_mismatch", F.col("__rows").cast("string"))
    blank = row_issue(F.coalesce("request_fingerprint", F.lit("")) == "", "missing_fingerprint", F.lit(""))
    failed = row_issue((F.col("status") == "failed") & (F.col("__rows") > 0), "failed_batch_has_rows", F.col("__rows").cast("string"))
    strangers = (
        bars.join(request.select("security_id").distinct(), "security_id", "left_anti")
        .select(name, F.lit("unrequested_security").alias("violation"), F.col("security_id").cast("string").alias("detail")).distinct()
    )
    orphans = (
        bars.join(batches.select(name), name, "left_anti")
        .select(name, F.lit("unknown_batch").alias("violation"), F.col(name).cast("string").alias("detail")).distinct()
    )
    repeats = (
        bars.groupBy(name, "security_id", "source", "effective_at", "available_at")
        .agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        .select(name, F.lit("duplicate_vintage").alias("violation"),
                F.concat_ws("/", F.col("security_id").cast("string"), iso_instant("available_at")).alias("detail"))
    )
    out = counts
    for part in (blank, failed, strangers, orphans, repeats):
        out = out.unionByName(part)
    return out
