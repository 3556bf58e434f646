"""The daily research run: coverage to ranked cards in one lazy plan.

Bars are shuffled by security once; returns, residuals, z-scores, volatility,
beta and relative strength share that partitioning and sort. Benchmark returns
are joined by (benchmark, session).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownby.functions.ids import iso_instant, research_id
from knownby.functions.numeric import dispersed, finite, ratio
from knownby.operators.intervals import active_coverage_members, benchmark_as_of
from knownby.operators.moments import moments_within
from knownby.operators.pit import Instant, instant, latest_by, utc
from knownby.operators.research import (
    PRICE_COMPONENTS, Materiality, build_cards, build_price_findings, price_bar_evidence, price_components, score_materiality,
)
from knownby.operators.scale import attach
from knownby.session import materialize
from knownby.operators.series import (
    abnormal_returns, beta_of, beta_rows, fit_columns, fit_rows, latest_abnormal_returns, log_volume, relative_return, rolling_beta,
    rolling_total_return, rolling_volatility, simple_returns, volume_zscore,
)

# Feature name, snapshot column, unit, window; and the feature version.
FEATURES = (
    ("daily_return", "daily_return", "decimal_return", "1d"),
    ("residual_return", "residual_return", "decimal_return", "1d"),
    ("residual_return_zscore_1d", "residual_zscore", "zscore", "1d"),
    ("dollar_volume_zscore_20d", "volume_zscore", "zscore", "20d"),
    ("realized_volatility_20d", "realized_volatility_20d", "annualized_decimal", "20d"),
    ("beta_126d", "beta_126d", "coefficient", "126d"),
    ("relative_return_sector_63d", "relative_return_sector_63d", "decimal_return", "63d"),
)
FEATURE_VERSION = "price-mvp-v0"
MINIMUM_BARS, MINIMUM_RETURNS = 21, 63
#: Sessions that the features of one session look at: the longest window, 126, and the session itself.
SESSIONS = 127


@dataclass(frozen=True)
class DailyRequest:
    coverage_list_id: str
    as_of: Instant
    data_cutoff_at: Instant
    source: str
    calculated_at: Instant | None = None
    code_version: str = "knownby-v0"
    config_version: str = "equity-mvp-v0"
    lookback_days: int = 550

    def __post_init__(self) -> None:
        if utc(self.as_of) > utc(self.data_cutoff_at):
            raise ValueError("as_of cannot be later than data_cutoff_at")
        if self.lookback_days < 370:
            raise ValueError("lookback_days must be at least 370")

    @property
    def clock(self) -> Instant:
        """Calculation time: never before the data cutoff."""
        cutoff = utc(self.data_cutoff_at)
        return cutoff if self.calculated_at is None else max(cutoff, utc(self.calculated_at))


@dataclass(frozen=True)
class DailyRun:
    run: DataFrame
    snapshots: DataFrame
    features: DataFrame
    evidence: DataFrame
    findings: DataFrame
    cards: DataFrame
    failures: DataFrame


def member_benchmarks(members: DataFrame, mappings: DataFrame, *, as_of: Instant) -> DataFrame:
    """Market and sector benchmark of each member; the sector falls back to its own benchmark."""
    current = benchmark_as_of(mappings, as_of=as_of).where(F.col("kind").isin("market", "sector"))
    sides = current.groupBy("security_id").agg(
        F.max(F.when(F.col("kind") == "market", F.col("benchmark_security_id"))).alias("market_id"),
        F.max(F.when(F.col("kind") == "sector", F.col("benchmark_security_id"))).alias("__sector"),
    )
    return attach(members, sides, ["security_id"]).withColumn(
        "sector_id", F.coalesce("__sector", "benchmark_security_id")
    ).drop("__sector")


def usable_factors(benchmarks: DataFrame, priced: DataFrame) -> DataFrame:
    """Drop benchmarks that are the member itself, repeat the market, or have no bars."""
    known = priced.select(F.col("security_id").alias("__b")).distinct()

    def keep(df: DataFrame, column: str, extra: Column) -> DataFrame:
        facts = known.select(F.col("__b").alias(column), F.lit(True).alias("__ok"))
        found = df.join(facts, column, "left")
        ok = F.col("__ok") & (F.col(column) != F.col("security_id")) & extra
        return found.withColumn(column, F.when(ok, F.col(column))).drop("__ok")

    markets = keep(benchmarks, "market_id", F.lit(True))
    different = F.coalesce(F.col("sector_id") != F.col("market_id"), F.lit(True))
    return keep(markets, "sector_id", different)


def session_returns(bars: DataFrame) -> DataFrame:
    """One row per (security, session) with the adjusted close and its simple return, and what features read beside them."""
    order = ["available_at", "effective_at", "source_record_id"]
    # Only these: a whole bar would be carried through the selection's sorts and its shuffle.
    read = bars.select("security_id", "session_date", "close", "adjusted_close", "volume", *order)
    unique = latest_by(read, keys=["security_id", "session_date"], order=order)
    priced = unique.withColumn("adjusted_close", F.coalesce("adjusted_close", "close"))
    return simple_returns(priced, keys=["security_id"], order="session_date", value="adjusted_close", name="ret")


def beside_benchmarks(series: DataFrame, factors: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows of members beside the returns of their benchmarks: the first factor of their fits, the second and the sector."""
    as_side = lambda n: bench.select(
        F.col("security_id").alias(f"{n}_id"), "session_date", F.col("ret").alias(f"{n}_ret")
    )
    # Only what the windows need travels through them.
    work = (
        series.join(factors, "security_id")
        .join(as_side("market"), ["market_id", "session_date"], "left")
        .join(as_side("sector"), ["sector_id", "session_date"], "left")
    )
    has_market, has_sector = F.col("market_id").isNotNull(), F.col("sector_id").isNotNull()
    work = work.withColumn(
        "factor_1", F.when(has_market, F.col("market_ret")).otherwise(F.col("sector_ret"))
    ).withColumn("factor_2", F.when(has_market & has_sector, F.col("sector_ret")))
    return work.drop("market_ret")


def benchmark_ids(factors: DataFrame) -> DataFrame:
    return factors.select(F.explode(F.array("market_id", "sector_id")).alias("security_id")).where(
        "security_id is not null"
    ).distinct()


def benchmark_rows(series: DataFrame, factors: DataFrame) -> DataFrame:
    return series.join(benchmark_ids(factors), "security_id", "left_semi").select("security_id", "session_date", "ret")


def one_factor() -> Column:
    """Whether a member's fit has one factor: it lacks the market or the sector."""
    return ~(F.col("market_id").isNotNull() & F.col("sector_id").isNotNull())


def shown(work: DataFrame) -> DataFrame:
    """The price features as they are returned; those of short series are missing."""
    deep, has_sector = F.col("observations") >= MINIMUM_RETURNS, F.col("sector_id").isNotNull()
    return work.select(
        "security_id", "session_date", "effective_at", "bars", "observations", "market_id", "sector_id",
        F.col("ret").alias("daily_return"),
        F.when(deep, F.col("residual_return")).alias("residual_return"),
        F.when(deep, F.col("abnormal_score")).alias("residual_zscore"),
        "volume_zscore", "realized_volatility_20d",
        F.when(deep, F.col("beta_126d")).alias("beta_126d"),
        F.when(has_sector, F.col("relative_return_sector_63d")).alias("relative_return_sector_63d"),
        F.col("factor_1").alias("benchmark_return"), F.when(has_sector, F.col("sector_ret")).alias("sector_return"),
    )


def price_features(series: DataFrame, factors: DataFrame) -> DataFrame:
    """The seven price features of every member at every session.

    ``factors`` has (security_id, market_id, sector_id) after ``usable_factors``.
    Benchmark returns come from the benchmark's own sessions.
    """
    work = beside_benchmarks(series.select("security_id", "session_date", "effective_at", "close", "volume", "ret"), factors, benchmark_rows(series, factors))
    keys, t = ["security_id"], "session_date"
    work = abnormal_returns(work, keys=keys, order=t, asset="ret", factors=["factor_1", "factor_2"], first_factor_only=one_factor())
    work = volume_zscore(work, keys=keys, order=t, volume=F.col("close") * F.col("volume"), window=20, minimum=20)
    work = rolling_volatility(work, keys=keys, order=t, value="ret", window=20, name="realized_volatility_20d")
    work = rolling_beta(work, keys=keys, order=t, asset="ret", benchmark="factor_1", name="beta_126d")
    work = relative_return(work, asset="ret", benchmark="sector_ret", name="__rel")
    work = rolling_total_return(work, keys=keys, order=t, value="__rel", window=63, name="relative_return_sector_63d")
    path = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return shown(work.withColumns({"observations": F.count(finite("ret")).over(path), "bars": F.count(F.lit(1)).over(path)}))


def latest_features(series: DataFrame, factors: DataFrame) -> DataFrame:
    """The last row of ``price_features`` for each member, from the sessions that row looks at.

    Every window of the last row is a range of the ``SESSIONS`` rows that end with it, so one aggregation of those rows gives
    all of them; no window moves. Those rows and the whole series of benchmarks are stored first: members and both sides of
    benchmarks read them.
    """
    whole = Window.partitionBy("security_id")
    series = series.select("security_id", "session_date", "effective_at", "close", "volume", "ret").withColumns({
        "bars": F.count(F.lit(1)).over(whole), "observations": F.count(finite("ret")).over(whole),
        "__at": F.row_number().over(whole.orderBy("session_date"))})
    series = series.withColumn("__back", F.col("bars") - F.col("__at") + 1).drop("__at")
    used = benchmark_ids(factors).withColumn("__side", F.lit(True))
    series = materialize(series.join(used, "security_id", "left").where((F.col("__back") <= SESSIONS) | F.col("__side")).drop("__side"))
    # Stored, so that Spark knows how few rows benchmarks are and leaves the members' where they lie.
    bench = materialize(benchmark_rows(series, factors))
    work = beside_benchmarks(series.where(F.col("__back") <= SESSIONS), factors, bench)
    pair = ["factor_1", "factor_2"]
    raw, alone = fit_columns("ret", pair, one_factor())
    work = beta_rows(fit_rows(relative_return(work, asset="ret", benchmark="sector_ret", name="__rel"), raw), "ret", "factor_1")
    work = work.withColumns({"__logged": finite(log_volume(F.col("close") * F.col("volume"))), "__ret": finite("ret"), "__rel": finite("__rel")})

    def rows(first: int, last: int) -> Column:
        """Between so many rows from the end, which is 1."""
        return F.col("__back").between(first, last)

    def held(name: str, first: int, last: int) -> Column:
        return F.when(rows(first, last), F.col(name))

    own = ["session_date", "effective_at", "bars", "observations", "ret", *pair, "sector_ret", "__logged"]
    logged, ret, rel = held("__logged", 2, 21), held("__ret", 1, 20), held("__rel", 1, 63)
    last = work.groupBy("security_id", "market_id", "sector_id").agg(
        *[F.max(held(c, 1, 1)).alias(c) for c in own],
        *moments_within([["__u0", "__u1", "__u2"], ["__y", "__x"], ["__own"]], rows(2, SESSIONS)),
        F.when(F.count(logged) >= 20, ratio(F.max(held("__logged", 1, 1)) - F.avg(logged), dispersed(F.stddev_samp(logged), F.avg(logged)))).alias("volume_zscore"),
        F.when(F.count(ret) >= 20, F.stddev_samp(ret) * F.lit(math.sqrt(252))).alias("realized_volatility_20d"),
        F.when(F.count(rel) >= 63, F.product(F.lit(1.0) + rel) - F.lit(1.0)).alias("relative_return_sector_63d"),
    )
    last = last.withColumns({"beta_126d": beta_of(1, 2, MINIMUM_RETURNS), "__alone": alone} | {f"__v{i}": c for i, c in enumerate(raw)})
    return shown(latest_abnormal_returns(work, last, keys=["security_id"], back="__back", factors=pair))


def last_session(features: DataFrame) -> DataFrame:
    """The last row of each security, whatever is missing on it."""
    return latest_by(features, keys=["security_id"], order=["session_date"])


def long_features(snapshots: DataFrame) -> DataFrame:
    """Wide snapshot to one row per non-missing feature."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("feature_name"), F.col(column).alias("value"), F.lit(unit).alias("unit"), F.lit(window).alias("window"))
            for name, column, unit, window in FEATURES
        ]
    )
    lineage = [c for c in ("research_run_id", "effective_at", "available_at", "calculated_at") if c in snapshots.columns]
    return snapshots.select("security_id", *lineage, F.explode(cells).alias("__c")).select(
        "security_id", *lineage, "__c.*", F.lit(FEATURE_VERSION).alias("feature_version")
    ).where("value is not null")


def with_refusals(snapshots: DataFrame, materiality: Materiality) -> DataFrame:
    """Add ``refusal``, why a step after the features cannot take a snapshot; null for those that all can.

    Clocks first, those of the member's bars and of its benchmarks': a snapshot is not available before it is effective
    nor calculated before it is available. Then the score, whose components must lie in the range that its configuration allows.
    """
    scored = score_materiality(price_components(snapshots), materiality, PRICE_COMPONENTS)
    instants = F.concat(F.date_format("available_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" against "), F.date_format("effective_at", "yyyy-MM-dd HH:mm:ss"))
    reason = (
        F.when(F.col("available_at") < F.col("effective_at"), F.concat(F.lit("available before it is effective: "), instants))
        .when(F.col("calculated_at") < F.col("available_at"), F.lit("calculated before it is available"))
        .when(F.col("score_violation").isNotNull(), F.concat(F.lit("materiality input out of range: "), F.col("score_violation")))
    )
    return scored.withColumn("refusal", reason).select(*snapshots.columns, "refusal")


def run_status(members: DataFrame, failures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """failed when nothing succeeded, partial when something failed, else succeeded."""
    counts = members.agg(F.count(F.lit(1)).alias("members")).join(
        failures.agg(F.count(F.lit(1)).alias("failures")), F.lit(True), "inner"
    )
    return counts.withColumn(
        "status",
        F.when(F.col("failures") >= F.col("members"), "failed").when(F.col("failures") > 0, "partial")
        .otherwise("succeeded"),
    )


def daily_research(request: DailyRequest, *, members: DataFrame, mappings: DataFrame, bars: DataFrame,
                   weights: DataFrame | None = None, materiality: Materiality | None = None) -> DailyRun:
    """Members, bars and mappings to run, features, evidence, findings, cards and failures."""
    as_of = utc(request.as_of)
    covered = active_coverage_members(members, coverage_list_id=request.coverage_list_id, as_of=as_of)
    covered = covered.select("security_id", "benchmark_security_id").dropDuplicates(["security_id"])
    # One short row per member; stored so that the plans below stay small.
    benchmarks = materialize(member_benchmarks(covered, mappings, as_of=as_of))
    covered = benchmarks.select("security_id", "benchmark_security_id")
    wanted = benchmarks.select(
        F.explode(F.array("security_id", "market_id", "sector_id")).alias("security_id")
    ).where("security_id is not null").distinct()
    start = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp") - F.expr(
        f"interval {int(request.lookback_days)} days"
    )
    known = bars.where(
        (F.col("effective_at") >= start) & (F.col("effective_at") <= instant(as_of))
        & (F.col("available_at") <= instant(request.data_cutoff_at)) & (F.col("source") == request.source)
    ).join(wanted, "security_id", "left_semi")
    # Selected once, then read by the series, the lineage and the evidence below.
    history = materialize(
        latest_by(known, keys=["security_id", "frequency", "source", "effective_at"],
                  order=["available_at", "source_record_id"])
    )

    # The run identity lists its distinct ingestion batches (one per load, not per bar).
    batches = history.agg(
        F.array_sort(F.collect_set(F.col("ingestion_batch_id").cast("string"))).alias("ingestion_batch_ids"),
    )
    head = "|".join(
        [request.coverage_list_id, iso(as_of), iso(utc(request.data_cutoff_at)), request.source,
         request.code_version, request.config_version]
    )
    text = F.concat_ws("|", F.lit(head), F.array_join("ingestion_batch_ids", "|"))
    run_ids = batches.withColumn("run_key", F.concat(F.lit("daily:"), F.sha2(text, 256))).withColumn(
        "research_run_id", research_id("run", F.col("run_key"))
    )
    run_ids = materialize(run_ids)

    series = session_returns(history)
    factors = materialize(
        usable_factors(benchmarks, history).select("security_id", "market_id", "sector_id")
    )
    # One row per member, for those that go on and those that are too short.
    judged = materialize(attach(covered.select("security_id"), latest_features(series, factors), ["security_id"]))
    too_short = F.coalesce("bars", F.lit(0)) < MINIMUM_BARS
    short = judged.where(too_short).select(
        "security_id",
        F.concat(
            F.lit("insufficient price history: "), F.coalesce("bars", F.lit(0)).cast("string"),
            F.lit(f" bars; need at least {MINIMUM_BARS}"),
        ).alias("message"),
    )

    newest = history.groupBy("security_id").agg(
        F.max("available_at").alias("__available"),
        F.max_by(
            F.struct("source", "source_record_id", "available_at", "effective_at", "ingested_at"),
            F.struct("session_date", "available_at"),
        ).alias("__bar"),
    )
    evidence_id = research_id(
        "evidence", F.concat_ws(":", "__bar.source", "__bar.source_record_id", iso_instant("__bar.available_at"))
    )
    stamps = newest.select("security_id", "__available", evidence_id.alias("__evidence"))
    enough = judged.where(~too_short)
    for side in ("security", "market", "sector"):
        column = f"{side}_id"
        enough = enough.join(
            stamps.select(
                F.col("security_id").alias(column), F.col("__available").alias(f"__av_{side}"),
                F.col("__evidence").alias(f"__ev_{side}"),
            ),
            column, "left",
        )
    snapshots = (
        enough.withColumn("available_at", F.greatest("__av_security", "__av_market", "__av_sector"))
        .withColumn(
            "evidence_ids", F.array_distinct(F.array_compact(F.array("__ev_security", "__ev_market", "__ev_sector")))
        )
        .withColumn("as_of", F.col("effective_at"))
        .withColumn("calculated_at", instant(request.clock))
        .withColumn("created_at", instant(request.clock))
        .join(run_ids.select("research_run_id"), F.lit(True), "inner")
        .drop(*[f"__{p}_{s}" for p in ("av", "ev") for s in ("security", "market", "sector")])
    )
    if weights is None:
        snapshots = snapshots.withColumn("position_weight", F.lit(None).cast("double"))
    else:
        held = weights.select("security_id", F.col("weight").cast("double").alias("position_weight"))
        snapshots = attach(snapshots, held, ["security_id"])

    # One row per member feeds features, findings and cards. A member that a step refuses leaves with the reason of the
    # first one that does; the others go on.
    judged_rows = materialize(with_refusals(snapshots, materiality or Materiality()))
    failures = short.unionByName(judged_rows.where("refusal is not null").select("security_id", F.col("refusal").alias("message")))
    failures = failures.join(run_ids.select("research_run_id"), F.lit(True), "inner")
    snapshots = judged_rows.where("refusal is null").drop("refusal")
    features = long_features(snapshots).withColumn(
        "feature_snapshot_id",
        research_id("feature", F.concat_ws(":", "research_run_id", F.col("security_id").cast("string"), "feature_name")),
    ).withColumn("code_version", F.lit(request.code_version)).withColumn(
        "config_version", F.lit(request.config_version)
    )
    findings = build_price_findings(snapshots, materiality or Materiality())
    context = snapshots.select(
        "research_run_id", "security_id", "position_weight", "daily_return", "benchmark_return", "sector_return",
    )
    cards = build_cards(findings, context).withColumn(
        "data_cutoff_at", instant(request.data_cutoff_at)
    ).withColumn("created_at", instant(request.clock))
    used = snapshots.select(F.explode(F.array("security_id", "market_id", "sector_id")).alias("security_id")).where(
        "security_id is not null"
    ).distinct()
    evidence = price_bar_evidence(history.join(used, "security_id", "left_semi"))
    run = run_status(covered, failures).join(run_ids, F.lit(True), "inner").select(
        "research_run_id", "run_key", instant(as_of).alias("as_of"),
        instant(request.data_cutoff_at).alias("data_cutoff_at"), instant(request.clock).alias("started_at"),
        "status", "members", "failures", "ingestion_batch_ids",
        F.lit(request.code_version).alias("code_version"), F.lit(request.config_version).alias("config_version"),
    )
    return DailyRun(run, snapshots, features, evidence, findings, cards, failures)


def iso(value) -> str:
    """Python text of a UTC instant, equal to ``iso_instant`` in a plan."""
    return value.isoformat()


def store_daily_run(run: DailyRun, root: str) -> None:
    """Insert-if-absent of every output table; a repeated run adds nothing."""
    from knownby.sources.appends import insert_if_absent

    spark = run.run.sparkSession
    tables = {
        "runs": (run.run, ["run_key"]), "features": (run.features, ["feature_snapshot_id"]),
        "evidence": (run.evidence, ["evidence_id"]), "findings": (run.findings, ["finding_key"]),
        "cards": (run.cards, ["card_key"]), "failures": (run.failures, ["research_run_id", "security_id"]),
    }
    for name, (df, key) in tables.items():
        path = f"{root}/{name}"
        try:
            stored = spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            stored = spark.createDataFrame([], df.schema)
        insert_if_absent(stored, df, key=key).write.mode("append").parquet(path)
