"""CSV uploads of holdings, coverage and security universes, checked row by row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.functions.numeric import finite
from knownby.operators.intervals import resolve
from knownby.operators.pit import Instant, instant
from knownby.operators.scale import attach

# Allowed enumerations.
SCHEMES = ("ticker", "mic_ticker", "isin", "cusip", "sedol", "ric", "bbgid", "figi", "vendor")
SECURITY_TYPES = ("common_stock", "adr", "etf", "index", "other")
STATUSES = ("active", "inactive", "delisted")
HEADER_ALIASES = {"identifier_type": "identifier_scheme"}


@dataclass(frozen=True)
class UploadSpec:
    """Columns of an upload and the length bounds of its text fields."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    lengths: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.required + self.optional


_REFERENCE = ("identifier_scheme", "provider", "exchange_mic")
_LENGTHS = {"identifier": (1, 128), "thesis_id": (1, 128), "benchmark": (1, 128), "provider": (1, 80),
            "exchange_mic": (4, 4)}
HOLDINGS = UploadSpec("holdings", ("identifier", "weight"), ("thesis_id", "benchmark", *_REFERENCE), _LENGTHS)
COVERAGE = UploadSpec(
    "coverage", ("identifier",), ("thesis_id", "benchmark", "peer_group", *_REFERENCE),
    {**_LENGTHS, "peer_group": (1, 160)},
)
UNIVERSE = UploadSpec(
    "universe",
    ("security_id", "identifier", "identifier_scheme", "name", "security_type", "status",
     "primary_currency", "valid_from"),
    ("provider", "exchange_mic", "exchange_timezone", "country_code", "region", "sector", "industry",
     "benchmark", "first_trade_date", "last_trade_date", "valid_to"),
    {**_LENGTHS, "name": (1, 300), "primary_currency": (3, 3), "country_code": (2, 2), "region": (1, 120),
     "sector": (1, 120), "industry": (1, 160), "exchange_timezone": (1, 80)},
)


def number_rows(df: DataFrame, *, name: str = "row_number", first: int = 2) -> DataFrame:
    """Row numbers in file order without sorting the file in one task.

    A scan's rows are numbered inside their split; split sizes give the offsets.
    """
    tagged = df.withColumn("__id", F.monotonically_increasing_id()).withColumn(
        "__part", F.shiftright("__id", 33)
    )
    from pyspark.sql import Window

    sizes = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return attach(tagged, offsets, ["__part"], "inner").withColumn(
        name, F.col("__off") + inside + F.lit(first)
    ).drop("__id", "__part", "__off")


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text, with aliased lower-case headers and row numbers."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=False)
    names = [c.lstrip("﻿").strip().lower() for c in raw.columns]
    return number_rows(raw.toDF(*[HEADER_ALIASES.get(n, n) for n in names]))


def upload_hash(spark: SparkSession, path: str) -> DataFrame:
    """Identity of an upload: sha256 of the file content."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("source_hash"))


def header_issues(df: DataFrame, spec: UploadSpec) -> list[tuple[str, str]]:
    """(column, severity) of missing (error) and unused (warning) columns; no data is read."""
    present = set(df.columns) - {"row_number"}
    missing = [(c, "error") for c in sorted(set(spec.required) - present)]
    return missing + [(c, "warning") for c in sorted(present - set(spec.columns))]


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    value = F.trim(F.col(name))
    return F.when(value != "", value)


def _row_rules(spec: UploadSpec) -> list[tuple[str, str, Column]]:
    """(field, message, broken) over the cleaned text columns."""
    rules = [(c, "field required", F.col(c).isNull()) for c in spec.required]
    rules += [
        (c, f"length must be {low} to {high}", ~F.length(c).between(low, high))
        for c, (low, high) in spec.lengths.items() if c in spec.columns
    ]
    one_of = lambda c, allowed: (c, "value is not allowed", ~F.lower(c).isin(*allowed))
    rules.append(one_of("identifier_scheme", SCHEMES))
    if "weight" in spec.columns:
        number = finite("weight")
        rules.append(
            ("weight", "weight must be finite and expressed as a decimal",
             F.col("weight").isNotNull() & (number.isNull() | (F.abs(number) > 10)))
        )
    if spec.name == "universe":
        rules += [one_of("security_type", SECURITY_TYPES), one_of("status", STATUSES)]
        dates = ("first_trade_date", "last_trade_date")
        rules += [
            (c, "date cannot be parsed", F.col(c).isNotNull() & F.try_to_date(c).isNull()) for c in dates
        ]
        rules += [
            (c, "timestamp cannot be parsed", F.col(c).isNotNull() & F.try_to_timestamp(c).isNull())
            for c in ("valid_from", "valid_to")
        ]
        rules += [
            ("provider", "provider is required for vendor identifiers",
             (F.lower("identifier_scheme") == "vendor") & F.col("provider").isNull()),
            ("valid_to", "valid_to must be later than valid_from",
             F.try_to_timestamp("valid_to") <= F.try_to_timestamp("valid_from")),
            ("last_trade_date", "last_trade_date cannot precede first_trade_date",
             F.try_to_date("last_trade_date") < F.try_to_date("first_trade_date")),
        ]
    return rules


def parse_upload(rows: DataFrame, spec: UploadSpec) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and issues (row_number, field, message, value, severity).

    ``rows`` holds text columns plus row_number. Blank rows are skipped. Of valid
    rows repeating a security the first is kept; the first row number per
    security comes from an aggregate, so one repeated security is no hot window.
    """
    missing = [c for c, severity in header_issues(rows, spec) if severity == "error"]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    clean = rows.select("row_number", *[_text(rows, c).alias(c) for c in spec.columns])
    clean = clean.where(F.coalesce(*[F.col(c) for c in spec.columns]).isNotNull())
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(broken, F.lit(False)),
                    F.struct(F.lit(c).alias("field"), F.lit(message).alias("message"), F.col(c).alias("value")),
                )
                for c, message, broken in _row_rules(spec)
            ]
        )
    )
    judged = clean.withColumn("__issues", found)
    bad = judged.select("row_number", F.explode("__issues").alias("__i")).select("row_number", "__i.*")
    good = judged.where(F.size("__issues") == 0).drop("__issues").withColumns(
        {
            "identifier": F.upper("identifier"),
            "identifier_scheme": F.lower("identifier_scheme"),
            "provider": F.lower("provider"),
            "exchange_mic": F.upper("exchange_mic"),
            "benchmark": F.upper("benchmark"),
        }
    )
    if "weight" in spec.columns:
        good = good.withColumn("weight", F.col("weight").cast("decimal(20,10)"))
    key = ["identifier", "identifier_scheme", "provider", "exchange_mic"]
    firsts = good.groupBy(*key).agg(F.min("row_number").alias("__first"))
    ranked = attach(good, firsts, key)
    repeated = F.col("row_number") > F.col("__first")
    duplicates = ranked.where(repeated).select(
        "row_number", F.lit("identifier").alias("field"),
        F.lit("duplicate security row in the same upload").alias("message"), F.col("identifier").alias("value"),
    )
    issues = bad.unionByName(duplicates).withColumn("severity", F.lit("error"))
    return ranked.where(~repeated).drop("__first"), issues


def resolve_upload(rows: DataFrame, identifiers: DataFrame, *, as_of: Instant) -> DataFrame:
    """Uploaded rows with the resolved security_id, candidates and status."""
    return resolve(
        rows.withColumnsRenamed({"identifier_scheme": "scheme", "identifier": "value"}), identifiers, as_of=as_of
    ).withColumnsRenamed({"scheme": "identifier_scheme", "value": "identifier"})


def benchmark_choice(rows: DataFrame, securities: DataFrame, mappings: DataFrame, identifiers: DataFrame, *,
                     as_of: Instant, sector_defaults: dict[str, str] | None = None,
                     default_identifier: str | None = None) -> DataFrame:
    """Benchmark security of each row: explicit, sector default, global default, market mapping."""
    from knownby.operators.intervals import benchmark_as_of

    lookup = F.lit(None).cast("string")
    for sector, identifier in (sector_defaults or {}).items():
        lookup = F.when(F.col("__sector") == sector, F.lit(identifier)).otherwise(lookup)
    with_sector = rows.join(
        securities.select("security_id", F.col("sector").alias("__sector")), "security_id", "left"
    )
    chosen = with_sector.withColumn(
        "__wanted", F.coalesce("benchmark", lookup, F.lit(default_identifier).cast("string"))
    ).drop("__sector")
    null = F.lit(None).cast("string")
    asked = chosen.select(
        null.alias("scheme"), F.col("__wanted").alias("value"), null.alias("provider"), null.alias("exchange_mic")
    ).where("value is not null").distinct()
    named = resolve(asked, identifiers, as_of=as_of).select(
        F.col("value").alias("__wanted"), F.col("security_id").alias("__named"), F.col("status").alias("__status")
    )
    market = benchmark_as_of(mappings, as_of=as_of).where("kind = 'market'").select(
        "security_id", F.col("benchmark_security_id").alias("__mapped")
    )
    joined = chosen.join(named, "__wanted", "left").join(market, "security_id", "left")
    return joined.withColumn(
        "benchmark_security_id", F.when(F.col("__wanted").isNotNull(), F.col("__named")).otherwise(F.col("__mapped"))
    ).withColumn(
        "benchmark_status", F.when(F.col("__wanted").isNotNull(), F.col("__status")).otherwise(F.lit("mapped"))
    ).drop("__wanted", "__named", "__status", "__mapped")


def import_rows(rows: DataFrame, identifiers: DataFrame, securities: DataFrame, mappings: DataFrame, *,
                as_of: Instant, sector_defaults: dict[str, str] | None = None,
                default_identifier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing import: resolved rows, or only the issues when there is any."""
    found = resolve_upload(rows, identifiers, as_of=as_of)
    chosen = benchmark_choice(
        found, securities, mappings, identifiers, as_of=as_of, sector_defaults=sector_defaults,
        default_identifier=default_identifier,
    )
    wrong_benchmark = ~F.col("benchmark_status").isin("mapped", "resolved")
    issue = (
        F.when(F.col("status") != "resolved", F.concat(F.lit("security_"), F.col("status")))
        .when(wrong_benchmark, F.concat(F.lit("benchmark_"), F.col("benchmark_status")))
    )
    judged = chosen.withColumn("issue", issue)
    issues = judged.where("issue is not null").select("row_number", "identifier", "issue")
    verdict = judged.agg(F.count("issue").alias("__bad"))
    # One row decides for the whole upload.
    accepted = judged.join(verdict.where("__bad = 0"), F.lit(True), "inner").drop("__bad", "issue")
    return accepted, issues


def portfolio_positions(accepted: DataFrame, *, portfolio_name: str, as_of: Instant) -> DataFrame:
    return accepted.select(
        F.lit(portfolio_name).alias("portfolio_name"), instant(as_of).alias("as_of"), "security_id", "weight",
        "thesis_id", "benchmark_security_id", F.col("identifier").alias("source_identifier"),
    )


def register_universe(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Securities, identifiers and market benchmark mappings of a universe upload.

    Every security is registered before benchmarks are resolved, so a row may
    name a benchmark that appears later. Mappings carry a status.
    """
    identifiers = rows.select(
        "security_id", F.col("identifier_scheme").alias("scheme"), F.col("identifier").alias("value"),
        "provider", "exchange_mic", F.try_to_timestamp("valid_from").alias("valid_from"),
        F.try_to_timestamp("valid_to").alias("valid_to"),
    )
    securities = rows.select(
        "security_id", "name", F.lower("security_type").alias("security_type"), F.lower("status").alias("status"),
        F.upper("primary_currency").alias("primary_currency"), "sector", "industry", "region",
        F.upper("country_code").alias("country_code"), "exchange_timezone",
        F.to_date("first_trade_date").alias("first_trade_date"), F.to_date("last_trade_date").alias("last_trade_date"),
    )
    subject = rows.where("benchmark is not null").select(
        "security_id", F.col("benchmark").alias("value"), F.try_to_timestamp("valid_from").alias("valid_from"),
        F.try_to_timestamp("valid_to").alias("valid_to"),
    )
    target = identifiers.select(
        "value", F.col("security_id").alias("__b"), F.col("valid_from").alias("__f"), F.col("valid_to").alias("__t")
    )
    at = F.col("valid_from")
    in_force = (F.col("__f") <= at) & (F.col("__t").isNull() | (F.col("__t") > at))
    joined = subject.join(target, "value", "left").groupBy("security_id", "value", "valid_from", "valid_to").agg(
        F.count_distinct(F.when(in_force, F.col("__b"))).alias("candidates"),
        F.min(F.when(in_force, F.col("__b"))).alias("__b"),
    )
    status = (
        F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") > 1, "ambiguous")
        .when(F.col("__b") == F.col("security_id"), "benchmarks_itself").otherwise("resolved")
    )
    mappings = joined.select(
        "security_id", F.when(status == "resolved", F.col("__b")).alias("benchmark_security_id"),
        F.lit("market").alias("kind"), "valid_from", "valid_to", status.alias("status"),
    )
    return securities, identifiers, mappings
