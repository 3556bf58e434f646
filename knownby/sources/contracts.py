"""Row contracts: every rule a record breaks, as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownby.functions.numeric import finite


def _finite_or_missing(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.isnan(c) | (F.abs(c) == float("inf"))


def _negative(name: str) -> Column:
    return _finite_or_missing(name) | (F.col(name) < 0)


def _outside(name: str, low: float, high: float) -> Column:
    return ~F.col(name).between(low, high)


def _terminal_open() -> Column:
    return F.col("status").isin("succeeded", "partial", "failed") & F.col("completed_at").isNull()


def _length(name: str, low: int, high: int) -> Column:
    return ~F.length(name).between(low, high)


def rules(record: str) -> list[tuple[str, Column]]:
    """(rule name, condition under which it is broken) for a record type."""
    o, h, l, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    late = F.col("available_at") > F.col("ingested_at")
    table = {
        "batch": lambda: [
            ("started_before_requested", F.col("started_at") < F.col("requested_at")),
            ("completed_before_started", F.col("completed_at") < F.col("started_at")),
            ("terminal_without_completion", _terminal_open()),
            ("negative_row_count", F.col("row_count") < 0),
        ],
        "bar": lambda: [
            ("effective_after_available", F.col("effective_at") > F.col("available_at")),
            ("available_after_ingested", late),
            ("bad_price", _negative("open") | _negative("high") | _negative("low") | _negative("close")),
            ("bad_adjusted_close", _negative("adjusted_close")),
            ("negative_volume", F.col("volume") < 0),
            ("high_below_others", h < F.greatest(o, c, l)),
            ("low_above_others", l > F.least(o, c, h)),
            ("bad_currency", _length("currency", 3, 3)),
        ],
        "action": lambda: [
            ("available_after_ingested", late),
            ("non_positive_ratio", F.col("ratio") <= 0),
        ],
        "event": lambda: [
            ("available_after_ingested", late),
            ("bad_title", _length("title", 1, 500)),
        ],
        "feature": lambda: [
            ("effective_after_calculated", F.col("effective_at") > F.col("calculated_at")),
            ("available_after_calculated", F.col("available_at") > F.col("calculated_at")),
        ],
        "run": lambda: [
            ("as_of_after_cutoff", F.col("as_of") > F.col("data_cutoff_at")),
            ("cutoff_after_started", F.col("data_cutoff_at") > F.col("started_at")),
            ("completed_before_started", F.col("completed_at") < F.col("started_at")),
            ("terminal_without_completion", _terminal_open()),
        ],
        "evidence": lambda: [("available_after_ingested", late)],
        "finding": lambda: [("available_after_created", F.col("available_at") > F.col("created_at"))],
        "score": lambda: [
            ("raw_score_out_of_range", _outside("raw_score", 0.0, 1.0)),
            ("completeness_out_of_range", _outside("completeness", 0.0, 1.0)),
            ("negative_modifier", F.col("priority_modifier") < 0),
            ("negative_priority", F.col("priority_score") < 0),
        ],
        "card": lambda: [
            ("as_of_after_cutoff", F.col("as_of") > F.col("data_cutoff_at")),
            ("cutoff_after_created", F.col("data_cutoff_at") > F.col("created_at")),
        ],
        "thesis_version": lambda: [
            ("version_below_one", F.col("version") < 1),
            ("empty_interval", F.col("valid_to") <= F.col("valid_from")),
            ("approved_after_created", F.col("approved_at") > F.col("created_at")),
        ],
        "security": lambda: [
            ("last_trade_before_first", F.col("last_trade_date") < F.col("first_trade_date")),
            ("updated_before_created", F.col("updated_at") < F.col("created_at")),
        ],
        "identifier": lambda: [
            ("empty_interval", F.col("valid_to") <= F.col("valid_from")),
            ("vendor_without_provider", (F.col("scheme") == "vendor") & (F.coalesce("provider", F.lit("")) == "")),
        ],
        "benchmark_mapping": lambda: [
            ("benchmarks_itself", F.col("security_id") == F.col("benchmark_security_id")),
            ("empty_interval", F.col("valid_to") <= F.col("valid_from")),
        ],
        "position": lambda: [
            ("bad_weight", F.col("weight").isNull() | finite("weight").isNull() | (F.abs("weight") > 10)),
        ],
    }
    if record not in table:
        raise ValueError(f"unknown record type: {record}")
    return table[record]()


def check_contract(df: DataFrame, record: str) -> DataFrame:
    """Adds ``violations``: names of the broken rules, empty for a valid record."""
    broken = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules(record)]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))
