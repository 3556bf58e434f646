"""Deterministic identifiers computed inside the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knownby.functions.numeric import col

# Namespaces that make identifiers equal across runs.
RESEARCH_NAMESPACE = "656fba2e-f396-4efd-a529-a2b63d810576"


def uuid5(namespace: str, name: Column | str) -> Column:
    """RFC 4122 name-based (SHA-1) identifier of a string column."""
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(col(name), "UTF-8"))
    digest = F.sha1(raw)
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1), F.lit(1)
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def research_id(kind: str, key: Column | str) -> Column:
    """Stable identifier of a research object from its kind and natural key."""
    if not kind.strip():
        raise ValueError("identifier kind must be non-empty")
    return uuid5(
        RESEARCH_NAMESPACE, F.concat(F.lit(kind.strip().lower() + ":"), F.trim(col(key)))
    )


def iso_instant(value: Column | str) -> Column:
    """ISO-8601 UTC text of an instant, with microseconds only where they are non-zero."""
    stamp = col(value).cast("timestamp")
    head = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    return F.concat(
        head, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    )
