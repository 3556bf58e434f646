"""Canonical identifiers, schemes, request fingerprints and content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownby.functions.ids import iso_instant, uuid5
from knownby.functions.numeric import col

# Identifier scheme aliases, and the namespace of batch identifiers.
SCHEME_ALIASES = {
    "bbgid": "figi",
    "bloomberg_global_id": "figi",
    "reuters_instrument_code": "ric",
    "yahoo": "yahoo_symbol",
}
BATCH_NAMESPACE = "54192fef-f838-4d89-bbaa-785e8b700499"


def canonical_identifier(value: Column | str) -> Column:
    """Trimmed, single-spaced, upper case; empty becomes null."""
    text = F.upper(F.trim(F.regexp_replace(col(value), r"\s+", " ")))
    return F.when(text != "", text)


def canonical_scheme(value: Column | str) -> Column:
    text = F.regexp_replace(F.lower(F.trim(col(value))), "[- ]", "_")
    known = F.create_map(*[F.lit(x) for pair in SCHEME_ALIASES.items() for x in pair])
    return F.when(text != "", F.coalesce(F.try_element_at(known, text), text))


def request_fingerprints(requests: DataFrame, *, by: str = "provider") -> DataFrame:
    """Fingerprint, batch id and batch key of each provider's request.

    The fingerprint is the SHA-256 of canonical JSON (sorted keys, no blanks, sorted items). A digest takes its
    text in order, so one task reads one request, but as a sorted stream: items pass through the digest
    batch by batch and are never gathered, however many a request has. Items with a null part are left
    out; a request without a date or a frequency has no fingerprint.
    """
    item = F.concat(
        F.lit('["'), F.col("security_id").cast("string"), F.lit('","'), F.col("provider_identifier"), F.lit('"]')
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    keys = [by, "start_date", "end_date", "frequency"]
    rows = requests.select(
        *keys, item.alias("__item"),
        F.concat(F.lit('{"end_date":"'), day("end_date"), F.lit('","frequency":"'), F.col("frequency"), F.lit('","items":[')).alias("__head"),
        F.concat(F.lit('],"start_date":"'), day("start_date"), F.lit('"}')).alias("__foot"),
    )
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "__item")
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("request_fingerprint", T.StringType())])
    hashed = ordered.mapInArrow(_digests(len(keys), schema.names), schema)
    return hashed.withColumn(
        "batch_id", uuid5(BATCH_NAMESPACE, F.concat_ws(":", F.col(by), F.col("request_fingerprint")))
    ).withColumn(
        "batch_key", F.concat(F.col(by), F.lit(":daily:"), F.substring("request_fingerprint", 1, 24))
    )


def _digests(width: int, names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by request and item to one row for each request: its keys and the digest of head, items and foot."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request, keys, digest, foot, first = None, None, None, None, True

        def result() -> Iterator[pa.RecordBatch]:
            if keys is not None:
                if digest is not None:
                    digest.update(foot.encode())
                text = pa.array([None if digest is None else digest.hexdigest()], pa.string())
                yield pa.RecordBatch.from_arrays([*keys, text], names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row, (*own, item, head, tail) in enumerate(zip(*columns)):
                if keys is None or own != request:
                    yield from result()
                    request, keys, foot, first = own, [batch.column(i).slice(row, 1) for i in range(width)], tail, True
                    digest = hashlib.sha256(head.encode()) if head is not None and tail is not None else None
                if item is not None and digest is not None:
                    digest.update(("" if first else ",").encode() + item.encode())
                    first = False
        yield from result()

    return run


def batch_content_hash(bars: DataFrame, *, batch: str = "ingestion_batch_id") -> DataFrame:
    """Order-independent content hash per batch without gathering the batch.

    Each bar's canonical text is hashed; four 60-bit slices of those hashes are
    summed (with the row count) and hashed again, so any change of any bar
    changes the result and partial aggregation does the work.
    """
    text = F.concat_ws(
        "|", "source_record_id", iso_instant("available_at"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("open", "high", "low", "close", "adjusted_close", "volume")],
    )
    digest = bars.withColumn("__h", F.sha2(text, 256))
    slices = [
        F.sum(F.conv(F.substring("__h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"__s{i}")
        for i in range(4)
    ]
    summed = digest.groupBy(batch).agg(F.count(F.lit(1)).alias("row_count"), *slices)
    return summed.select(
        batch, "row_count",
        F.sha2(F.concat_ws("|", F.col("row_count").cast("string"), *[F.col(f"__s{i}") for i in range(4)]), 256).alias("content_hash"),
    )
