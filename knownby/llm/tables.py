"""Small helpers shared by the operators: reading tables, Arrow batch sizes, word arrays.

Texts are handled as the flat byte buffers that Arrow hands over, so one numpy
call works on every word of a batch; ``slices`` keeps those buffers small however
long single texts are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "1000"
BATCH_BYTES = "8m"
SLICE_BYTES = (1 << 20) - 64  # prefix sums and powers over a slice stay in a few tens of MB
WIDE_BYTES = 4 << 20  # where distinct tokens are looked up once per slice


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that reach Python by rows and by bytes; let workers import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as large_string, nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in one column (one row at least)."""
    _, offsets = flat(text_column(batch, name))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column and the row offsets into them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, and the first word of each row (one more entry than rows)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a row ends the word before it
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for value in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, value, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        have = _POWERS[base] = tuple(tables)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial."""
    up, down = powers(base, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive words of a flat array."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:len(words) - size + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... for each start and length."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
