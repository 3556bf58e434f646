"""Text quality by logistic regression over hashed word n-grams, learned by follow-the-regularised-leader.

Words are maximal runs of letters, digits and bytes beyond ASCII, and maximal runs of
signs; white space separates. Their n-grams of ``ORDERS`` words are hashed into
``BUCKETS`` counts per text; a count c weighs 1 + ln c, and a text's weights are scaled
to length 1. The score is the logistic of a sparse dot product with the weights.

Learning: FTRL-proximal keeps for every bucket the sum z of shifted gradients and the
sum n of squared gradients; a weight is 0 while |z| <= l1, and otherwise
-(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2). Every example updates the
buckets it has. The rows learned from are a bounded sample, the ``SAMPLE`` labelled
rows whose hashed ids are smallest, dealt by that hash into ``SHARDS`` shards. In each
of ``ROUNDS`` rounds the shards go on from the same state, each over its examples in
hash order, and their states are averaged bucket by bucket in Spark; at most
``BUCKETS`` rows reach the driver. The result does not depend on how the tables are
partitioned. Scoring is a map over all rows and whole texts; the weights (1 MB at most) go with it.

Rows: a null or empty text has no n-gram and gets the score of the constant alone. A
null doc_id is neither held out nor learned from; null labels and ids with labels that differ
are not learned, repeated labels count once, and of several texts of one id the smallest is learned.
Repeated rows get repeated results. Without any label to learn
every score is 0.5. Texts of any length are counted piece by piece in bounded memory;
a run without white space longer than ``SLICE_BYTES`` counts as several words. Columns of the
input are kept; ``score`` replaces a column so named.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownby.llm.catalog import query
from knownby.llm.tables import SLICE_BYTES, flat, mix, slices, span_hashes, table, text_column
from knownby.session import materialize

BUCKETS = 1 << 18
ORDERS = (1, 2)
SAMPLE = 20_000
SHARDS = 4
ROUNDS = 6
ACCEPT = 0.3

SPACE, WORD, SIGN = 0, 1, 2
CLASSES = np.full(256, SIGN, dtype=np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = WORD
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    alpha: float = 20.0
    beta: float = 0.1
    l1: float = 0.001
    l2: float = 0.0


@dataclass
class State:
    """z and n of every bucket; the last entry is the constant."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> State:
        return cls(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the first word of each row (one more entry than rows)."""
    kind = CLASSES[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    fresh[1:len(data)] |= kind[1:] != kind[:-1]
    fresh[0] = fresh[len(data)] = True
    edges = np.flatnonzero(fresh)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != SPACE
    starts, ends = starts[real], ends[real]
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each word, as if all words were of one text."""
    key = hashes
    for k in range(1, order):
        key = key[:-1] * _STEP + hashes[k:]
    return (mix(key + np.uint64(order)) % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the n-grams of each row, by row and bucket."""
    hashes, first = word_hashes(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys = []
    for order in ORDERS:
        if len(hashes) >= order:
            same = row[:len(row) - order + 1] == row[order - 1:]
            keys.append((row[:len(row) - order + 1] * BUCKETS + grams(hashes, order))[same])
    found, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return found // BUCKETS, found % BUCKETS, counts


def long_counts(data: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``gram_counts`` for one text, piece by piece: pieces end at white space where they have any."""
    dense = np.zeros(BUCKETS, dtype=np.int64)
    before = np.zeros(0, dtype=np.uint64)
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        if end < len(data):
            blanks = np.flatnonzero(CLASSES[data[at:end]] == SPACE)
            end = at + int(blanks[-1]) + 1 if len(blanks) else end
        fresh, _ = word_hashes(data[at:end], np.array([0, end - at]))
        hashes = np.concatenate([before, fresh])
        for order in ORDERS:
            begin = max(0, len(before) - order + 1)  # n-grams within the words before are counted
            if len(hashes) - begin >= order:
                dense += np.bincount(grams(hashes[begin:], order), minlength=BUCKETS)
        before = hashes[max(0, len(hashes) - max(ORDERS) + 1):]
        at = end
    found = np.flatnonzero(dense)
    return np.zeros(len(found), dtype=np.int64), found, dense[found]


def examples(column: pa.Array, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry of each text (one more than texts), and the buckets and values of all texts."""
    data, offsets = flat(column)
    rows, buckets, counts = long_counts(data, limit) if len(column) == 1 and len(data) > limit else gram_counts(data, offsets)
    values = 1 + np.log(counts)
    lengths = np.sqrt(np.bincount(rows, values * values, len(column)))
    return np.searchsorted(rows, np.arange(len(column) + 1)), buckets, values / lengths[rows]


def weights(z: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    """The weights that a state stands for."""
    return np.where(np.abs(z) <= settings.l1, 0.0, -(z - np.sign(z) * settings.l1) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learn(state: State, buckets: np.ndarray, values: np.ndarray, label: int, settings: Settings) -> None:
    """One example: its prediction, then its step in the buckets it has and in the constant."""
    at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
    z, n = state.z[at], state.n[at]
    w = weights(z, n, settings)
    g = (logistic(float(w @ x)) - label) * x
    squares = n + g * g
    state.z[at] = z + g - (np.sqrt(squares) - np.sqrt(n)) / settings.alpha * w
    state.n[at] = squares


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, label: str) -> DataFrame:
    """shard, key, doc_id, label, buckets, values of the sampled rows, each shard in one file and in order of key."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    told = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    told = told.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    # Only ids with a text can be learned; the sample is then the same however rows are laid out.
    present = docs.where(F.col("text").isNotNull()).select("doc_id").distinct()
    chosen = materialize(told.join(present, "doc_id", "left_semi").withColumn("key", key).orderBy("key", "doc_id").limit(sample))
    texts = docs.where(F.col("text").isNotNull()).join(chosen, "doc_id").groupBy("doc_id", "key", "label").agg(F.min("text").alias("text"))
    schema = "shard int, key long, doc_id string, label int, buckets array<int>, values array<double>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                first, buckets, values = examples(text_column(batch, "text"))
                offsets = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                    pa.ListArray.from_arrays(offsets, pa.array(buckets, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(values))],
                    names=["shard", "key", "doc_id", "label", "buckets", "values"])

    shard = F.pmod("key", F.lit(SHARDS)).cast("int").alias("shard")
    rows = texts.select(shard, "key", F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInArrow(run, schema)
    return materialize(materialize(rows).repartitionByRange(SHARDS, "shard").sortWithinPartitions("shard", "key", "doc_id"))


def one_round(rows: DataFrame, state: State, settings: Settings) -> State:
    """Every shard goes on from the state over its rows; the mean of the states that come out."""
    start = rows.sparkSession.sparkContext.broadcast((state.z, state.n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, None

        def result() -> Iterator[pa.RecordBatch]:
            if own is not None:
                touched = np.flatnonzero((own.z != 0) | (own.n != 0))
                yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array(own.z[touched]), pa.array(own.n[touched])], names=["bucket", "z", "n"])

        for batch in batches:
            buckets, values = batch.column(4), batch.column(5)
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != shard:
                    yield from result()
                    shard, own = batch.column(0)[i].as_py(), State(*(part.copy() for part in start.value))
                learn(own, buckets[i].values.to_numpy(), values[i].values.to_numpy(), batch.column(3)[i].as_py(), settings)
        yield from result()

    # In multiples of 2**-40 the sums are the same in any order.
    exact = lambda c: F.sum(F.round(F.col(c) * float(1 << 40)).cast("decimal(38,0)")).cast("double") / float(1 << 40)
    told = rows.mapInArrow(run, "bucket int, z double, n double").groupBy("bucket").agg(exact("z").alias("z"), exact("n").alias("n"), F.count("*").alias("shards"))
    found = told.toArrow()
    start.unpersist()
    out = State.empty()
    at = found.column("bucket").to_numpy()
    # Every example touches the constant, so every shard with examples is counted there.
    shards = max(found.column("shards").to_numpy(), default=1)
    out.z[at], out.n[at] = found.column("z").to_numpy() / shards, found.column("n").to_numpy() / shards
    return out


def fit(docs: DataFrame, labels: DataFrame, held_out: str | None = None, label: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS, settings: Settings = Settings()) -> np.ndarray:
    """Weights of the buckets and, last, the constant. docs: doc_id, text; labels: doc_id and a label of 0 or 1; held_out: condition of rows to leave out."""
    if held_out is not None:
        docs = docs.where(~F.expr(held_out))
    rows = training_rows(docs.select("doc_id", "text"), labels, sample, label)
    state = State.empty()
    for _ in range(rounds):
        state = one_round(rows, state, settings)
    return weights(state.z, state.n, settings)


def predict(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``score``, the probability of label 1 of each whole text."""
    keep = [f for f in docs.schema.fields if f.name.lower() != "score"]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])
    light = model.astype(np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score_column(text_column(batch, text), light))], names=schema.names)

    return docs.mapInArrow(run, schema)


def score_column(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """The score of each text."""
    first, buckets, values = examples(column)
    terms = np.concatenate([[0.0], model[buckets].astype(np.float64) * values])
    sums = np.add.reduceat(np.append(terms, 0.0), first + 1) if len(terms) > 1 else np.zeros(len(first))
    return logistic(np.where(np.diff(first) > 0, sums[:-1], 0.0) + float(model[BUCKETS]))


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


@query("op11_quality_ftrl")
def op11_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), f"coalesce({HELD_OUT}, true)")
    told = predict(docs.withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False))), model)
    return told.select("doc_id", "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
