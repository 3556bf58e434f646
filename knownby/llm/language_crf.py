"""Language identification by a linear-chain conditional random field over words.

Every word is labelled with a language. A word's features are its character
n-grams with word edges (so prefixes and suffixes are among them) and the word
itself as a lexicon entry, all hashed into one weight table; transitions between
the labels of neighbouring words are learned with them. Forward-backward gives the
posterior of each label of each word, so text that switches languages is labelled
piece by piece. A document's language is that with the largest mean posterior.

Learning: a bounded sample, the ``PER_LANGUAGE`` documents of each language whose
hashed id is smallest, from which ``SEQUENCES`` training sequences are spliced out
of stretches of random documents, so that transitions between languages are seen.
Prediction is a map over all rows and whole texts. A chain is up to ``CHAIN``
consecutive words of one document; the chains of a batch advance together.

Rows: a text that is null or has no letter gets ``und`` and score 0. Ties go to the
language first in order. A null doc_id is neither held out nor learned from; a null
language is not learned. Repeated rows get repeated results. Without any labelled
text every document is ``und`` with score 0. The output columns ``held_out``,
``lang_pred``, ``score`` and ``word_langs`` replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownby.llm.catalog import query
from knownby.llm.tables import WIDE_BYTES, flat, mix, ranges, slices, table, text_column, word_spans

PER_LANGUAGE = 200
SEQUENCES = 6000
CHAIN = 64
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"

#: After lower-casing, letters are a-z and everything beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[ord("a"):ord("z") + 1] = True
IS_WORD[0x80:] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1, languages); the last row stands for no feature
    transitions: np.ndarray  # (languages, languages), log potentials


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the word at each place, and the first place of each row (one more entry)."""
    data, offsets = flat(pc.utf8_lower(column))
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    body = data[ranges(starts, lengths)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), first


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of all features of the words, and where each word's features begin."""
    texts = [w.decode("utf-8", "replace") for w in words]
    points = np.frombuffer("".join(f"^{w}$" for w in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # characters left in the word
    columns = np.full((len(points), len(ORDERS) + 1), BUCKETS, dtype=np.int64)
    key = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(points), dtype=np.uint64)
        shifted[:len(points) - n + 1] = points[n - 1:]
        key = key * np.uint64(0x100000001B3) + shifted
        if n in ORDERS:
            rows = (mix(key + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(BUCKETS)).astype(np.int64)
            columns[:, ORDERS.index(n)] = np.where(left >= n, rows, BUCKETS)
    # The lexicon entry stands at the first character of the word.
    whole = np.zeros(len(points) + 1, dtype=np.uint64)
    place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    np.cumsum(mix(points + np.uint64(0x51ED27) * place.astype(np.uint64)), out=whole[1:])
    columns[ends - lengths, -1] = (mix(whole[ends] - whole[ends - lengths]) % np.uint64(BUCKETS)).astype(np.int64)
    return columns.reshape(-1), (ends - lengths) * columns.shape[1]


def scores(words: list[bytes], weights: np.ndarray, group: int = 20_000) -> np.ndarray:
    """Emission score of each label for each word."""
    out = np.zeros((len(words), weights.shape[1]), dtype=np.float32)
    for a in range(0, len(words), group):
        rows, begins = features(words[a:a + group])
        out[a:a + group] = np.add.reduceat(weights[rows], begins, axis=0)
    return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of chains laid out as (place, chain, label); chains are sorted by falling length.

    pairs: the posteriors of neighbouring labels, summed over all places, are added to it.
    """
    steps, n, k = emissions.shape
    local = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    move = np.exp(transitions).astype(local.dtype)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than each place
    alpha = np.zeros_like(local)
    alpha[0] = local[0] / local[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        m = active[t]
        a = alpha[t - 1, :m] @ move * local[t, :m]
        alpha[t, :m] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((n, k), dtype=local.dtype)
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        ahead = beta[:m] * local[t + 1, :m]
        if pairs is not None:
            joint = alpha[t, :m, :, None] * move * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ move.T
        beta[:m] = b / b.sum(axis=1, keepdims=True)
        alpha[t, :m] *= beta[:m]
    return alpha / np.maximum(alpha.sum(axis=2, keepdims=True), 1e-30)


def posteriors(which: np.ndarray, first: np.ndarray, emission: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of each label of each word, over chains that tile the words of each row."""
    counts = np.diff(first)
    chains = -(-counts // CHAIN)
    starts = ranges(np.zeros(len(chains), dtype=np.int64), chains) * CHAIN + np.repeat(first[:-1], chains)
    lengths = np.minimum(CHAIN, np.repeat(first[1:], chains) - starts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    out = np.zeros((len(which), emission.shape[1]), dtype=np.float32)
    for a in range(0, len(starts), 4096):
        s, n = starts[a:a + 4096], lengths[a:a + 4096]
        places = s[None, :] + np.arange(n[0])[:, None]
        inside = np.arange(n[0])[:, None] < n[None, :]
        laid = emission[which[np.minimum(places, len(which) - 1)]]
        laid[~inside] = 0
        out[places[inside]] = forward_backward(laid, n, transitions)[inside]
    return out


def train(texts: list[str], labels: list[str], sequences: int = SEQUENCES, length: int = 32, epochs: int = 3, rate: float = 0.15, seed: int = 7) -> Model:
    """Fit by adaptive gradient steps on batches of spliced sequences."""
    languages = sorted(set(labels))
    k, random = len(languages), np.random.default_rng(seed)
    distinct, which, first = words_of(pa.array(texts, pa.large_string()))
    label = np.array([languages.index(x) for x in labels], dtype=np.int64)
    by_language = [rows for i in range(k) if len(rows := np.flatnonzero((label == i) & (np.diff(first) > 0)))]
    model = Model(languages, np.zeros((BUCKETS + 1, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32))
    if not by_language:
        return Model([], model.weights, model.transitions)
    places = np.zeros((sequences, length), dtype=np.int64)
    truth = np.zeros((sequences, length), dtype=np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            rows = by_language[random.integers(len(by_language))]
            row = rows[random.integers(len(rows))]
            take = int(min(length - at, random.integers(4, 24), first[row + 1] - first[row]))
            start = first[row] + random.integers(first[row + 1] - first[row] - take + 1)
            places[s, at:at + take] = start + np.arange(take)
            truth[s, at:at + take] = label[row]
            at += take
    used, places = np.unique(which[places], return_inverse=True)
    places = places.reshape(sequences, length)
    rows, begins = features(distinct.take(pa.array(used)).to_pylist())
    ends = np.append(begins[1:], len(rows))
    squares, move_squares = np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2)
    size = 100
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(sequences), max(1, sequences // size)):
            words, local = np.unique(places[batch], return_inverse=True)
            local = local.reshape(len(batch), length).T
            lengths = ends[words] - begins[words]
            own = rows[ranges(begins[words], lengths)]
            emission = np.add.reduceat(model.weights[own], np.cumsum(lengths) - lengths, axis=0)
            gold = truth[batch].T
            laid = emission[local]
            pairs = np.zeros((k, k), dtype=np.float32)
            marginal = forward_backward(laid, np.full(len(batch), length), model.transitions, pairs)
            error = marginal.copy()
            error[np.arange(length)[:, None], np.arange(len(batch))[None, :], gold] -= 1
            per_word = np.zeros((len(words), k), dtype=np.float32)
            np.add.at(per_word, local.reshape(-1), error.reshape(-1, k))
            spread = np.repeat(per_word, lengths, axis=0)
            touched, index = np.unique(own, return_inverse=True)
            grad = np.stack([np.bincount(index, spread[:, j], len(touched)) for j in range(k)], axis=1).astype(np.float32) / len(batch)
            squares[touched] += grad * grad
            model.weights[touched] -= rate * grad / np.sqrt(squares[touched])
            seen = np.zeros((k, k), dtype=np.float32)
            np.add.at(seen, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), 1)
            grad = (pairs - seen) / len(batch)
            move_squares += grad * grad
            model.transitions -= rate * grad / np.sqrt(move_squares)
            model.weights[BUCKETS] = 0
    return model


def fit(docs: DataFrame, held_out: str | None = None, per_language: int = PER_LANGUAGE, sequences: int = SEQUENCES) -> Model:
    """Train on a bounded sample of labelled documents (columns doc_id, text, lang). held_out: condition of rows to leave out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        usable = usable.where(~F.expr(held_out))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    ids = [row.doc_id for row in chosen.select("doc_id").distinct().collect()]  # at most per_language for each language
    rows = usable.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("doc_id", "text", "lang").collect() if ids else []
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.text))
    return train([r.text for r in rows], [r.lang for r in rows], sequences)


def predict(docs: DataFrame, model: Model, text: str = "text", words: bool = False, prefix: str = "") -> DataFrame:
    """Add ``lang_pred`` and ``score`` of each whole text, and with ``words`` also ``word_langs``, a label for each word."""
    added = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]
    added += [T.StructField(f"{prefix}word_langs", T.ArrayType(T.StringType()))] if words else []
    keep = [f for f in docs.schema.fields if f.name.lower() not in {a.name.lower() for a in added}]
    schema = T.StructType(keep + added)
    names = np.array(model.languages + [UNDETERMINED], dtype=object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, WIDE_BYTES):
                column = text_column(batch, text)
                best, score, labels = predict_column(column, model)
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                columns += [pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())]
                if words:
                    columns.append(pa.array([names[x].tolist() for x in labels], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def predict_column(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best language (the number of languages for none), score and word labels of each text."""
    n, k = len(column), len(model.languages)
    distinct, which, first = words_of(column)
    if k == 0 or len(which) == 0:
        return np.full(n, k), np.zeros(n), [np.full(b - a, k) for a, b in zip(first[:-1], first[1:])]
    posterior = posteriors(which, first, scores(distinct.to_pylist(), model.weights), model.transitions)
    counts = np.diff(first)
    row = np.repeat(np.arange(n), counts)
    mean = np.stack([np.bincount(row, posterior[:, j], n) for j in range(k)], axis=1) / np.maximum(counts, 1)[:, None]
    best, score = mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0)
    for i in range(n):
        if counts[i] == 0 or not any(c.isalpha() for c in column[i].as_py()):
            best[i], score[i] = k, 0.0
    return best, score, np.split(posterior.argmax(axis=1), first[1:-1])


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


@query("op3_language_crf")
def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"), HELD_OUT)
    labelled = docs.select("doc_id", "text", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"))
    return predict(labelled, model).select("doc_id", "held_out", "lang_pred", "score")
