"""Periodic runs of words by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends; ``RunCatcher`` finds those of at least ``exponent`` periods and
``least`` words. Words are appended in steps. For each power of two s the completed
blocks of s words at multiples of s are catchers: a square whose period is 2s - 1 to
4s - 2 words holds a whole block in its first half, and the block again one period
later. So a catcher watches the words from 2s - 1 to 4s - 2 places behind its start; when they
have been appended it compares itself with the s words at each of those places, by
differences of a polynomial prefix sum, which each appended word advances. Every word
meets two comparisons a level, s numpy calls of any length being one. Equal blocks at one
distance in a row are one stretch; a stretch that the next catcher does not continue
is closed, and dropped unless its blocks are as many as a run of ``exponent`` periods
must have. At the end of the text the stretches are compared word by word, extended at
both ends by less than a block, and squares of one run merge: multiples of its period
give the same stretch of words, of which the smallest period is kept.

A task appends a slice of documents to one catcher, with words between them that equal
no other, so short documents cost no calls of their own. Documents are mapped, never
shuffled. Memory follows the longest text: 24 bytes a word beside the text, and the
stretches not closed yet.

Rows: a null text has no words. Words are runs without white space, compared byte by
byte. Repeated rows get repeated results. An empty table gives no rows. Ties among the
longest runs go to the smallest start, then the smallest period; a text without a run
has nulls there. Columns of the input are kept; ``n_words``, ``runs`` and
``collapsed`` replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownby.llm.catalog import query
from knownby.llm.tables import BASES, flat, mix, ranges, slices, table, text_column, word_spans

EXPONENT = 4
LEAST = 6
STEP = 1 << 17
#: Elements of one comparison of many blocks with many places.
TILE = 1 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

NONE = np.zeros((0, 3), dtype=np.int64)


@dataclass
class Level:
    """Catchers of blocks of ``size`` words."""

    size: int
    next: int = 0  # the first block whose places have not all been compared
    open: np.ndarray = field(default_factory=lambda: NONE)  # period, first and last block of stretches that may go on
    closed: list[np.ndarray] = field(default_factory=list)


def stretches(period: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Join stretches of one period whose blocks follow each other."""
    order = np.lexsort((first, period))
    period, first, last = period[order], first[order], last[order]
    begins = np.ones(len(period), dtype=bool)
    begins[1:] = (period[1:] != period[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(begins)
    return np.stack([period[at], first[at], last[np.append(at[1:], len(period)) - 1]], axis=1) if len(at) else NONE


class RunCatcher:
    """Finds the runs of a growing sequence of word ids. longest: no run is longer (a text of the sequence, for instance)."""

    def __init__(self, exponent: int = EXPONENT, least: int = LEAST, longest: int | None = None):
        if exponent < 2:
            raise ValueError("squares are two periods at least")
        self.exponent, self.least, self.longest = exponent, least, longest
        self.words = np.zeros(1024, dtype=np.int64)
        self.sums = np.zeros(1025, dtype=np.uint64)
        self.powers = np.ones(1, dtype=np.uint64)
        self.n = 0
        self.levels: list[Level] = []

    def _reserve(self, n: int) -> None:
        if n > len(self.words):
            size = max(n, len(self.words) * 3 // 2)
            self.words = np.concatenate([self.words, np.zeros(size - len(self.words), dtype=np.int64)])
            self.sums = np.concatenate([self.sums, np.zeros(size + 1 - len(self.sums), dtype=np.uint64)])
        if n > len(self.powers):
            more = np.full(max(n, len(self.words)) - len(self.powers) + 1, BASES[0], dtype=np.uint64)
            more[0] = self.powers[-1]
            self.powers = np.concatenate([self.powers[:-1], np.multiply.accumulate(more)])

    def append(self, words: np.ndarray) -> None:
        """More words of the sequence: every catcher whose places they complete compares itself with them."""
        for a in range(0, len(words), STEP):
            part = words[a:a + STEP]
            n = self.n + len(part)
            self._reserve(n)
            self.words[self.n:n] = part
            self.sums[self.n + 1:n + 1] = self.sums[self.n] + np.cumsum(mix(part.astype(np.uint64) + np.uint64(1)) * self.powers[self.n:n])
            self.n = n
            self._advance(ended=False)

    def _advance(self, ended: bool) -> None:
        longest = self.n if self.longest is None else min(self.n, self.longest)
        while (2 * (1 << len(self.levels)) - 1) * self.exponent <= longest:
            self.levels.append(Level(1 << len(self.levels)))
        for level in self.levels:
            self._compare(level, ended)

    def _compare(self, level: Level, ended: bool) -> None:
        s = level.size
        # Block m is compared with the words at m s + 2s - 1 ... m s + 4s - 2; the last place ends at m s + 5s - 2.
        until = (self.n - 5 * s + 2) // s + 1
        if ended:
            until = max(until, (self.n - 3 * s + 1) // s + 1)  # with at least one place
        until = max(until, level.next)
        found = [level.open]
        step = max(1, TILE // (2 * s))
        for a in range(level.next, until, step):
            b = min(a + step, until)
            last = min((b - 1) * s + 5 * s - 2, self.n)  # words up to here
            hashes = self.sums[a * s + s:last + 1] - self.sums[a * s:last + 1 - s]  # of the s words from each place, times a power of the base
            blocks = hashes[0:(b - a - 1) * s + 1:s]
            short = max(0, (b - 1) * s + 4 * s - 1 - (a * s + len(hashes)))
            if short:  # places beyond the end: an own value that is compared like any other and taken out below
                hashes = np.concatenate([hashes, np.zeros(short, dtype=np.uint64)])
            places = np.lib.stride_tricks.sliding_window_view(hashes, 2 * s)[2 * s - 1::s][:b - a]
            block, at = np.nonzero(places == blocks[:, None] * self.powers[2 * s - 1:4 * s - 1])
            period = at + 2 * s - 1
            inside = (block + a) * s + period + s <= self.n
            block, period = block[inside] + a, period[inside]
            found.append(stretches(period, block, block))
        if until == level.next:
            return
        level.next = until
        period, first, last = np.concatenate(found).T
        joined = stretches(period, first, last)
        goes_on = joined[:, 2] == until - 1
        level.open = joined[goes_on]
        self._close(level, joined[~goes_on])

    def _close(self, level: Level, found: np.ndarray) -> None:
        # A run of e periods q repeats (e - 1) q words, which hold at least ((e - 1) q + 1) // s - 1 whole blocks.
        enough = np.maximum(((self.exponent - 1) * found[:, 0] + 1) // level.size - 1, 1)
        kept = found[found[:, 2] - found[:, 1] + 1 >= enough]
        if len(kept):
            level.closed.append(kept)

    def finish(self) -> np.ndarray:
        """start, length, period of every run, by start and then period."""
        self._advance(ended=True)
        runs = np.zeros((0, 3), dtype=np.int64)
        for level in self.levels:
            self._close(level, level.open)
            level.open = NONE
            found = np.concatenate([NONE, *level.closed])
            level.closed = []
            runs = np.concatenate([runs, self._exact(found[self._fresh(found, runs, level.size)], level.size)])
        order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
        runs = runs[order]
        merged = np.ones(len(runs), dtype=bool)  # of the periods of one stretch of words, the smallest comes first
        merged[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
        runs = runs[merged]
        whole = (runs[:, 1] >= self.least) & (runs[:, 1] >= self.exponent * runs[:, 2])
        runs = runs[whole]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]

    def _fresh(self, found: np.ndarray, runs: np.ndarray, size: int) -> np.ndarray:
        """Which stretches are not repeats of a shorter period in a run already known."""
        fresh = np.ones(len(found), dtype=bool)
        begin, end = found[:, 1] * size, (found[:, 2] + 1) * size + found[:, 0]
        known = runs[runs[:, 1] >= 3 * size - 1]
        known = known[np.argsort(known[:, 0], kind="stable")]
        if not len(known) or not len(found):
            return fresh
        ends = known[:, 0] + known[:, 1]
        reach = np.maximum.accumulate(ends)  # no run up to here ends later
        at = np.searchsorted(known[:, 0], begin, side="right") - 1
        asked = np.arange(len(found))
        while True:
            going = (at >= 0) & (reach[np.maximum(at, 0)] >= end[asked])
            asked, at = asked[going], at[going]
            if not len(asked):
                return fresh
            repeats = (ends[at] >= end[asked]) & (found[asked, 0] % known[at, 2] == 0)
            fresh[asked[repeats]] = False
            asked, at = asked[~repeats], at[~repeats] - 1

    def _exact(self, found: np.ndarray, size: int) -> np.ndarray:
        """Runs of the stretches, by comparing words."""
        words, out = self.words, []
        for q, first, last in found.tolist():
            a, b = first * size, (last + 1) * size
            if (words[a:b] != words[a + q:b + q]).any():
                out.extend(self._apart(a, b, q))
                continue
            low, high = max(a - size, 0), min(b + size, self.n - q)
            left = np.flatnonzero(words[low:a] != words[low + q:a + q])
            right = np.flatnonzero(words[b:high] != words[b + q:high + q])
            begin = low + int(left[-1]) + 1 if len(left) else low
            end = b + int(right[0]) if len(right) else high
            if len(left) == 0 and begin > 0 or len(right) == 0 and end < self.n - q:
                out.extend(self._apart(begin, end, q))  # the neighbouring block agrees too: its comparison was lost
            else:
                out.append((begin, end - begin + q, q))
        return np.array(out, dtype=np.int64).reshape(-1, 3)

    def _apart(self, a: int, b: int, q: int) -> list[tuple[int, int, int]]:
        """All maximal stretches of period q that touch these words, whatever the hashes said."""
        words, out = self.words, []
        while a > 0 and words[a - 1] == words[a - 1 + q]:
            a -= 1
        while b < self.n - q and words[b] == words[b + q]:
            b += 1
        same = np.concatenate([[False], words[a:b] == words[a + q:b + q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            out.append((a + begin, end - begin + q, q))
        return out


@dataclass
class Texts:
    """Words of a slice of texts and the runs in them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # the first word of each text, one more entry than texts
    runs: np.ndarray  # start among all words, length, period
    run_text: np.ndarray


def runs_of(column: pa.Array, exponent: int = EXPONENT, least: int = LEAST) -> Texts:
    """The runs of every text of a column."""
    data, offsets = flat(column)
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    counts = np.diff(first)
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    body = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[ranges(starts, lengths)])])
    ids = body.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # One word of its own before every text but the first.
    texts = len(counts)
    laid = np.full(len(ids) + max(texts - 1, 0), -1, dtype=np.int64)
    place = np.arange(len(ids)) + np.repeat(np.arange(texts), counts)
    between = np.ones(len(laid), dtype=bool)
    between[place] = False
    laid[place] = ids
    laid[between] = len(ids) + np.arange(int(between.sum()))
    catcher = RunCatcher(exponent, least, int(counts.max(initial=0)))
    catcher.append(laid)
    runs = catcher.finish()
    which = np.searchsorted(first + np.arange(texts + 1), runs[:, 0], side="right") - 1
    runs[:, 0] -= which
    return Texts(data, starts, ends, first, runs, which)


def collapsed(found: Texts, text: int) -> bytes:
    """The words of a text, each run cut after its first period, joined by blanks."""
    a, b = found.first[text], found.first[text + 1]
    drops = np.zeros(b - a + 1, dtype=np.int64)
    own = found.runs[found.run_text == text]
    np.add.at(drops, own[:, 0] + own[:, 2] - a, 1)
    np.add.at(drops, own[:, 0] + own[:, 1] - a, -1)
    keep = np.flatnonzero(np.cumsum(drops[:-1]) == 0) + a
    return joined(found.data, found.starts[keep], found.ends[keep])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return b""
    sizes = ends - starts + 1  # each with a blank behind it
    out = np.full(int(sizes.sum()), 0x20, dtype=np.uint8)
    at = np.cumsum(sizes) - sizes
    out[ranges(at, sizes - 1)] = data[ranges(starts, sizes - 1)]
    return out[:-1].tobytes()


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def with_runs(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period by start and period) and ``collapsed``, the text with each run cut to one period."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())]
    keep = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in added}]
    schema = T.StructType(keep + added)
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found = runs_of(text_column(batch, text), exponent, least)
                counts = np.bincount(found.run_text, minlength=batch.num_rows)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                local = found.runs[:, 0] - found.first[found.run_text]
                values = pa.StructArray.from_arrays([pa.array(local), pa.array(found.runs[:, 1]), pa.array(found.runs[:, 2])], fields=list(run_type.value_type))
                told = pa.ListArray.from_arrays(pa.array(offsets), values)
                cut = pa.array([collapsed(found, i) for i in range(batch.num_rows)], pa.binary()).cast(pa.string())
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(found.first)), told, cut], names=schema.names)

    return docs.mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of equal ones the first by start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's input: in a tenth of the documents, by their ids, the words from one on repeat a stretch."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.array(F.slice(words, a + 1, p)), lambda unit: F.array_join(F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, n - a), " "))[0]
        return F.when(n > 0, F.concat_ws(" ", F.array_join(F.slice(words, 1, a), " "), tail)).otherwise(text)

    # Bound to a variable: the words are found once a text.
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the collapsed text of every document."""
    docs = table(spark, sf_dir, "documents")
    found = with_runs(docs.select("doc_id", planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[n].cast("string") for n in ("start", "length", "period"))), F.lit("\n")))
    top = found.withColumn("top", longest_run(F.col("runs")))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
