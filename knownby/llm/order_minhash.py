"""Near duplicates by order MinHash, with candidates verified by banded alignment.

A text is its words (lower-cased runs of letters and digits) and its shingles of
``shingle`` consecutive words, each labelled with its occurrence number. For each of
``sketches`` hash functions the two smallest labelled shingles are sampled and kept
in text order, so a sketch agrees only where content and order do: it follows edit
similarity, not the bag of words. ``rows`` sketches make one of the ``bands`` keys;
at similarity 0.8 at least one key of a pair agrees with probability 0.995.

Similarity is that of the best alignment of the two shingle sequences: with M
shingles aligned in order, M / (n1 + n2 - M), a Jaccard index that heeds order.
M is found by bit-parallel alignment inside the band that the threshold leaves.

No bucket is expanded into pairs. (1) Texts with the same words are one node.
(2) In a bucket every node is verified against one leader, the node that shares
buckets with most others. (3) Components of these links are formed. (4) A pair of
one bucket that is still apart is verified, once, unless it cannot reach the
threshold: from what each has in common with their leader, and how many of its other
shingles occur in any other node under that leader, follows how much the two can
share. So no link between candidates is lost, and most copies of copies that have
drifted too far apart are ruled out without being compared.

Rows: texts without words are alike only if equal (null is empty). A row without a
doc_id is grouped by equal words only and belongs to the class of the smallest id
there, if any. The class is the smallest doc_id of the group; rows that repeat that
id are all kept. Texts shorter than a shingle are one shingle. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.llm.catalog import query
from knownby.llm.graph import connected_components
from knownby.llm.substring_dedup import only_members, runs, text_hash, with_changes
from knownby.llm.tables import BASES, flat, mix, ranges, slices, span_hashes, table, text_column, window_hashes, word_spans
from knownby.session import materialize, tasks_for

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 2, 10
TASK_DOCUMENTS, TASK_PAIRS = 25_000, 2_000  # of a task that stores rows of documents, or compares pairs
KEPT_SHINGLES = 1 << 18  # 4 MB, and one text more

#: After lower-casing: digits, a-z and everything beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[ord("0"):ord("9") + 1] = True
IS_WORD[ord("a"):ord("z") + 1] = True
IS_WORD[0x80:] = True


class Shingles:
    """Word hashes of a batch, its labelled shingles, the row of each, and a 128-bit name of each row's content."""

    def __init__(self, batch: pa.RecordBatch, size: int, text: str = "text"):
        column = text_column(batch, text)
        data, offsets = flat(pc.utf8_lower(column))
        starts, ends, self.first = word_spans(data, offsets, IS_WORD)
        self.words = span_hashes(data, starts, ends)
        self.counts = np.diff(self.first)
        self.names = [self._names(base, column) for base in BASES]
        h, row = shingle_hashes(self.words, self.first, size)
        key = mix(h ^ mix(row.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        begin = runs(key[order])
        occurrence = np.empty(len(h), dtype=np.int64)
        occurrence[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.r_[begin, len(h)]))
        self.labelled, self.row = mix(h + occurrence.astype(np.uint64) * np.uint64(BASES[0])), row

    def _names(self, base: int, column: pa.Array) -> np.ndarray:
        """A hash of each row's words and their order; of the raw text where there are none."""
        place = (np.arange(len(self.words)) - np.repeat(self.first[:-1], self.counts)).astype(np.uint64)
        sums = np.zeros(len(self.words) + 1, dtype=np.uint64)
        np.cumsum(mix(self.words ^ mix(place * np.uint64(base) + np.uint64(1))), out=sums[1:])
        names = mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.counts.astype(np.uint64))
        bare = np.flatnonzero(self.counts == 0)
        if len(bare):
            data, offsets = flat(column)
            names[bare] = ~span_hashes(data, offsets[:-1], offsets[1:], base)[bare]
        return names.view(np.int64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, in order, and their rows; a short row is one shingle."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    h = window_hashes(words, size)
    inside = np.flatnonzero(row[:len(h)] == row[size - 1:]) if len(h) else np.zeros(0, np.int64)
    h, row_of = h[inside], row[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.array([mix(words[first[r]:first[r + 1]] * np.uint64(2 * counts[r] + 1)).sum(dtype=np.uint64) for r in short], dtype=np.uint64)
        place = np.searchsorted(row_of, short)
        h, row_of = np.insert(h, place, own), np.insert(row_of, place, short)
    return h, row_of


def order_sketches(labelled: np.ndarray, row: np.ndarray, n: int, sketches: int) -> np.ndarray:
    """(rows, sketches): the two smallest labelled shingles of each hash function, in text order."""
    out = np.zeros((n, sketches), dtype=np.uint64)
    begin = runs(row)
    if not len(begin):
        return out
    rows, count = row[begin], np.diff(np.r_[begin, len(row)])
    random = np.random.default_rng(11)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(sketches):
        flip, factor = random.integers(1, 2**63, 2, dtype=np.uint64)
        value = (labelled ^ flip) * (factor | np.uint64(1))
        found = []
        for _ in range(2):
            least = np.minimum.reduceat(value, begin)
            at = np.flatnonzero(value == np.repeat(least, count))
            at = at[np.searchsorted(at, begin)]
            value[at] = full
            found.append((least, at))
        (a, p), (b, q) = found
        earlier = p <= q
        out[rows, i] = mix(np.where(earlier, a, b) * np.uint64(3) + np.where(earlier, b, a))
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One key for each run of ``rows`` sketches; keys of different bands differ."""
    n, m = sketch.shape
    out = np.zeros((n, m // rows), dtype=np.uint64)
    for band in range(m // rows):
        key = np.full(n, band + 1, dtype=np.uint64)
        for i in range(rows):
            key = mix(key * np.uint64(0x100000001B3) + sketch[:, band * rows + i])
        out[:, band] = key
    return out.view(np.int64)


def sketched(docs: DataFrame, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, th, name and check (128 bits of the content), n (shingles) and the band keys of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                s = Shingles(batch, shingle)
                n = np.bincount(s.row, minlength=batch.num_rows)
                keys = band_keys(order_sketches(s.labelled, s.row, batch.num_rows, rows * bands), rows)
                per_row = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32)), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.names[0]), pa.array(s.names[1]), pa.array(n.astype(np.int64)), lists, batch.column(2)], names=["doc_id", "name", "check", "n", "keys", "th"])

    return docs.select("doc_id", "text", "th").mapInArrow(run, "doc_id long, name long, check long, n long, keys array<long>, th long")


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence on alignments within ``band`` of the diagonal, a word of bits per row.

    Bit j of the row stands for b[low + j]; a zero bit is a place where the length grows. The window slides along the
    diagonal: places that leave it are counted, places that enter it have not grown yet.
    """
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    low, high = 0, min(len(b), band + 1)
    row, size, done = (1 << high) - 1, high, 0
    for i, x in enumerate(a):
        new_low, new_high = max(0, i - band), min(len(b), i + band + 1)
        if new_high > high:
            row |= ((1 << new_high - high) - 1) << high - low
            high = new_high
        if new_low > low:
            drop = min(new_low, high) - low
            done += drop - (row & (1 << drop) - 1).bit_count()
            row >>= drop
            low += drop
        size = high - low
        places = where.get(x)
        if not places or size <= 0:
            continue
        hits = 0
        for j in places[bisect.bisect_left(places, low):bisect.bisect_left(places, high)]:
            hits |= 1 << j - low
        if hits:
            both = row & hits
            row = (row + both | row - both) & (1 << size) - 1
    return done + max(0, size) - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Shingles aligned in order, or fewer than needed if ``least`` similarity is out of reach."""
    common_a, common_b = a[np.isin(a, b)], b[np.isin(b, a)]
    if len(common_a) == len(common_b) and np.array_equal(common_a, common_b):
        return len(common_a)
    needed = int(np.ceil(least * (len(a) + len(b)) / (1 + least) - 1e-9))
    if min(len(common_a), len(common_b)) < needed:
        return 0
    n = min(len(common_a), len(common_b))
    unequal = np.flatnonzero(common_a[:n] != common_b[:n])
    head = int(unequal[0]) if len(unequal) else n
    x, y = common_a[head:], common_b[head:]
    n = min(len(x), len(y))
    unequal = np.flatnonzero(x[len(x) - n:][::-1] != y[len(y) - n:][::-1])
    tail = int(unequal[0]) if len(unequal) else n
    x, y = x[:len(x) - tail], y[:len(y) - tail]
    band = len(common_a) + len(common_b) - 2 * needed
    return head + tail + banded_lcs(x.tolist(), y.tolist(), band)


def numbered(h: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers, so that multisets become sets."""
    order = np.argsort(h, kind="stable")
    begin = runs(h[order])
    if len(begin) == len(h):
        return h
    occurrence = np.empty(len(h), dtype=np.int64)
    occurrence[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.r_[begin, len(h)]))
    return np.where(occurrence > 0, mix(h + occurrence.astype(np.uint64) * np.uint64(BASES[0])), h)


def sequences(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, words: the word hashes of one document of each node. nodes: node, doc_id."""
    wanted = nodes.select("doc_id", F.col("node").alias("_node")).where(F.col("doc_id").isNotNull())
    near = only_members(docs.select("doc_id", "text"), wanted, ["doc_id"]).join(wanted, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                s = Shingles(batch, shingle)
                node = batch.column(batch.schema.get_field_index("_node")).to_numpy(zero_copy_only=False)
                own = np.flatnonzero(s.names[0] == node)  # another text under the same id is not meant
                short = (s.words >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array([short[s.first[r]:s.first[r + 1]].tobytes() for r in own], pa.binary())], names=["node", "words"])

    return near.mapInArrow(run, "node long, words binary").dropDuplicates(["node"])


class Numbered:
    """Shingles of the nodes met last, in text order and numbered in order of value: pairs that follow share their nodes."""

    def __init__(self, shingle: int):
        self.shingle, self.found, self.size = shingle, {}, 0

    def __call__(self, node: int, words: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        if (found := self.found.get(node)) is None:
            h = mix(np.frombuffer(words.as_buffer(), np.uint32).astype(np.uint64))
            h = shingle_hashes(h, np.array([0, len(h)]), self.shingle)[0]
            if self.size > KEPT_SHINGLES:
                self.found, self.size = {}, 0
            found = self.found[node] = h, np.sort(numbered(h))
            self.size += len(h)
        return found


def compared(pairs: DataFrame, words: DataFrame, shingle: int, least: float, apart: bool = False) -> DataFrame:
    """a, b, shared (shingles in common), linked; with ``apart`` also the numbered shingles of a that b lacks. pairs: as stored."""
    both = (pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
            .join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Numbered(shingle)
        for batch in batches:
            common, linked, rest = [], [], []
            for a, b, wa, wb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                (x, own), (y, other) = shingles(a, wa), shingles(b, wb)
                n, m = len(x), len(y)
                alone = other[np.minimum(np.searchsorted(other, own), m - 1)] != own
                together = n - int(np.count_nonzero(alone))
                possible = together >= least * (n + m - together)
                found = aligned(x, y, least) if possible else 0
                common.append(together)
                linked.append(bool(found) and found >= least * (n + m - found))
                rest.append(own[alone].view(np.int64) if apart else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_()), pa.array(rest, pa.list_(pa.int64()))], names=["a", "b", "shared", "linked", "rest"])

    # A worker is dear beside a few pairs: its tasks follow the number of pairs, not that of the join's partitions.
    tasks = tasks_for(pairs.sparkSession, pairs.count(), TASK_PAIRS)
    return both.coalesce(tasks).mapInArrow(run, "a long, b long, shared long, linked boolean, rest array<long>")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, th (hash of the text), class_id, kept: one row per document. kept: the document stands for its class."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_hash(text).alias("th"))
    sketches = materialize(sketched(source, shingle, rows, bands))
    tasks = tasks_for(docs.sparkSession, sketches.count(), TASK_DOCUMENTS)

    def stored(df: DataFrame) -> DataFrame:
        return materialize(df, tasks)

    content = stored(sketches.groupBy("name", "check").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    # Members of buckets with company, and the leader of each bucket.
    dealt = content.where(F.col("doc_id").isNotNull()).select(F.col("name").alias("node"), "n", "doc_id", F.explode("keys").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(dealt.join(sizes, "key"))
    popularity = stored(members.groupBy("node").agg(F.sum("size").alias("score"), F.first("doc_id").alias("doc_id")))
    leaders = stored(members.select("key", "node").join(popularity, "node").groupBy("key").agg(F.max_by("node", F.struct("score", -F.col("doc_id"))).alias("leader")))
    led = stored(members.select("key", "node", "n").join(leaders, "key"))
    words = stored(sequences(source, popularity.select("node", "doc_id"), shingle))
    stars = stored(led.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    first = materialize(compared(stars, words, shingle, least, apart=True))
    links = first.where("linked").select("a", "b")
    parts = connected_components(links)

    # What two nodes of a bucket can share at most: what each shares with their leader, and those of its other
    # shingles that are found in a second node under the same leader.
    rest = first.select("a", "b", F.explode("rest").alias("s"))
    common = rest.groupBy("b", "s").agg(F.count("*").alias("c")).where("c > 1").select("b", "s")
    extra = rest.join(common, ["b", "s"]).groupBy("a", "b").agg(F.count("*").alias("extra"))
    reach = first.join(extra, ["a", "b"], "left").select(F.col("a").alias("node"), F.col("b").alias("leader"), (F.col("shared") + F.coalesce("extra", F.lit(0))).alias("most"))
    placed = (led.join(reach, ["node", "leader"], "left").join(parts, "node", "left")
              .select("key", "node", "n", F.least("n", F.coalesce("most", "n")).alias("most"), F.coalesce("component", "node").alias("component"), (F.col("node") == F.col("leader")).alias("leads")))
    placed = stored(placed.where("not leads"))
    split = placed.groupBy("key").agg((F.min("component") != F.max("component")).alias("split")).where("split").select("key")
    open_rows = placed.join(split, "key", "left_semi")
    # M >= least / (1 + least) * (n1 + n2) bounds the partner's length by what a node can share. A pair that meets in
    # several buckets is taken in the first.
    longest = (F.col("most") * ((1 + least) / least) - F.col("n")).alias("longest")
    able = open_rows.select("key", "node", "n", "component", longest).where(F.col("longest") >= least * F.col("n"))
    able = stored(able.join(content.select(F.col("name").alias("node"), "keys"), "node"))
    x, y = (able.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "component", "longest", "keys"))) for side in "xy")
    near = "x_node < y_node and x_component != y_component and y_n <= x_longest and x_n <= y_longest and array_intersect(x_keys, y_keys)[0] = key"
    again = stored(x.join(y, "key").where(near).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct())
    second = materialize(compared(again, words, shingle, least).where("linked").select("a", "b"))
    parts = connected_components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).union(second))

    grouped = stored(content.select("name", "check", "doc_id").join(parts.withColumnRenamed("node", "name"), "name", "left")
                     .select("name", "check", "doc_id", F.coalesce("component", "name").alias("component"), F.when(F.col("component").isNull(), F.col("check")).otherwise(0).alias("side")))
    classes = grouped.groupBy("component", "side").agg(F.min("doc_id").alias("class_id"))
    of_content = grouped.join(classes, ["component", "side"]).select("name", "check", "class_id")
    joined = sketches.select("doc_id", "th", "name", "check").join(of_content, ["name", "check"])
    return joined.select("doc_id", "th", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns."""
    found = near_duplicates(docs, doc_id, text)
    dropped = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    return with_changes(docs, dropped, doc_id, text, "left_anti")


@query("op10_order_minhash")
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
