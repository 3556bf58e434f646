"""Removal of passages that repeat across documents, by fixed-block anchors.

A window is ``window`` consecutive words of one document; one whose words also
start in a document with a smaller id is a repeat, and its words go. A window holds
at least one whole block of ``window // 2`` words at a multiple of that length, in
whichever document it lies. So (1) the blocks of all documents are the index and
every rolling run of that many words probes it; (2) each hit is extended: the
windows around it are the candidates, and a candidate whose whole word sequence is
found at a smaller id is a repeat; neighbouring repeats join into maximal ones. By
symmetry both sides of a repeat are hit, so nothing is missed; a hash collision in
(1) only adds candidates. Step (2) compares 64-bit hashes of whole windows.

Work moves as packed arrays: a task sends, per group of hashes, the hashes of its
batch and their places, and gets places back. Within a batch, repeats are settled
on the spot and one entry for each hash is sent, so a passage in a third of all
documents costs one entry for each batch, not one for each document. Texts are
shuffled only for documents with a hit, behind a fixed-size bitmap of their keys.

Rows: null and empty texts have no words. A row is known by doc_id and a hash of
its text; repeated rows have the same id, so they do not remove each other, and
get the same result. A null doc_id is neither smaller nor larger than any id: such
a document loses nothing and removes nothing. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.llm.catalog import query
from knownby.llm.tables import BASES, flat, mix, ranges, slices, span_hashes, table, text_column, window_hashes, word_spans
from knownby.session import materialize

WINDOW = 50
WORDS_PER_GROUP = 1 << 19
FILTER_BITS = 26

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

PACKED = "grp int, batch long, hashes binary, docs binary, gaps binary, wide binary, places binary, ids binary, ths binary, firsts binary"
PACKED_NAMES = [part.split()[0] for part in PACKED.split(", ")]
PACKED_TYPES = [pa.int32(), pa.int64()] + [pa.binary()] * 8
REPLY = "batch long, places binary, ids binary, ths binary, firsts binary"
REPLY_NAMES = [part.split()[0] for part in REPLY.split(", ")]
REPLY_TYPES = [pa.int64()] + [pa.binary()] * 4


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Words:
    """The words of a batch: hashes, row of each word, first word of each row."""

    def __init__(self, batch: pa.RecordBatch, text: str = "text"):
        self.data, self.offsets = flat(text_column(batch, text))
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets, IS_WORD)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(self.first))

    def windows(self, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, and which of them lie in one row."""
        h = window_hashes(self.hashes, size, base)
        return h, self.row[:len(h)] == self.row[size - 1:] if len(h) else np.zeros(0, bool)

    def same_in_row(self, h: np.ndarray, valid: np.ndarray, places: np.ndarray) -> np.ndarray:
        """All places whose run is equal to that at a given place of the same row."""
        key = mix(h ^ mix(self.row[:len(h)].astype(np.uint64)))
        return np.flatnonzero(np.isin(key, key[places]) & valid)


def batch_key(ids: np.ndarray, ths: np.ndarray) -> int:
    """A name of the batch that depends on its rows alone, so that a repeated task gives the same."""
    order = np.arange(1, len(ids) + 1, dtype=np.uint64)
    return int(mix(mix(ids.view(np.uint64)) ^ ths.view(np.uint64) * np.uint64(3) + order).sum(dtype=np.uint64).view(np.int64))


def table_row(batch: int, places: np.ndarray, ids: np.ndarray, ths: np.ndarray, first: np.ndarray) -> tuple:
    """What is settled in the batch already, and the key to its places; no group has to see it."""
    return (-1 - batch % 64, batch, None, None, None, None, places.astype(np.uint32).tobytes(), ids.tobytes(), ths.tobytes(), first.astype(np.uint32).tobytes())


def packed_rows(batch: int, groups: int, h: np.ndarray, places: np.ndarray, hashes: np.ndarray, docs: np.ndarray | None) -> Iterator[tuple]:
    """Entries dealt by the top bits of ``h``; within a group by place, as gaps of mostly one byte."""
    group = (h >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64) if groups > 1 else np.zeros(len(h), np.int64)
    order = np.argsort(group << 32 | places, kind="stable")
    group, places, hashes = group[order], places[order], hashes[order]
    docs = None if docs is None else docs[order]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for a, b in zip(begins, np.r_[begins[1:], len(group)] if len(group) else []):
        gaps = np.diff(places[a:b], prepend=0)
        low = np.minimum(gaps, 255).astype(np.uint8)
        yield (int(group[a]), batch, hashes[a:b].tobytes(), None if docs is None else docs[a:b].tobytes(), low.tobytes(), gaps[gaps >= 255].astype(np.uint32).tobytes(), None, None, None, None)


def unpacked(rows: dict[str, list], i: int) -> np.ndarray:
    gaps = np.frombuffer(rows["gaps"][i], np.uint8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(rows["wide"][i], np.uint32)
    return np.cumsum(gaps)


def record_batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def runs(sorted_hashes: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]]) if len(sorted_hashes) else np.zeros(0, np.int64)


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), dtype=np.int64) for c in ("doc_id", "th"))


def anchors(groups: int, block: int):
    """Blocks and probes of each batch; one entry for each row and hash, flagged if a block starts there."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, (ids, ths) = Words(batch), columns_of(batch)
                h, valid = words.windows(block, BASES[1])
                places = np.flatnonzero(valid)
                h = h[places]
                order = np.argsort(h, kind="stable")  # places, and with them rows, rise within a hash
                h, places = h[order], places[order]
                row = words.row[places]
                is_block = (places - words.first[row]) % block == 0
                fresh = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                entry = np.flatnonzero(fresh)
                flagged = np.logical_or.reduceat(is_block, entry) if len(entry) else np.zeros(0, bool)
                h, places = h[entry], places[entry]
                begin = runs(h)
                count = np.diff(np.r_[begin, len(h)])
                with_block = np.logical_or.reduceat(flagged, begin) if len(begin) else np.zeros(0, bool)
                settled = np.repeat(with_block & (count > 1), count)
                # Of a hash that is settled here, one block goes out for the other batches.
                rank = np.cumsum(flagged) - flagged
                speaker = flagged & (rank == np.repeat(rank[begin], count)) if len(h) else flagged
                send = ~settled | speaker
                key = batch_key(ids, ths)
                out = [table_row(key, places[settled], ids, ths, words.first)]
                short = (h & np.uint64(0xFFFFFFFE)).astype(np.uint32) | flagged.astype(np.uint32)
                out.extend(packed_rows(key, groups, h[send], places[send], short[send], None))
                yield record_batch(out, PACKED_TYPES, PACKED_NAMES)

    return run


def candidates(groups: int, window: int, block: int):
    """Windows around the hits of each batch; one entry for each hash, that of its smallest id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, (ids, ths) = Words(batch), columns_of(batch)
                hits = batch.column(batch.schema.get_field_index("places")).to_pylist()
                given = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + words.first[i] for i, x in enumerate(hits)])
                h, valid = words.windows(block, BASES[1])
                places = words.same_in_row(h, valid, given)
                row = words.row[places]
                first = np.maximum(places + block - window, words.first[row])
                last = np.minimum(places, words.first[row + 1] - window)
                ok = first <= last
                edge = np.zeros(len(words.row) + 2, dtype=np.int64)
                np.add.at(edge, first[ok], 1)
                np.add.at(edge, last[ok] + 1, -1)
                places = np.flatnonzero(np.cumsum(edge) > 0)
                h, _ = words.windows(window, BASES[0])
                h = h[places]
                doc = ids[words.row[places]]
                order = np.lexsort((places, doc, h))
                h, places, doc = h[order], places[order], doc[order]
                begin = runs(h)
                count = np.diff(np.r_[begin, len(h)])
                smallest = np.repeat(doc[begin], count) if len(h) else doc
                key = batch_key(ids, ths)
                out = [table_row(key, places[doc > smallest], ids, ths, words.first)]
                # Rows that share the smallest id stay entries of their own; a row needs one place for a hash.
                row = words.row[places]
                new_row = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                send = (doc == smallest) & new_row
                out.extend(packed_rows(key, groups, h[send], places[send], h[send], doc[send]))
                yield record_batch(out, PACKED_TYPES, PACKED_NAMES)

    return run


def answers(judge):
    """Gather the entries of one group, judge them by hash, and send the places back to their batches."""
    def run(group: pa.Table) -> pa.Table:
        rows = {name: group.column(name).to_pylist() for name in PACKED_NAMES}
        out = [(rows["batch"][i], rows["places"][i], rows["ids"][i], rows["ths"][i], rows["firsts"][i]) for i in range(group.num_rows) if rows["ids"][i] is not None]
        mine = [i for i in range(group.num_rows) if rows["ids"][i] is None]
        if mine:
            chosen = judge([rows["hashes"][i] for i in mine], [rows["docs"][i] for i in mine])
            at = 0
            for i in mine:
                places = unpacked(rows, i)
                told = places[chosen[at:at + len(places)]]
                at += len(places)
                if len(told):
                    out.append((rows["batch"][i], told.astype(np.uint32).tobytes(), None, None, None))
        return pa.Table.from_batches([record_batch(out, REPLY_TYPES, REPLY_NAMES)])

    return run


def hit(hashes: list[bytes], _) -> np.ndarray:
    """Entries whose hash has a block and another entry: entries of one hash are of different rows."""
    h = np.frombuffer(b"".join(hashes), np.uint32)
    order = np.argsort(h >> 1, kind="stable")
    own = h[order]
    begin = runs(own >> 1)
    count = np.diff(np.r_[begin, len(own)])
    block = np.logical_or.reduceat((own & 1).astype(bool), begin)
    out = np.zeros(len(h), dtype=bool)
    out[order] = np.repeat(block & (count > 1), count)
    return out


def later(hashes: list[bytes], docs: list[bytes]) -> np.ndarray:
    """Entries whose hash has a smaller id."""
    h, doc = np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(docs), np.int64)
    order = np.argsort(h, kind="stable")
    begin = runs(h[order])
    smallest = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.r_[begin, len(h)]))
    out = np.zeros(len(h), dtype=bool)
    out[order] = doc[order] > smallest
    return out


def by_row(replies: DataFrame) -> DataFrame:
    """doc_id, th and the places (from 0 in the row) of each row that has any."""
    joined = replies.groupBy("batch").agg(
        F.collect_list("places").alias("places"), *(F.first(c, ignorenulls=True).alias(c) for c in ("ids", "ths", "firsts")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, ids, ths, firsts in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                places = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in parts]).astype(np.int64)) if parts else np.zeros(0, np.int64)
                ids, ths, first = np.frombuffer(ids, np.int64), np.frombuffer(ths, np.int64), np.frombuffer(firsts, np.uint32).astype(np.int64)
                at = np.searchsorted(places, first)
                rows = np.flatnonzero(np.diff(at))
                own = [(places[at[r]:at[r + 1]] - first[r]).astype(np.uint32).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ths[rows]), pa.array(own, pa.binary())], names=["doc_id", "th", "places"])

    return joined.mapInArrow(run, "doc_id long, th long, places binary").dropDuplicates(["doc_id", "th"])


def marked(rows: DataFrame, members: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """Add ``_maybe``: false where the key is certainly not among ``members``.

    A bitmap of at most 2**bits bits (8 MB), small enough to broadcast at any size, keeps texts that have no partner out
    of the shuffle of the join that must follow; rows with ``_maybe`` may still have none.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    words = members.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("_word")).agg(F.bitmap_construct_agg(F.expr("slot & 32767")).alias("_bits"))
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 15))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)).cast("int")))
    near = rows.join(F.broadcast(words), F.shiftright(slot, 15) == F.col("_word"), "left")
    return near.withColumn("_maybe", F.coalesce(bit != 0, F.lit(False))).drop("_word", "_bits")


def only_members(rows: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key may be among ``members``."""
    return marked(rows, members, keys).where("_maybe").drop("_maybe")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, th, kept, n_words, n_removed of each distinct row that loses words. kept: the other words, joined by blanks."""
    if window < 2:
        raise ValueError("a window has two words at least")
    block = window // 2
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_hash(text).alias("th")).where(F.col("doc_id").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 << max(0, (size // 6 // WORDS_PER_GROUP).bit_length())
    packed = rows.mapInArrow(anchors(groups, block), PACKED)
    hits = materialize(by_row(packed.groupBy("grp").applyInArrow(answers(hit), REPLY)))
    found = materialize(only_members(rows, hits, ["doc_id", "th"]).join(hits, ["doc_id", "th"]))
    packed = found.mapInArrow(candidates(groups, window, block), PACKED)
    removed = by_row(packed.groupBy("grp").applyInArrow(answers(later), REPLY))
    both = found.drop("places").join(removed, ["doc_id", "th"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, (ids, ths) = Words(batch), columns_of(batch)
                given = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + words.first[i] for i, x in enumerate(batch.column(batch.schema.get_field_index("places")).to_pylist())])
                h, valid = words.windows(window, BASES[0])
                gone = words.same_in_row(h, valid, given)
                edge = np.zeros(len(words.row) + 1, dtype=np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                stay = np.cumsum(edge)[:-1] == 0
                kept, counts, lost = [], np.diff(words.first), []
                for a, b in zip(words.first[:-1], words.first[1:]):
                    keep = np.flatnonzero(stay[a:b]) + a
                    kept.append(b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[keep], words.ends[keep])).decode())
                    lost.append(int(b - a - len(keep)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64())], names=["doc_id", "th", "kept", "n_words", "n_removed"])

    return both.mapInArrow(cut, "doc_id long, th long, kept string, n_words long, n_removed long").dropDuplicates(["doc_id", "th"])


def with_changes(docs: DataFrame, changes: DataFrame, doc_id: str, text: str, how: str = "left") -> DataFrame:
    """All columns of ``docs`` and those of ``changes`` (_id, _th, ...), joined on id and text hash; only rows that may have a change are shuffled."""
    keyed = docs.withColumns({"_id": docs[doc_id].cast("long"), "_th": text_hash(text)})
    rows = marked(keyed, changes, ["_id", "_th"])
    given = changes.withColumnsRenamed({"_id": "_id2", "_th": "_th2"})
    near = rows.where("_maybe").join(given, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), how)
    far = rows.where("not _maybe")
    return near.drop("_id", "_th", "_id2", "_th2", "_maybe").unionByName(far.drop("_id", "_th", "_maybe"), allowMissingColumns=True)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row, with its text cut where it repeats; the text of the others is untouched."""
    changed = materialize(repeats(docs, doc_id, text, window)).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("kept").alias("_kept"))
    joined = with_changes(docs, changed, doc_id, text)
    return joined.withColumn(text, F.coalesce("_kept", F.col(text))).select(*docs.columns)


def word_digests(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words and the digest of all words joined by blanks, of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in text_column(batch, "text").cast(pa.large_binary()).to_pylist():
                own = text.translate(BLANKS).split()
                counts.append(len(own))
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "th", "n_words", "sha256"])

    return docs.select("doc_id", text_hash("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_words long, sha256 string")


BLANKS = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")

SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS s FROM words WHERE len(w) >= 50),
hashed AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM starts),
gone AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS m FROM hashed) WHERE m < doc_id),
lost AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM gone) GROUP BY doc_id),
kept AS (SELECT words.doc_id, w, coalesce(len(ps), 0) AS n, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k FROM words LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query("op8_fixed_block_anchors", SQL)
def op8_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    changed = repeats(docs).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    whole = word_digests(docs)
    joined = whole.join(changed, (F.col("doc_id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
