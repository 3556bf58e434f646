"""Byte-level BPE by a rank queue: encoding of texts to ids and decoding back.

Merges are taken in rank order from a queue with one bucket per merge rank. A
bucket holds positions of a linked list of symbols; a three-level bitmap over the
buckets finds the lowest filled rank by find-first-set. Entries are never removed
early: one whose pair has changed since is stale and skipped when it is taken.
Cost per merge is constant, whatever the length of the pre-token, and many
pre-tokens share one queue, since merges do not cross the ends of a pre-token.

Rows: a null text counts as empty; an empty text has no ids. Every row is encoded
by itself, so repeated rows and ties give repeated results; other columns pass
through untouched (names ``ids`` and ``decoded`` are taken and replace columns of
that name). Nothing is truncated.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from knownby.llm.catalog import query
from knownby.llm.pretokens import Cached, split
from knownby.llm.tables import WIDE_BYTES, slices, table, text_column

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankBitmap:
    """A set of small integers with find-first-set over three levels of 64-bit words."""

    def __init__(self, size: int):
        self.words = [0] * (size // 64 + 1)
        self.groups = [0] * (size // 4096 + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.words[rank >> 6] |= 1 << (rank & 63)
        self.groups[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def remove(self, rank: int) -> None:
        word = self.words[rank >> 6] & ~(1 << (rank & 63))
        self.words[rank >> 6] = word
        if not word:
            group = self.groups[rank >> 12] & ~(1 << (rank >> 6 & 63))
            self.groups[rank >> 12] = group
            if not group:
                self.top &= ~(1 << (rank >> 12))

    def first(self) -> int:
        """The smallest member, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        group = self.groups[a]
        b = a << 6 | (group & -group).bit_length() - 1
        word = self.words[b]
        return b << 6 | (word & -word).bit_length() - 1


def merge_all(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each piece. One queue serves all pieces; lowest rank first, then leftmost."""
    data = b"".join(pieces)
    n = len(data)
    after = list(range(1, n + 1))  # start of the next symbol
    before = list(range(-1, n - 1))
    pair = [-1] * (n + 1)  # rank of the symbol here joined with the next
    last = bytearray(n + 1)  # the piece ends after the symbol that starts here
    first = []
    at = 0
    for piece in pieces:
        first.append(at)
        at += len(piece)
        if piece:
            last[at - 1] = 1
    buckets: dict[int, list[int]] = {}
    bitmap = RankBitmap(max(ranks.values(), default=0) + 1)
    get = ranks.get
    for i in range(n - 1):
        if not last[i]:
            rank = get(data[i:i + 2], -1)
            if rank >= 0:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    bitmap.add(rank)
    while (rank := bitmap.first()) >= 0:
        bucket = buckets[rank]
        bucket.sort(reverse=True)
        lower = False
        while bucket and not lower:
            i = bucket.pop()
            if pair[i] != rank:  # stale: the pair here has changed or is gone
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if last[j]:
                last[i] = 1
                pair[i] = -1
                before_k = None
            else:
                before[k] = i
                before_k = get(data[i:after[k]], -1)
                pair[i] = before_k
            h = before[i]
            if h >= 0 and not last[h]:
                r = pair[h] = get(data[h:k], -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(h)
                    else:
                        buckets[r] = [h]
                        bitmap.add(r)
                    lower |= r < rank
            if before_k is not None and before_k >= 0:
                if before_k in buckets:
                    buckets[before_k].append(i)
                else:
                    buckets[before_k] = [i]
                    bitmap.add(before_k)
                lower |= before_k < rank
            if last[i] and k < n:
                before[k] = i
        if not bucket:
            del buckets[rank]
            bitmap.remove(rank)
    out = []
    for start, piece in zip(first, pieces):
        ids, i, end = [], start, start + len(piece)
        while i < end:
            ids.append(ranks[data[i:after[i]]])
            i = after[i]
        out.append(ids)
    return out


def encode_pieces(pieces: list[bytes], ranks: dict[bytes, int], group: int = 1 << 16) -> Iterator[list[int]]:
    """Ids of each pre-token: a pre-token that is a symbol itself, else by merging, in groups of about ``group`` bytes."""
    found: list[list[int] | None] = [None if (r := ranks.get(p)) is None else [r] for p in pieces]
    todo = [i for i, ids in enumerate(found) if ids is None]
    a = 0
    while a < len(todo):
        b, size = a, 0
        while b < len(todo) and (b == a or size < group):
            size += len(pieces[todo[b]])
            b += 1
        for i, ids in zip(todo[a:b], merge_all([pieces[i] for i in todo[a:b]], ranks)):
            found[i] = ids
        a = b
    return iter(found)


@functools.cache
def encoder(path: str) -> Cached:
    ranks = read_ranks(path)
    return Cached(lambda pieces: encode_pieces(pieces, ranks))


@functools.cache
def symbols(path: str) -> pa.Array:
    """The bytes of each id."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return pa.array(by_id, pa.large_binary())


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and the position of each text's first id (one more entry)."""
    tokens, first = split(texts)
    ids, per = encoder(path).ids(tokens)
    return ids, np.concatenate([[0], np.cumsum(per)])[first]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit ids as bytes), the encoding of each whole text."""
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() != "ids"] + [T.StructField("ids", T.BinaryType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, WIDE_BYTES):
                ids, at = encode_texts(text_column(batch, text).to_pylist(), path)
                column = pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), column], names=[*keep, "ids"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes that the ids stand for (null ids: no bytes)."""
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() != "decoded"] + [T.StructField("decoded", T.BinaryType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([decode_ids(np.frombuffer(x or b"", "<u4"), path) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), column], names=[*keep, "decoded"])

    return df.mapInArrow(run, schema)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    taken = symbols(path).take(pa.array(ids))
    data = taken.buffers()[2]
    return data.to_pybytes() if data is not None else b""


@functools.cache
def decimals(size: int) -> pa.Array:
    """Each id as decimal digits and a comma."""
    return pa.array([f"{i}," for i in range(size)], pa.large_string())


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode each whole text in one pass: ``text`` gives way to ``n_tokens`` and digests of ids and bytes."""
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    taken = {text, *(name for name, _ in added)}
    keep = [f for f in df.schema.fields if f.name not in taken]
    schema = T.StructType(keep + [T.StructField(*x) for x in added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = decimals(len(symbols(path)))
        for whole in batches:
            for batch in slices(whole, text, WIDE_BYTES):
                ids, at = encode_texts(text_column(batch, text).to_pylist(), path)
                ids_sha, decoded_sha = [], []
                for a, b in zip(at[:-1], at[1:]):
                    written = numbers.take(pa.array(ids[a:b])).buffers()[2] if b > a else b","
                    ids_sha.append(hashlib.sha256(memoryview(written)[:-1]).hexdigest())
                    decoded_sha.append(hashlib.sha256(decode_ids(ids[a:b], path)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                    names=schema.names)

    return df.mapInArrow(run, schema)


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = public_tokenizers.path(VOCABULARY)
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
