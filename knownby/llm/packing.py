"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document's ids, with the end id appended, are cut into as many pieces of the
largest length as fit and then into the binary digits of the rest, longest first.
Each piece is a sequence of its own at a power of two, so training draws batches
from buckets of equal length. Ids of sequences are dense ranges by bucket and
partition: equal lengths have neighbouring ids, without a sort or a shuffle.

Ids are those of the library's own call: a string in the text that the vocabulary has as an added token is its one id.

Rows: a null or empty text is the end id alone, one piece of length 1; a null
doc_id stays null; repeated rows are packed once each. Only ``doc_id`` and the
text are read, so other columns cannot clash. An empty table gives no pieces.
The stage is a map over the input, so a lost task is simply run again.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.llm.catalog import query
from knownby.llm.pretokens import Cached, split
from knownby.llm.tables import WIDE_BYTES, slices, table, text_column

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
END = 0

PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
BUCKET_BITS, PARTITION_BITS = 59, 34


@functools.cache
def encoder(path: str) -> Cached:
    """Ids by the tokenizers library, which encodes the matches of its pattern one by one."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # pieces hold no whole special string (``special``)
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def encode(pieces: list[bytes]) -> Iterator[list[int]]:
        for a in range(0, len(pieces), 10_000):
            for found in batch([p.decode() for p in pieces[a:a + 10_000]], add_special_tokens=False):
                yield found.ids

    return Cached(encode)


@functools.cache
def special(path: str) -> tuple[object, tuple[str, ...]]:
    """The library's tokenizer as it stands, and the strings that it takes for one id each wherever they stand."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def cut(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full ones, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(df: DataFrame, path: str, longest: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) and its place in its sequence."""
    if not 1 <= longest <= 1 << 15 or longest & longest - 1:
        raise ValueError("the longest piece must be a power of two up to 32768")
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        used = [0] * longest.bit_length()
        for whole in batches:
            for batch in slices(whole, "text", WIDE_BYTES):
                texts = text_column(batch, "text").to_pylist()
                tokenizer, strings = special(path)
                prefix = os.path.commonprefix(strings)  # sought first, in one pass over each text
                # A text with a string that has an id of its own goes to the library as a whole.
                whole_ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for i, t in enumerate(texts) if prefix in t and any(s in t for s in strings)}
                tokens, first = split(["" if i in whole_ids else t for i, t in enumerate(texts)] if whole_ids else texts)
                ids, per = encoder(path).ids(tokens)
                at = np.concatenate([[0], np.cumsum(per)])[first].tolist()
                rows, start, length, piece, total, bucket, sequence = [], [], [], [], [], [], []
                for row, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    given = whole_ids.get(row, ids[a:b])
                    own, place, count = given.tobytes() + tail, 0, len(given) + 1
                    for size in cut(count, longest):
                        k = size.bit_length() - 1
                        rows.append(row)
                        start.append(place)
                        length.append(size)
                        piece.append(own[4 * place:4 * (place + size)])
                        total.append(count)
                        bucket.append(k)
                        sequence.append(k << BUCKET_BITS | partition << PARTITION_BITS | used[k])
                        used[k] += 1
                        place += size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(piece, pa.binary()),
                     pa.array(total, pa.int64()), pa.array(bucket, pa.int32()), pa.array(sequence, pa.int64()), pa.array([0] * len(rows), pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"])

    return source.mapInArrow(run, PIECES.format(id=source.schema["doc_id"].dataType.simpleString()))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a reader draws equal sequences."""
    pieces.write.partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_pack_powers_of_two")
def op9_pack_powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
