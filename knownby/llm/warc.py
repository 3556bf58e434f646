"""WARC archives of captures and a globally ordered index of them.

``write_archives`` turns each capture into a WARC record and lets Spark's text
writer store them (gzip, any file system Spark can write). Of captures with equal
payloads that with the largest id is the response; the others become revisit
records. ``read_archives`` parses the files by their content lengths and leaves
one index run per file, sorted by URL key, time and id. ``merge_runs`` deals the
runs out by ranges of the key and merges the pieces of the runs in each range with
a loser tree, which gives every URL's captures in order, and the URLs too.

Rows: a null payload is an empty one; empty payloads are equal payloads. A capture
without an id is always a response and is never referred to. Repeated rows: each
copy of the row with the largest id is a response. A null URL leaves out the target
header and has the empty key; white space and control characters in a URL are
written as %20. Other columns are not read. No captures: no records.
A payload held by a third of all captures meets in the join against one row per
payload, which Spark splits; ids are reduced before they are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.llm.catalog import query
from knownby.llm.tables import prepare, table
from knownby.session import checkpoint_dir, materialize

RECORDS_PER_FILE = 5000
ROWS_PER_RANGE = 50_000
FIRST_CAPTURE = 1577836800  # 2020-01-01; a capture without a time is dated by its id in seconds after this
EOL = "\r\n"


def base32_of_hex(digest):
    """Base32 of a 160-bit hexadecimal digest: 40 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(captures: DataFrame, minimum: int = 0) -> DataFrame:
    """One row per capture with its whole record in ``value``. captures: page_id long, url, html, captured_at timestamp."""
    payload = F.coalesce("html", F.lit(""))
    rows = captures.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "captured_at", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_of_hex(F.sha1(payload)).alias("payload_digest"))
    largest = rows.groupBy("payload_digest").agg(F.max("page_id").alias("keeper"))
    joined = rows.join(largest, "payload_digest")
    revisit = (F.col("page_id") != F.col("keeper")) & (F.col("payload_bytes") >= minimum)
    revisit = F.coalesce(revisit, F.lit(False))

    def header(name: str, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    value = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(EOL),
        header("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        header("WARC-Date", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}"),
            header("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("keeper").cast("string"), F.lit(">"))))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"), header("Content-Length", block_bytes.cast("string")),
        F.lit(EOL), http, F.when(revisit, "").otherwise(F.col("payload")))
    return joined.select(value.alias("value"))


def write_archives(captures: DataFrame, path: str, minimum: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """Write gzip-compressed WARC files; the writer's line end is the end of a record."""
    (records(captures, minimum).write.option("lineSep", EOL + EOL).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


INDEX = ("run string, url_key string, captured_at string, page_id long, record_type string, refers_to long, "
         "payload_bytes long, payload_digest string, offset long, record_bytes long")
INDEX_NAMES = [part.split()[0] for part in INDEX.split(", ")]


def url_key(url: str | None) -> str:
    """The host's labels from the right, then path and query: sites and their parts sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record of one archive; the stream is never held whole."""
    source, buffer, base = iter(chunks), bytearray(), 0

    def fill(size: int) -> bool:
        while len(buffer) < size:
            chunk = next(source, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while fill(1):
        searched = 0
        while (stop := buffer.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise ValueError("a record header is cut short")
        lines = bytes(buffer[:stop]).decode().split(EOL)
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if not fill(stop + 4 + size + 4):
            raise ValueError("a record block is cut short")
        yield headers, bytes(buffer[stop + 4:stop + 4 + size]), base, stop + 8 + size
        del buffer[:stop + 8 + size]
        base += stop + 8 + size


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    reader = zlib.decompressobj(31)
    while data and not reader.eof:
        yield reader.decompress(data, step)
        data = reader.unconsumed_tail
    yield reader.flush()


def entry(run: str, headers: dict[str, str], block: bytes, offset: int, size: int) -> tuple:
    """Index row of a record. A stored payload must be what its headers say; revisits have only the headers."""
    stop = block.index(b"\r\n\r\n")
    http = block[:stop].decode()
    length = next(int(line[16:]) for line in http.split(EOL) if line.startswith("Content-Length: "))
    digest = headers["WARC-Payload-Digest"][5:]
    if headers["WARC-Type"] == "response":
        payload = block[stop + 4:]
        if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{run}: the payload at {offset} differs from its headers")
    ident = headers["WARC-Record-ID"][len("<urn:capture:"):-1]
    refers = headers.get("WARC-Refers-To")
    return (run, url_key(headers.get("WARC-Target-URI")), headers.get("WARC-Date"), None if ident == "none" else int(ident), headers["WARC-Type"],
            int(refers[len("<urn:capture:"):-1]) if refers else None, length, digest, offset, size)


def order(row: tuple) -> tuple:
    """URL key, time, id; absent values first."""
    return row[1], row[2] is not None, row[2] or "", row[3] is not None, row[3] or 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index run per archive, each sorted by URL key, time and id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [entry(name.rsplit("/", 1)[-1], *found) for found in parse(inflated(content.as_py()))]
                if rows:
                    rows.sort(key=order)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX_TYPES)], names=INDEX_NAMES)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


INDEX_TYPES = [pa.int64() if " long" in part else pa.string() for part in INDEX.split(", ")]


class LoserTree:
    """Merges k sorted lists of keys: each inner node keeps the loser of its match, so the next winner costs log k."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._play(1) if runs else -1

    def _key(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return y is None or x is not None and (x, a) <= (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and position of each key in order."""
        while self.winner >= 0 and self._key(self.winner) is not None:
            w = self.winner
            yield w, self.at[w]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """All entries in global order: by ``range_no``, then ``position`` in it."""
    ranges = max(1, -(-runs.count() // rows_per_range))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id").sortWithinPartitions("run", "url_key", "captured_at", "page_id")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # one range: a bounded number of entries
        if not batches:
            return
        found = pa.Table.from_batches(batches)
        rows = list(zip(*(found.column(c).to_pylist() for c in INDEX_NAMES[:4])))
        starts = [i for i in range(len(rows)) if i == 0 or rows[i][0] != rows[i - 1][0]] + [len(rows)]
        tree = LoserTree([[order(r) for r in rows[a:b]] for a, b in zip(starts[:-1], starts[1:])])
        taken = found.take(pa.array([starts[r] + i for r, i in tree], pa.int64()))
        numbered = (taken.append_column("range_no", pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()))
                    .append_column("position", pa.array(range(len(rows)), pa.int64())))
        yield from numbered.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, INDEX + ", range_no int, position long")


def archive(captures: DataFrame, minimum: int = 0) -> DataFrame:
    """Write the captures to new archives in the shared folder, read them back and merge their indexes."""
    spark = captures.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(captures, path, minimum)
    return merge_runs(materialize(read_archives(prepare(spark), path)))


def dated(pages: DataFrame) -> DataFrame:
    """Captures of a table without times: one second apart, in the order of their ids."""
    return pages.select("page_id", "url", "html", F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0))).alias("captured_at"))


HEX_TO_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, {1 + 5 * (i // 4)}, 5))::BIGINT >> {15 - 5 * (i % 4)} & 31)::INT + 1, 1)" for i in range(32))

SQL = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
kept AS (SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS keeper FROM hashed)
SELECT page_id, payload_bytes, {HEX_TO_BASE32} AS payload_digest,
  CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM kept
"""


@query("op7_warc_index_merge", SQL)
def op7_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the merged index."""
    merged = archive(dated(table(spark, sf_dir, "pages")))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
