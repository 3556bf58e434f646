"""Near duplicates of vectors by cross-polytope hashing.

A unit vector is rotated at random, by three rounds of random signs and a fast
Hadamard transform, and hashed to the nearest of the 2d signed axes. ``parts`` such
hashes make a bucket of one of ``TABLES`` tables. Each vector sits in its own bucket
and probes the buckets of the next-best axes (``PROBES`` of them), so near pairs cut
apart by one rotation still meet. Candidate pairs are verified by their cosine.

Pairs are never written. Equal vectors are one node with a count. A bucket is cut
into blocks and blocks meet pairwise in tasks of bounded size; a task counts for each
vector the verified partners that no earlier bucket could have found (both carry the
codes of all their buckets, so every task knows), and returns the components of its
own links as a forest. Links are sums of counts; components are joined up from the
forests. The hash grows with the data: ``parts`` follows the logarithm of the number
of vectors, so that buckets of unrelated vectors keep their size, and the number of
tables and probes with it.

Rows: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are their own component. Vectors of different dimensions do not
link. A row without an id links with nothing (its component is null). Rows that
repeat an id are vectors of their own: each counts as a link of the others, and the
id's component is the smallest that any of them reaches. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.llm.catalog import query
from knownby.llm.graph import connected_components
from knownby.llm.tables import table
from knownby.llm.vectors import matrix, usable
from knownby.session import materialize

COSINE = 0.9
TABLES, PROBES = 10, 3
BUCKET = 512
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), in place."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1]
        pairs[:, :, 0] += b
        np.subtract(a, b, out=pairs[:, :, 1])
        step *= 2
    return x


def rotations(unit: np.ndarray, count: int, seed: int = 17) -> Iterator[np.ndarray]:
    """``count`` pseudo-random rotations of the rows, padded to a power of two."""
    d = unit.shape[1]
    size = max(2, 1 << (d - 1).bit_length())
    random = np.random.default_rng(seed)
    for _ in range(count):
        x = np.zeros((len(unit), size))
        x[:, :d] = unit
        for _ in range(3):
            x *= random.choice([-1.0, 1.0], size)
            x = hadamard(x) / np.sqrt(size)
        yield x


def codes(unit: np.ndarray, tables: int, parts: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Own bucket (vector, table) and probed buckets (vector, table, probe) of each vector."""
    n = len(unit)
    own = np.zeros((n, tables), dtype=np.int64)
    probed = np.full((n, tables, probes), -1, dtype=np.int64)  # fewer, where there are fewer axes
    turned = rotations(unit, tables * parts)
    rows = np.arange(n)
    for t in range(tables):
        axes, losses = [], []
        for _ in range(parts):
            x = next(turned)
            order = np.argsort(-np.abs(x), axis=1)[:, :probes + 1]
            value = np.take_along_axis(x, order, axis=1)
            axes.append(2 * order + (value < 0))
            losses.append(np.abs(value[:, :1]) - np.abs(value))
        width = 2 * x.shape[1]
        best = np.zeros(n, dtype=np.int64)
        for part in axes:
            best = best * width + part[:, 0]
        own[:, t] = best
        # Probes change one part to one of its next axes; those that lose least come first.
        loss = np.concatenate([part[:, 1:] for part in losses], axis=1)
        weight = [width ** (parts - 1 - i) for i in range(parts)]
        change = np.concatenate([(part[:, 1:] - part[:, :1]) * weight[i] for i, part in enumerate(axes)], axis=1)
        take = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        probed[:, t, :take.shape[1]] = best[:, None] + change[rows[:, None], take]
    return own, probed


def parts_for(n: int, d: int) -> int:
    """Hashes per table, so that n unrelated vectors fill buckets of about ``BUCKET``."""
    width = 2 * max(2, 1 << (d - 1).bit_length())
    parts = 1
    while n / width**parts > BUCKET and width ** (parts + 1) < 2**62:
        parts += 1
    return parts


def tables_for(parts: int) -> int:
    """Each part lets a near pair meet less often; more tables keep the recall."""
    return TABLES * 2 ** (parts - 1)


def hashed(nodes: DataFrame) -> DataFrame:
    """Add ``own`` and ``probed`` to nodes with d, parts and tables."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            d, parts, tables = (batch.column(names.index(c)).to_numpy() for c in ("d", "parts", "tables"))
            for kind in sorted(set(zip(d.tolist(), parts.tolist(), tables.tolist()))):
                rows = pa.array(np.flatnonzero((d == kind[0]) & (parts == kind[1]) & (tables == kind[2])))
                chosen = batch.take(rows)
                vectors = matrix(chosen.column(names.index("vector")), kind[0])
                own, probed = codes(vectors / np.linalg.norm(vectors / np.abs(vectors).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(vectors).max(axis=1, keepdims=True), kind[2], kind[1], PROBES)
                lists = [pa.array(list(own), pa.list_(pa.int64())), pa.array(list(probed.reshape(len(own), -1)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*chosen.columns, *lists], names=[*names, "own", "probed"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(run, f"{fields}, own array<long>, probed array<long>")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position linked with each position, by repeated minima."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def partners(group: pa.Table, least: float) -> pa.Table:
    """Partners of each vector in one meeting of two blocks, counted where they meet first, and the local forest."""
    d = group.column("d")[0].as_py()
    group = group.sort_by([("node", "ascending"), ("probing", "ascending")])
    node, probing, side, copies = (group.column(c).to_numpy() for c in ("node", "probing", "side", "copies"))
    t, bucket = group.column("tbl")[0].as_py(), group.column("bucket")[0].as_py()
    diagonal = group.column("cell_a")[0].as_py() == group.column("cell_b")[0].as_py()
    vectors = matrix(group.column("vector"), d)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / scale
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    n = len(node)
    own = matrix(group.column("own"), len(group.column("own")[0]))
    probed = matrix(group.column("probed"), len(group.column("probed")[0])).reshape(n, own.shape[1], -1)
    home = np.flatnonzero(~probing)
    links_a, links_b = [], []
    for a in range(0, n, 512):
        rows = np.arange(a, min(a + 512, n))
        cosine = unit[rows] @ unit[home].T
        i, j = np.nonzero(cosine >= least)
        i, j = rows[i], home[j]
        # Two residents meet once, at the smaller position; a prober meets residents.
        ok = (node[i] != node[j]) & (probing[i] | (i < j))
        if not diagonal:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        met = np.zeros(len(i), dtype=bool)
        for s in range(t):
            met |= own[i, s] == own[j, s]
            met |= (probed[i, s] == own[j, s][:, None]).any(axis=1) | (probed[j, s] == own[i, s][:, None]).any(axis=1)
        # In this table they meet in the bucket of both, else where one probes the other, the smaller bucket first.
        elsewhere = probing[i] & ((own[i, t] == own[j, t]) | (probed[j, t] == own[i, t][:, None]).any(axis=1) & (own[i, t] < bucket))
        first = ~met & ~elsewhere
        links_a.append(i[first])
        links_b.append(j[first])
    a = np.concatenate(links_a) if links_a else np.zeros(0, np.int64)
    b = np.concatenate(links_b) if links_b else np.zeros(0, np.int64)
    count = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    used = np.flatnonzero(count > 0)
    root = local_roots(n, a, b)
    return pa.table({"node": pa.array(node[used]), "links": pa.array(count[used].astype(np.int64)), "root": pa.array(node[root[used]])})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & usable(F.col("vector")), F.col("vector")).alias("vector"))
    # Equal vectors are one node, known by its smallest id; ids may repeat, so nodes get names of their own.
    nodes = rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = materialize(nodes.select(F.xxhash64("vector", "least_id").alias("node"), "least_id", "copies", "vector", F.size("vector").alias("d")))
    plans = nodes.groupBy("d").agg(F.count("*").alias("n")).collect()  # one row per dimension
    settings = nodes.sparkSession.createDataFrame([(p.d, parts_for(p.n, p.d), tables_for(parts_for(p.n, p.d))) for p in plans], "d int, parts int, tables int")
    coded = materialize(hashed(nodes.select("node", "d", "copies", "vector").join(settings, "d")))

    resident = coded.select("node", F.col("d"), F.posexplode("own").alias("tbl", "bucket"), F.lit(False).alias("probing"))
    probing = coded.select("node", F.col("d"), F.posexplode("probed").alias("at", "bucket")).select("node", "d", F.floor(F.col("at") / PROBES).cast("int").alias("tbl"), "bucket", F.lit(True).alias("probing")).where("bucket >= 0")
    entries = resident.union(probing)
    # A bucket with one resident and no prober has no pair; large ones are cut into blocks that meet pairwise.
    sizes = entries.groupBy("d", "tbl", "bucket").agg(F.count("*").alias("size"), F.count(F.when(~F.col("probing"), 1)).alias("residents")).where("size > 1 and residents > 0")
    sizes = sizes.select("d", "tbl", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = entries.join(sizes, ["d", "tbl", "bucket"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.select("node", "d", "tbl", "bucket", "probing", F.col("block").alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("node", "d", "tbl", "bucket", "probing", "side", F.least("side", "other").alias("cell_a"), F.greatest("side", "other").alias("cell_b"))
    loaded = met.join(coded.select("node", "copies", "vector", "own", "probed"), "node")

    found = materialize(loaded.groupBy("d", "tbl", "bucket", "cell_a", "cell_b").applyInArrow(lambda g: partners(g, least), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = nodes.select("node", "least_id", "copies", "vector").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = joined.groupBy("component").agg(F.min("least_id").alias("lowest"))
    named = joined.join(lowest, "component").select("vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "lowest")
    per_row = rows.join(named, "vector", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("lowest", "vec_id").alias("component_id"))
    return per_row.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b) SELECT a, min(b) AS m FROM r GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, e.vec_id = m AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""


@query("op4_cross_polytope", SQL)
def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
