"""Approximate maximum-inner-product search by collision counting.

Every vector is projected on ``projections`` random lines, and the projections of a
block of vectors are kept as one sorted array per line. A query opens a window
around its own projection on every line; the windows grow together with a radius R
by virtual rehashing (the same arrays, wider windows). A vector that lies in at
least ``threshold`` windows has collided often enough to be verified by its exact
inner product. The window is ``WIDTH`` times R to each side, and the threshold is
set so that a vector at distance R is verified with probability ``CERTAINTY``; the
search of a block ends when its k-th best verified vector is not farther than R.

Largest inner products become smallest distances by one more coordinate, the square
root of (largest squared norm - squared norm), 0 for queries; the largest norm is
one number, found by an aggregation.

Blocks of vectors meet blocks of queries in one task each, so no task holds more
than two blocks, and each returns k candidates a query. Vectors of different
dimensions do not meet: a query searches those of its own.

Rows: vectors that are null, empty, zero or hold null or non-finite components, and
rows without an id, take no part. A query is not its own candidate; rows that repeat
an id count as one vector (the first in order of their components). Ties go to the
smaller id. With fewer than k candidates all are returned. Columns other than the
two named are not read.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knownby.llm.catalog import query
from knownby.llm.tables import table
from knownby.llm.vectors import matrix, packed
from knownby.session import materialize

PROJECTIONS = 64
WIDTH = 1.6
CERTAINTY = 0.9
GROWTH = 1.12
BASE_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 9
FOUND = "query_id long, id long, score double"


def threshold(projections: int, width: float, certainty: float) -> int:
    """Collisions that a vector at distance R reaches with the given probability."""
    p = 2 * NormalDist().cdf(width) - 1
    return max(1, int(projections * p - NormalDist().inv_cdf(certainty) * (projections * p * (1 - p)) ** 0.5))


class Block:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, projections: int = PROJECTIONS, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        extra = np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", vectors, vectors), 0))
        self.largest = largest
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        values = vectors @ self.lines[:-1] + extra[:, None] * self.lines[-1]
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)

    def search(self, query_id: int, vector: np.ndarray, k: int, start: float, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of at least the k best found (all, where there are fewer)."""
        n, lines = self.order.shape[1], self.order.shape[0]
        center = vector @ self.lines[:-1]
        norm = float(vector @ vector)
        low = np.array([np.searchsorted(row, c) for row, c in zip(self.sorted, center)])
        high = low.copy()
        counts = np.zeros(n, dtype=np.int64)
        verified = np.zeros(n, dtype=bool)
        verified[self.ids == query_id] = True
        left = n - int(verified.sum())
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        radius = start
        while True:
            pieces = []
            for i in range(lines):
                row = self.sorted[i]
                a, b = np.searchsorted(row, center[i] - width * radius), np.searchsorted(row, center[i] + width * radius, side="right")
                if a < low[i]:
                    pieces.append(self.order[i, a:low[i]])
                if b > high[i]:
                    pieces.append(self.order[i, high[i]:b])
                low[i], high[i] = min(a, low[i]), max(b, high[i])
            if pieces:
                counts += np.bincount(np.concatenate(pieces), minlength=n)
            fresh = np.flatnonzero((counts >= least) & ~verified)
            if len(fresh):
                verified[fresh] = True
                places = np.concatenate([places, fresh])
                scores = np.concatenate([scores, self.vectors[fresh] @ vector])
            if len(places) == left or (low == 0).all() and (high == n).all():
                return places, scores
            if len(places) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                if max(norm + self.largest - 2 * kth, 0) <= radius * radius:
                    return places, scores
            radius *= GROWTH


def search_blocks(queries: tuple[np.ndarray, np.ndarray], base: tuple[np.ndarray, np.ndarray], largest: float, k: int, projections: int, width: float, certainty: float) -> pa.RecordBatch:
    """The k best of one block of vectors for each query of another block."""
    block = Block(*base, largest, projections)
    least = threshold(projections, width, certainty)
    # The first radius: a small fraction of the distance to a handful of vectors, so that it starts below the k-th nearest.
    step = max(1, len(base[0]) // 64)
    out: list[tuple] = []
    for query_id, vector in zip(*queries):
        sample = block.vectors[::step]
        near = np.sqrt(max(float(vector @ vector) + largest - 2 * float((sample @ vector).max()), 1e-12))
        places, scores = block.search(int(query_id), vector, k, max(near * 0.5, 1e-6), width, least)
        if len(places):
            best = np.lexsort((block.ids[places], -scores))[:k]
            # The measure itself, one sum per pair, independent of the block's layout.
            exact = [float(np.dot(block.vectors[p], vector)) for p in places[best]]
            out.extend(zip([int(query_id)] * len(best), block.ids[places[best]].tolist(), exact))
    columns = list(zip(*out)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding", projections: int = PROJECTIONS,
           width: float = WIDTH, certainty: float = CERTAINTY, base_block: int = BASE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: condition on ``id``."""
    rows = materialize(packed(vectors, vec_id, embedding).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("d", F.size("vector")))
    # One row per dimension: the size of each part and its largest squared norm.
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    parts = rows.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(squared).alias("largest"))
    parts = materialize(parts.select("d", "largest", F.ceil(F.col("n") / base_block).alias("blocks"), F.ceil(F.greatest(F.col("q"), F.lit(1)) / query_block).alias("query_blocks")))
    placed = rows.join(parts, "d")
    h = F.xxhash64("id")
    base = placed.select("d", "largest", F.pmod(h, "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("query_block"), F.lit(False).alias("asks"), "id", "vector")
    asked = placed.where(is_query).select("d", "largest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(h, "query_blocks").alias("query_block"), F.lit(True).alias("asks"), "id", "vector")

    def run(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        group = group.sort_by("id")
        asks = group.column("asks").to_numpy()
        ids, values = group.column("id").to_numpy(), matrix(group.column("vector"), d)
        found = search_blocks((ids[asks], values[asks]), (ids[~asks], values[~asks]), group.column("largest")[0].as_py(), k, projections, width, certainty)
        return pa.Table.from_batches([found])

    found = base.union(asked).groupBy("d", "block", "query_block").applyInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op2_collision_counting")
def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
