"""Centroid clustering in exact integers, each vector's centroid found in a vantage-point tree.

Vectors are turned into integers, floor(scale * x). Lloyd's rounds assign every vector
to the nearest centroid by squared Euclidean distance and replace every centroid that
has vectors by the floor of their mean. Each round builds a vantage-point tree over the
centroids and broadcasts it: an inner node holds a centroid, the vantage point, and
splits the others by their distance to it into a nearer and a farther half, keeping the
least and the greatest distance of each half; a leaf holds a few centroids. A vector
searches best first: of its open nodes the one with the smallest lower bound is next,
and the triangle inequality bounds the halves. A node is opened while its bound is not
above the smallest distance so far, equality included, so that a centroid as near with
a smaller number is seen. Bounds are in floating point with a margin above their
rounding; distances at vantage points and leaves are exact integers, and they alone
decide. The vectors of a batch advance together, each on its own node.

Rounds are jobs over the stored integers. Tasks return sums of the components of each
centroid's vectors, in limbs of 40 bits, so sums are exact at any size and reduced
before the shuffle; the driver sees one row per centroid, component and limb. A round
that changes no centroid ends the loop, since later ones would repeat it.

Rows: a vector that is null, has another number of components, or holds null or
non-finite ones takes no part and has no row in the result. Ties go to the smaller
centroid. Rows that repeat an id take part each; a row without an id takes part but is
no first centroid. With fewer vectors than centroids each vector is one; an empty
table gives no rows. Repeated centroids are allowed, the smaller number wins. Integers
beyond 2**27 are computed without a bound on their size; a distance or sum that a long
does not hold is null. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.llm.catalog import query
from knownby.llm.tables import table
from knownby.llm.vectors import matrix
from knownby.session import materialize

LEAF = 2
LIMB = 40
#: Components within these bounds have squared distances within 64 bits.
SMALL = 1 << 27
LONG = (1 << 63) - 1
ROWS = 4096


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exact: as int64 where all are small, else as Python integers."""
    if vectors.size == 0 or np.abs(vectors).max() * scale < SMALL:
        return np.floor(vectors * scale).astype(np.int64)
    numerators = (x.as_integer_ratio() for x in vectors.reshape(-1).tolist())
    return np.array([scale * a // b for a, b in numerators], dtype=object).reshape(vectors.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to one vector."""
    if x.dtype != object and y.dtype != object:
        step = x - y
        return np.einsum("ij,ij->i", step, step)
    step = x.astype(object) - y.astype(object)
    return (step * step).sum(axis=1)


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Node:
    """members: all its centroids if it is a leaf, else the vantage point alone; halves: (node, least, greatest distance to the vantage point)."""

    members: list[int]
    halves: list[tuple[int, float, float]]


class VantageTree:
    """Exact nearest centroids, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids, self.nodes = centroids, []
        self.seen = 0  # distances computed by ``nearest``
        if len(centroids):
            self._build(list(range(len(centroids))), leaf)

    def _build(self, members: list[int], leaf: int) -> int:
        number = len(self.nodes)
        node = Node(members, [])
        self.nodes.append(node)
        if len(members) > leaf:
            # The vantage point is the member farthest from the first one: points at the border split best.
            far = squared(self.centroids[members], self.centroids[members[0]])
            vantage = members[max(range(len(members)), key=lambda i: far[i])]
            rest = [m for m in members if m != vantage]
            away = root(squared(self.centroids[rest], self.centroids[vantage]))
            order = np.argsort(away, kind="stable")
            node.members = [vantage]
            for half in (order[:len(order) // 2], order[len(order) // 2:]):
                if len(half):
                    below = self._build([rest[i] for i in half], leaf)
                    node.halves.append((below, float(away[half[0]]), float(away[half[-1]])))
        return number

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, and the squared distance."""
        n = len(vectors)
        wide = vectors.dtype == object or self.centroids.dtype == object
        best = np.full(n, len(self.centroids), dtype=np.int64)
        distance = np.array([None] * n, dtype=object) if wide else np.full(n, LONG, dtype=np.int64)
        reach = np.full(n, np.inf)
        # Lower bounds of the open nodes of each vector: infinite where a node is closed.
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0
        active = np.arange(n)
        while len(active):
            own = bounds[active]
            which = own.argmin(axis=1)
            least = own[np.arange(len(active)), which]
            open_ = (least < np.inf) & (least <= reach[active])
            active, which = active[open_], which[open_]
            bounds[active, which] = np.inf
            for number in np.unique(which):
                rows = active[which == number]
                node = self.nodes[number]
                for member in node.members:
                    found = squared(vectors[rows], self.centroids[member])
                    self.seen += len(rows)
                    if wide:
                        nearer = np.array([b is None or (a, member) < (b, c) for a, b, c in zip(found, distance[rows], best[rows])], dtype=bool)
                    else:
                        nearer = (found < distance[rows]) | (found == distance[rows]) & (member < best[rows])
                    better = rows[nearer]
                    distance[better], best[better] = found[nearer], member
                    reach[better] = root(found[nearer])
                away = root(found) if node.halves else None  # of the vantage point
                for below, low, high in node.halves:
                    margin = (away + high) * 1e-12
                    bounds[rows, below] = np.maximum(np.maximum(low - away, away - high) - margin, 0)
        return best, distance


def limbs(value: int) -> list[int]:
    """The value in limbs of ``LIMB`` bits, lowest first; the last one keeps the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def kept(vectors: DataFrame, dimensions: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    vector = F.col(embedding).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).alias("vec_id"), vector.alias("vector")).where(F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False)))


def batches_of(batches: Iterable[pa.RecordBatch], dimensions: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            yield batch, integers(matrix(batch.column(batch.schema.get_field_index("vector")), dimensions), scale)


def cluster_sums(points: DataFrame, centroids: np.ndarray, scale: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Count and componentwise sum of the vectors of each centroid that has any."""
    spark, (k, dimensions) = points.sparkSession, centroids.shape
    shared = spark.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, [[0] * dimensions for _ in range(k)]
        for _, values in batches_of(batches, dimensions, scale):
            labels, _ = shared.value.nearest(values)
            for c in np.unique(labels).tolist():
                own = values[labels == c]
                counts[c] += len(own)
                sums[c] = [a + b for a, b in zip(sums[c], own.sum(axis=0).tolist())]
        # Component -1 counts.
        rows = [(c, -1, 0, counts[c]) for c in range(k) if counts[c]]
        rows += [(c, j, i, part) for c in range(k) if counts[c] for j, value in enumerate(sums[c]) for i, part in enumerate(limbs(value))]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "component", "limb", "part"])

    found = points.select("vector").mapInArrow(run, "cluster int, component int, limb int, part long").groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part")).collect()
    shared.unpersist()
    counts = {r.cluster: r.part for r in found if r.component < 0}
    sums = {c: [0] * dimensions for c in counts}
    for r in found:
        if r.component >= 0:
            sums[r.cluster][r.component] += r.part << (LIMB * r.limb)
    return counts, sums


def as_array(rows: list[list[int]], dimensions: int) -> np.ndarray:
    small = all(-SMALL <= v <= SMALL for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), dimensions)


def first_centroids(points: DataFrame, k: int, order: str, scale: int, dimensions: int) -> np.ndarray:
    """The k vectors first in order (equal ones by their components)."""
    chosen = points.withColumn("_order", F.expr(order)).where("_order is not null").orderBy("_order", "vector").limit(k).select("vector").collect()
    values = integers(np.array([r.vector for r in chosen], dtype=np.float64).reshape(len(chosen), dimensions), scale)
    return as_array(values.tolist(), dimensions)


def cluster(vectors: DataFrame, k: int, order: str, rounds: int, dimensions: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of every vector that takes part, and the final centroids. order: expression on ``vec_id``, the rows with its k smallest values start."""
    points = materialize(kept(vectors, dimensions, vec_id, embedding))
    centroids = first_centroids(points, k, order, scale, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        counts, sums = cluster_sums(points, centroids, scale)
        moved = as_array([[s // counts[c] for s in sums[c]] if c in counts else centroids[c].tolist() for c in range(len(centroids))], dimensions)
        if (moved == centroids).all():
            break
        centroids = moved
    shared = points.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in batches_of(batches, dimensions, scale):
            labels, found = shared.value.nearest(values)
            squares = pa.array([d if d <= LONG else None for d in found.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.int32()), squares], names=["vec_id", "cluster", "distance"])

    # Only where no row has an id is there a vector but no centroid; then nothing can be assigned.
    given = points if len(centroids) else points.limit(0)
    id_type = points.schema["vec_id"].dataType.simpleString()
    return given.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long"), centroids.tolist()


def whole_sum(column: str) -> Column:
    """The sum of longs, null if one is null or the sum is no long."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when((F.count(column) == F.count("*")) & (total <= LONG), total.cast("long"))


def with_totals(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256."""
    spark, stored = assigned.sparkSession, materialize(assigned)
    totals = stored.groupBy("cluster").agg(whole_sum("distance").alias("cluster_inertia"))
    all_ = stored.agg(whole_sum("distance").alias("inertia"))  # one row
    names = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    return stored.join(totals.join(digests, "cluster").crossJoin(all_), "cluster")


FIRST = "sha2(concat('3:', cast(vec_id as string)), 256)"
CLUSTERS, ROUNDS = 8, 10


def oracle() -> str:
    """The same rounds in SQL, one chain of common table expressions."""
    dims = 64
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1)::INTEGER AS c, v FROM kept WHERE vec_id IS NOT NULL
        ORDER BY sha256('3:' || vec_id::VARCHAR), v LIMIT {CLUSTERS})"""]
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {distance}, c := c.c)) AS b FROM kept k CROSS JOIN c{i} c GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"""s{i} AS MATERIALIZED (SELECT b.c AS c, j, sum(v[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN kept USING (r) CROSS JOIN (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY b.c, j)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(f.v, c.v) AS v FROM c{i} c LEFT JOIN
        (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c) f ON f.c = c.c)""")
    return f"""WITH {', '.join(parts)}
        SELECT vec_id, b.c AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} c ON c.c = b.c"""


@query("op12_vantage_kmeans", oracle())
def op12_vantage_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of 64 finite components."""
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, FIRST, ROUNDS)
    return with_totals(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
