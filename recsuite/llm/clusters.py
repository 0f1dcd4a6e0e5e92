"""Centroid clustering in exact integers, with centroids filtered by an N-simplex projection.

Every vector's squared distances to a few pivots are computed once and kept in a scratch table.  The pivots span a
simplex; a vector's distances to them give the coordinates of its apex over that simplex: its place in the pivots'
plane and its altitude above it.  For two apexes the plane distance together with the difference of the altitudes is a
lower bound of the true distance, together with their sum an upper bound.  A centroid whose lower bound exceeds the
smallest upper bound cannot be nearest; only the others are compared by exact integer distances.

A round is one pass over the scratch table: tasks assign their rows and emit one row of sums per centroid, Spark adds
these up, and the driver gets ``k`` rows.  Nothing else leaves the tasks, so no vector is shuffled and a vector that
fills a third of the table is no hot key.

Defined results: vectors that are NULL, have another number of components than ``dims``, or a NULL or non-finite
component take no part.  Repeated rows are vectors of their own.  Ties go to the smaller centroid number.  Rows with a
NULL id take part; as starting centroids they come last.  Equal ids order their vectors by components at the start.  With fewer than
``k`` vectors there are as many centroids as vectors; an empty table gives an empty result.  Other columns are not
carried, whatever their names.  A component whose integer is beyond ``LIMIT`` stops the job (its distances would not
fit a long), a sum of distances beyond a long likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Scratch, finite_rows, to_integers

DIMS = 64
SCALE = 1024
K = 8
ROUNDS = 10
PIVOTS = 16
SEED = "3:"
LIMIT = 1 << 27       # 64 squared differences of 2**28 fit a long
FLAT = 0.05           # a pivot lower than this part of the largest pivot distance is left out
SLACK = 1e-6          # of the squared distances; covers rounding in the bounds


class Simplex:
    """The simplex of some pivots, and apexes over it.

    Pivot 0 is the origin; row i of ``base`` are the coordinates of pivot i + 1, zero beyond column i.  Pivots that lie
    nearly in the plane of the earlier ones are left out."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots[:1]
        self.base, self._solve = np.empty((0, 0)), np.empty((0, 0))
        far = max((squared(pivots, p).max() for p in pivots), default=0)
        for p in pivots[1:]:
            plane, height = self.apexes(np.array([[d] for d in squared(self.pivots, p)]).T)
            if height[0] <= FLAT * np.sqrt(far):
                continue
            n = len(self.base)
            base = np.zeros((n + 1, n + 1))
            base[:n, :n], base[n, :n], base[n, n] = self.base, plane[0], height[0]
            self.base, self._solve = base, np.linalg.inv(base).T
            self.pivots = np.vstack([self.pivots, p])

    def apexes(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates in the plane, altitudes) from squared distances to the pivots, one row per vector."""
        d2 = d2.astype(np.float64)
        plane = (d2[:, :1] - d2[:, 1:] + (self.base ** 2).sum(axis=1)) / 2 @ self._solve
        return plane, np.sqrt(np.maximum(0, d2[:, 0] - (plane ** 2).sum(axis=1)))

    def distances(self, q: np.ndarray) -> np.ndarray:
        return np.stack([squared(q, p) for p in self.pivots], axis=1)

    def bounds(self, d2: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared (lower, upper) bounds of the distances between the rows of two tables of pivot distances."""
        plane, height = self.apexes(d2)
        plane2, height2 = self.apexes(other)
        low, high = (np.empty((len(d2), len(other))) for _ in range(2))
        for c in range(len(other)):
            gap = ((plane - plane2[c]) ** 2).sum(axis=1)
            room = SLACK * (d2[:, 0] + other[c, 0] + 1)
            low[:, c] = gap + (height - height2[c]) ** 2 - room
            high[:, c] = gap + (height + height2[c]) ** 2 + room
        return low, high


def squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one integer vector."""
    diff = q.astype(np.int64) - p
    return np.einsum("ij,ij->i", diff, diff)


def nearest(q: np.ndarray, d2: np.ndarray, centroids: np.ndarray, simplex: Simplex,
            exact: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance, comparisons made).  Unless ``exact``, a row with one centroid left by
    the bounds is not compared and its distance is -1."""
    low, high = simplex.bounds(d2, simplex.distances(centroids))
    open_ = low <= high.min(axis=1, keepdims=True)
    best, distance = open_.argmax(axis=1).astype(np.int64), np.full(len(q), -1, np.int64)
    compare = np.ones(len(q), bool) if exact else open_.sum(axis=1) > 1
    made = 0
    for c in range(len(centroids)):
        at = np.flatnonzero(open_[:, c] & compare)
        d = squared(q[at], centroids[c])
        better = (distance[at] < 0) | (d < distance[at])
        best[at[better]], distance[at[better]] = c, d[better]
        made += len(at)
    return best, distance, made


def _integers(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    at, matrix = finite_rows(batch.column(1), dims)
    return at, to_integers(matrix, scale, LIMIT)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).astype(kind.to_pandas_dtype())))


def _back(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy().reshape(n, -1) if n else np.empty((0, 0), np.int64)


def first_by_hash(vectors: DataFrame, count: int, dims: int = DIMS, scale: int = SCALE,
                  seed: str = SEED) -> np.ndarray:
    """Integer rows of the ``count`` vectors with the smallest sha256 of seed and id, in that order."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, q = _integers(b, dims, scale)
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _rows(q, pa.int32())], names=["id", "q"])

    rows = (vectors.mapInArrow(tidy, f"id {vectors.schema[0].dataType.simpleString()}, q array<int>")
            .orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last(), "q")
            .limit(count).select("q").collect())  # at most ``count`` rows
    return np.array([r.q for r in rows], dtype=np.int64).reshape(len(rows), dims)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id",
            vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, pivots: int = PIVOTS,
            seed: str = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): every vector with the centroid that ``rounds``
    of assigning and averaging lead to."""
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    first = first_by_hash(source, max(k, pivots), dims, scale, seed)
    kind = f"`{id_col}` {source.schema[0].dataType.simpleString()}"
    out = f"{kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not len(first):
        return vectors.sparkSession.createDataFrame([], out)
    simplex, centroids = Simplex(first[:pivots]), first[:k]

    def cached(batches):
        for b in batches:
            at, q = _integers(b, dims, scale)
            if len(at):
                yield pa.RecordBatch.from_arrays([_rows(q, pa.int32()), _rows(simplex.distances(q), pa.int64())],
                                                 names=["q", "d2"])

    scratch = Scratch(vectors.sparkSession, "clusters")
    cache = scratch.table(source.mapInArrow(cached, "q array<int>, d2 array<bigint>"), "distances")

    def totals(centroids: np.ndarray, distances: bool) -> list:
        """Count and component sums, or the sum of distances, per centroid: one row of each task, added up."""
        def sums(batches):
            count = [0] * len(centroids)
            total = np.zeros((len(centroids), 1 if distances else dims), dtype=object)  # exact beyond 64 bits
            for b in batches:
                q = _back(b.column(0))
                best, far, _ = nearest(q, _back(b.column(1)), centroids, simplex, exact=distances)
                for c in np.unique(best):
                    mine = best == c
                    count[c] += int(mine.sum())
                    part = [sum(far[mine].tolist())] if distances else q[mine].sum(axis=0, dtype=np.int64).tolist()
                    total[c] += np.array(part, dtype=object)
            used = [c for c, n in enumerate(count) if n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([count[c] for c in used], pa.int64()),
                 pa.array([total[c].tolist() for c in used], pa.list_(pa.decimal128(38, 0)))], names=["c", "n", "s"])

        parts = cache.mapInArrow(sums, "c int, n bigint, s array<decimal(38,0)>")
        return (parts.select("c", "n", F.posexplode("s")).groupBy("c", "pos")
                .agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect())  # a row per centroid and component

    for _ in range(rounds):
        moved = centroids.copy()
        for r in totals(centroids, False):
            moved[r.c, r.pos] = int(r.s) // r.n
        centroids = moved
    own = {r.c: int(r.s) for r in totals(centroids, True)}
    scratch.drop()
    whole = sum(own.values())

    def assigned(batches):
        for b in batches:
            at, q = _integers(b, dims, scale)
            best, far, _ = nearest(q, simplex.distances(q), centroids, simplex, exact=True)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(best, pa.int32()), pa.array(far),
                     pa.array([own[c] for c in best.tolist()], pa.int64()), pa.array([whole] * len(at), pa.int64()),
                     _rows(centroids, pa.int64()).take(pa.array(best))],
                    names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return source.mapInArrow(assigned, out)


def op11_centroids(vectors: DataFrame) -> DataFrame:
    got = cluster(vectors)
    return got.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)) \
        .drop("centroid")


def _oracle() -> str:
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1)::BIGINT AS c, q
  FROM (SELECT * FROM v ORDER BY sha256('{SEED}' || vec_id) LIMIT {K})
)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(list_sum(list_transform(range(1, {DIMS + 1}), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j])))::BIGINT
                * {K} + c) AS m
  FROM v CROSS JOIN c{i} c GROUP BY r
)""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.q, old.q) AS q FROM c{i} old LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM (
      SELECT m % {K} AS c, j, sum(q[j])::BIGINT AS s, count(*) AS n
      FROM a{i} JOIN v USING (r) CROSS JOIN range(1, {DIMS + 1}) t(j) GROUP BY 1, 2) GROUP BY c
  ) new ON old.c = new.c
)""")
    last = f"a{ROUNDS}"
    return f"""WITH {', '.join(steps)}
SELECT vec_id, (m % {K})::INTEGER AS cluster, (m // {K})::BIGINT AS distance,
  sum(m // {K}) OVER (PARTITION BY m % {K})::BIGINT AS cluster_inertia, sum(m // {K}) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM {last} JOIN v USING (r) JOIN c{ROUNDS} c ON c.c = m % {K}"""


ORACLE = _oracle()
