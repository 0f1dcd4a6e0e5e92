"""Centres: nearest-centre search, distance matrices and K-means.

Centres are a table.  They are cut into blocks bounded in bytes; one block at a time passes through the driver to
become a broadcast, a pass over the rows holds a bounded number of blocks, and rows carry their best centre from pass
to pass.  Tasks compute distances as matrix products over Arrow batches and settle near ties by plain differences, so
equal centres tie exactly and the smallest id wins.

``kmeans`` is Lloyd's loop on Spark aggregates: a round is one pass that emits a row of sums per task and centre; Spark
adds them up.  Its k centres live on the driver, bounded by ``CENTRE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsuite.functions import rng
from recsuite.operators.common import cut_lineage, dense_index

BLOCK_BYTES = 16 << 20    # vectors of one block of centres
PROBE = 64                # a smaller table of centres is looked at as a whole
PASS_BLOCKS = 16          # blocks that a pass over the rows holds
CENTRE_BYTES = 64 << 20   # centres of a K-means model
CELLS = 1 << 21           # distances computed at once
NEAR = 1e-9               # relative rounding that is settled by plain differences


def matrix_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the vectors that are not NULL; all have to have the same length."""
    at = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    taken = col.take(pa.array(at))
    size = pc.list_value_length(taken).to_numpy(zero_copy_only=False)
    if len(at) and (size != size[0]).any():
        raise ValueError("vectors of different lengths")
    flat = pc.list_flatten(taken).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return at, flat.reshape(len(at), int(size[0]) if len(at) else 0)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def distances(x: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """Squared euclidean or cosine distance of every row of ``x`` to every row of ``c``, up to rounding."""
    if kind == "cosine":
        return 1.0 - _over(x, _norms(x)[:, None]) @ _over(c, _norms(c)[:, None]).T
    return np.maximum((x ** 2).sum(axis=1)[:, None] + (c ** 2).sum(axis=1) - 2.0 * (x @ c.T), 0.0)


def _plain(x: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """The same row by row, from differences or one product each."""
    if kind == "cosine":
        return 1.0 - _over(np.einsum("ij,ij->i", x, c), _norms(x) * _norms(c))
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff)


def nearest(x: np.ndarray, ids: np.ndarray, c: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(nearest id, distance) of every row; ties go to the smallest id."""
    best_id, best = np.zeros(len(x), ids.dtype), np.full(len(x), np.inf)
    step = max(1, CELLS // max(1, len(c)))
    for i in range(0, len(x), step):
        part = x[i:i + step]
        d = distances(part, c, kind)
        room = NEAR * (1.0 + ((part ** 2).sum(axis=1) + (c ** 2).sum(axis=1).max() if kind != "cosine" else 0.0))
        r, k = np.nonzero(d <= (d.min(axis=1) + room)[:, None])
        true = _plain(part[r], c[k], kind)
        order = np.lexsort((ids[k], true, r))
        first = order[np.unique(r[order], return_index=True)[1]]
        best_id[i + r[first]], best[i + r[first]] = ids[k[first]], true[first]
    return best_id, best


def _blocks(centres: DataFrame, cid: str, cvec: str, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the centres, at most ``block_bytes`` of vectors each; one block at a time is collected."""
    t = centres.select(F.col(cid).cast("bigint").alias("c"), F.col(cvec).cast("array<double>").alias("v"))
    few = t.limit(PROBE).toArrow()
    if 0 < few.num_rows < PROBE and few["v"].nbytes <= block_bytes:  # the whole table is one small block
        yield _block(few)
        return
    size = t.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size.n:
        raise ValueError("no centres")
    per = max(1, block_bytes // (8 * max(1, size.d)))
    numbered = t if size.n <= per else dense_index(t, ["c"], "_b")
    for i in range(-(-size.n // per)):
        yield _block((numbered if size.n <= per else numbered.filter(F.floor(F.col("_b") / per) == i)).select("c", "v").toArrow())


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    at, c = matrix_of(rows["v"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())))
    if len(at) < rows.num_rows:
        raise ValueError("a centre without a vector")
    return rows["c"].to_numpy(), c


def _passes(centres: DataFrame, cid: str, cvec: str, block_bytes: int) -> Iterator[list]:
    """Broadcast blocks, as many at a time as one pass over the rows holds."""
    held: list = []
    for block in _blocks(centres, cid, cvec, block_bytes):
        held.append(centres.sparkSession.sparkContext.broadcast(block))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


def assign_nearest(df: DataFrame, vec: str, centres: DataFrame, cid="cluster", cvec="centre", distance="euclidean",
                   out="cluster", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nearest centre per row (ties -> smallest centre id) and its distance ``dist`` (squared if euclidean);
    a NULL vector has neither."""
    kind = centres.schema[cid].dataType
    # neutral names on the way: Arrow functions cannot take every column name
    rest = [f for f in df.schema if f.name not in (out, "dist")]
    own = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)]
    schema = T.StructType([*own, T.StructField("best", T.LongType()), T.StructField("far", T.DoubleType())])
    at_vec = [f.name for f in rest].index(vec)
    res, first = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)]), True
    for blocks in _passes(centres, cid, cvec, block_bytes):
        if not first:
            res = cut_lineage(res)  # the pass before is over; its blocks are not needed any more

        def run(batches, blocks=blocks, first=first):
            for b in batches:
                at, x = matrix_of(b.column(at_vec))
                best_id, best = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, np.inf)
                if not first:
                    best_id = pc.fill_null(b.column(len(own)), 0).to_numpy(zero_copy_only=False).copy()
                    best = pc.fill_null(b.column(len(own) + 1), np.inf).to_numpy(zero_copy_only=False).copy()
                for block in blocks:
                    ids, c = block.value
                    if not len(at):
                        break
                    i, d = nearest(x, ids, c, distance)
                    better = (d < best[at]) | ((d == best[at]) & (i < best_id[at]))
                    best_id[at[better]], best[at[better]] = i[better], d[better]
                none = np.isinf(best)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(own)], pa.array(best_id, pa.int64(), mask=none),
                                                  pa.array(best, mask=none)], names=schema.names)

        res, first = res.mapInArrow(run, schema), False
    return res.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(rest)], F.col("best").cast(kind).alias(out),
                      F.col("far").alias("dist"))


def distance_matrix(df: DataFrame, key: str, vec: str, centres: DataFrame, cid="cluster", cvec="centre",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Squared euclidean and cosine distance of every row to every centre (``rows x k`` output is the
    requested matrix); a NULL vector gives no rows."""
    t = df.select(F.col(key), F.col(vec).alias("_v"))
    schema = T.StructType([t.schema[key], T.StructField(cid, T.LongType()), T.StructField("sq_euclidean", T.DoubleType()),
                           T.StructField("cosine", T.DoubleType())])
    res = None
    for blocks in _passes(centres, cid, cvec, block_bytes):
        def run(batches, blocks=blocks):
            for b in batches:
                at, x = matrix_of(b.column(1))
                for block in blocks:
                    ids, c = block.value
                    step = max(1, CELLS // len(c) // 8)
                    for i in range(0, len(at), step):
                        part = x[i:i + step]
                        rows = pa.array(np.repeat(at[i:i + step], len(c)))
                        each, other = np.repeat(part, len(c), axis=0), np.tile(c, (len(part), 1))
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(rows), pa.array(np.tile(ids, len(part)), pa.int64()),
                             pa.array(_plain(each, other, "euclidean")), pa.array(_plain(each, other, "cosine"))],
                            names=[f.name for f in schema])

        part = t.mapInArrow(run, schema)
        res = part if res is None else res.unionByName(part)
    return res.withColumn(cid, F.col(cid).cast(centres.schema[cid].dataType))


# ---- M2 ----------------------------------------------------------------------------------------------------------
def _rows(batches, vec_at: int = 0) -> Iterator[np.ndarray]:
    for b in batches:
        at, x = matrix_of(b.column(vec_at))
        if len(at):
            yield x


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()),
                                    pa.array(np.ascontiguousarray(x, dtype=np.float64).reshape(-1)))


def _round(points: DataFrame, centres: np.ndarray, kind: str) -> dict[int, np.ndarray]:
    """Mean of the members of every centre that has any: a row of sums per task and centre, added up by component."""
    ids = np.arange(len(centres))

    def sums(batches):
        total, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for x in _rows(batches):
            own, _ = nearest(x, ids, centres, kind)
            np.add.at(total, own, x)
            count += np.bincount(own, minlength=len(centres))
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used]), _doubles(total[used])],
                                             names=["c", "n", "s"])

    parts = points.mapInArrow(sums, "c bigint, n bigint, s array<double>").select("c", "n", F.posexplode("s"))
    means = parts.groupBy("c", "pos").agg((F.sum("col") / F.sum("n")).alias("m"))
    got = means.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("m")).collect()  # k rows
    return {r.c: np.array([e.m for e in r.m]) for r in got}


def _farthest(points: DataFrame, centres: np.ndarray, kind: str, count: int) -> list[np.ndarray]:
    """The ``count`` points farthest from their centres (ties: smaller vector first), nearer than which none is."""
    ids = np.arange(len(centres))

    def far(batches):
        for x in _rows(batches):
            _, d = nearest(x, ids, centres, kind)
            least = np.sort(d)[::-1][min(count, len(d)) - 1]
            at = np.flatnonzero((d >= least) & (d > 0))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), _doubles(x[at])], names=["d", "v"])

    rows = points.mapInArrow(far, "d double, v array<double>").distinct()
    return [np.array(r.v) for r in rows.orderBy(F.desc("d"), "v").limit(count).collect()]


def _snapped(points: DataFrame, centres: np.ndarray, kind: str) -> np.ndarray:
    """The point nearest to each centre (ties: the smaller vector)."""
    def near(batches):
        for x in _rows(batches):
            d = distances(x, centres, kind)
            room = d.min(axis=0) + NEAR * (1 + (x ** 2).sum(axis=1).max() + (centres ** 2).sum(axis=1))
            r, c = np.nonzero(d <= room)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(_plain(x[r], centres[c], kind)),
                                              _doubles(x[r])], names=["c", "d", "v"])

    best = points.mapInArrow(near, "c bigint, d double, v array<double>").groupBy("c").agg(
        F.min(F.struct("d", "v"))["v"].alias("v")).collect()  # k rows
    out = centres.copy()
    for r in best:
        out[r.c] = r.v
    return out


def _seeded(df: DataFrame, vec: str, k: int, seed: int, key: str | None) -> np.ndarray:
    """``k`` rows in the order of their md5 key (of ``key``, or of the vector itself)."""
    by = rng.md5_key(seed, F.col(key) if key else F.concat_ws(",", F.col(vec).cast("array<string>")))
    t = df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), by.alias("o"))
    got = t.orderBy("o", "v").limit(k).collect()
    if len(got) < k:
        raise ValueError(f"{k} centres asked for, {len(got)} vectors there")
    return np.array([r.v for r in got])


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, distance: str = "euclidean", tol: float = 1e-4,
           max_iter: int = 20, out="cluster", key: str | None = None, start: DataFrame | None = None, snap: bool = True,
           seen: Callable[[int, float], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """M2: K-means, euclidean or cosine.  Starts from ``k`` seeded rows (keyed by ``key``) or from the ``start`` table
    ``(cluster, centre)``, whose centres are first moved to the nearest point if ``snap``.  A round assigns every row
    and moves each centre to the mean of its rows; a centre without rows takes the farthest point of the round.  The loop ends
    when the squared sum of the centres' moves is below ``tol``, or after ``max_iter`` rounds (0: no limit); ``seen`` is told
    (round, that number).  Returns (rows with cluster and ``dist``, centres ``(cluster, centre array)``); a row with a
    NULL vector has no cluster."""
    if distance not in ("euclidean", "cosine"):
        raise ValueError(f"distance {distance!r} is neither euclidean nor cosine")
    points = cut_lineage(df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")))
    if start is None:
        centres = _seeded(df, vec, k, seed, key)
    else:
        if start.count() != k:
            raise ValueError(f"{k} centres asked for, but the start has another number of them")
        ids, centres = next(_blocks(start, *start.columns[:2], CENTRE_BYTES))
        centres = centres[np.argsort(ids)]
    if len(centres) < k or centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"{k} centres take more than {CENTRE_BYTES} bytes; cluster the centres of a smaller k first")
    if start is not None and snap:
        centres = _snapped(points, centres, distance)
    rounds = 0
    while True:
        means = _round(points, centres, distance)
        empty = [i for i in range(k) if i not in means]
        moved = centres.copy()
        for i, m in means.items():
            moved[i] = m
        for i, v in zip(empty, _farthest(points, centres, distance, len(empty)) if empty else []):
            moved[i] = v
        shift = float(_norms(moved - centres).sum()) ** 2
        centres, rounds = moved, rounds + 1
        if seen:
            seen(rounds, shift)
        if shift < tol or rounds == max_iter:
            break
    table = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], f"{out} int, centre array<double>")
    return assign_nearest(df, vec, table, out, "centre", distance, out), table


def stored_centres(df: DataFrame, vec: str, k: int, path: str, seed: int = 42, **options) -> DataFrame:
    """M2: centres kept per (k, seed) below ``path``; made by ``kmeans`` and written if there are none for vectors of this
    length yet.  A negative k means rows // -k."""
    spark = df.sparkSession
    if k < 0:
        k = df.count() // -k
    place = f"{path.rstrip('/')}/k={k}/seed={seed}"
    width = df.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
    try:
        kept = spark.read.parquet(place)
        first = kept.select(F.size("centre").alias("d")).first()
        if width is not None and first is not None and first.d == width.d and kept.count() == k:
            return kept
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    _, centres = kmeans(df, vec, k, seed, **options)
    centres.write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
