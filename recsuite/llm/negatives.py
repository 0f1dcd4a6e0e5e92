"""Hard negatives inside score windows, by slots.

Every positive of an anchor opens a window of scores in which its negatives have to lie.  The windows of one anchor
overlap, so they are not searched one by one: their upper limits cut the scores into disjoint slots, a row falls into
one slot, and each task (a combiner) keeps the k best rows of every slot.  Spark merges the tasks' lists.  A window
then reads its own slot and all slots below it: merging the slots' lists from the lowest upwards gives the k best rows under
every upper limit, and the window's lower limit cuts the list's end off.

Anchors are a query set against all rows: they are taken in blocks of bounded size, each block is broadcast, and two passes over
the table answer it (one for the positives, one for the slots).  Tasks multiply blocks of anchors and rows as
matrices and keep only what beats the lists they have; no pair is ever a row of a table.

Defined results: scores are exact integer inner products.  Rows with a NULL id, label or vector, an empty vector, or a
NULL or non-finite component take no part.  Vectors of different lengths are not compared.  Rows that share an anchor's id
are not its candidates.  Repeated rows: equal (id, label, vector) rows are one anchor, and candidates of an anchor
with equal id and score are one candidate.  Ties go to the smaller id.  An anchor without a positive, or a window without
a row, gives nothing; a negative positive score opens no window.  An empty table gives an empty result.  Other columns
are ignored, whatever their names.  Products that do not fit a long stop the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import top_n_per_group
from .vectors import Scratch, integer_groups

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90        # window limits in per cent of the positive's score
BLOCK_ANCHORS = 8192      # anchors of a pass
BLOCK_BYTES = 8 << 20     # and bytes of their vectors
CELLS = 1 << 21           # scores computed at once
NONE = np.iinfo(np.int64).min


class Best:
    """The k best distinct (score, id) of each of ``groups`` groups, best first: score down, id up."""

    def __init__(self, groups: int, k: int):
        self.score = np.full((groups, k), NONE)
        self.id = np.full((groups, k), np.iinfo(np.int64).max)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        worst, worst_id = self.score[group, -1], self.id[group, -1]
        better = (score > worst) | ((score == worst) & (ids < worst_id))
        group, score, ids = group[better], score[better], ids[better]
        if not len(group):
            return
        k = self.score.shape[1]
        touched = np.unique(group)
        held = self.score[touched].ravel() != NONE
        group = np.concatenate([np.repeat(touched, k)[held], group])
        score = np.concatenate([self.score[touched].ravel()[held], score])
        ids = np.concatenate([self.id[touched].ravel()[held], ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        group, score, ids = group[new], score[new], ids[new]
        first = np.searchsorted(group, touched)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        keep = rank < k
        self.score[touched], self.id[touched] = NONE, np.iinfo(np.int64).max
        self.score[group[keep], rank[keep]] = score[keep]
        self.id[group[keep], rank[keep]] = ids[keep]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, id) of all that is held."""
        at = np.nonzero(self.score != NONE)
        return at[0], self.score[at], self.id[at]


def products(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; by floating point where that is exact."""
    bound = a.shape[1] * int(np.abs(a).max()) * int(np.abs(q).max())
    if bound >= 1 << 58:
        raise ValueError("inner products of these vectors do not fit a long")
    if bound < 1 << 53:
        return (a.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return a @ q.T


class Block:
    """Some anchors: ids, labels, and integer vectors by length."""

    def __init__(self, rows: list):
        self.id = np.array([r.id for r in rows], dtype=np.int64)
        self.label = np.array([r.label for r in rows], dtype=np.int64)
        length = np.array([len(r.q) for r in rows], dtype=np.int64)
        self.vectors = {}
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            self.vectors[int(n)] = at, np.array([rows[i].q for i in at], dtype=np.int64)

    def scores(self, batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor numbers, row ids, row labels, products) over the batch, a bounded number of products at a time."""
        known = ~np.asarray(pc.or_(batch.column(0).is_null(), batch.column(1).is_null()))
        ids, labels = (pc.fill_null(batch.column(i), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                       for i in (0, 1))
        for at, q in integer_groups(batch.column(2), scale, 1 << 53):
            if q.shape[1] not in self.vectors:
                continue
            mine, a = self.vectors[q.shape[1]]
            q, at = q[known[at]], at[known[at]]
            step = max(16, CELLS // len(mine))
            for i in range(0, len(at), step):
                part = at[i:i + step]
                yield mine, ids[part], labels[part], products(a, q[i:i + step])


def edges(scores: list[list[int]], most: int) -> np.ndarray:
    """Slot edges of every anchor from its positives' scores: slot j holds edge[j + 1] < score <= edge[j]."""
    out = np.full((len(scores), most + 1), NONE + 1)
    for a, own in enumerate(scores):
        upper = sorted({s * HIGH // 100 for s in own if s >= 0}, reverse=True)
        if upper:
            bottom = min(-(-s * LOW // 100) for s in own if s >= 0) - 1
            out[a, :len(upper)], out[a, len(upper):] = upper, bottom
    return out


def _kept(rows: DataFrame, block, groups_per_anchor: int, k: int, scale: int, take: Callable) -> DataFrame:
    """(a, slot, score, id): the k best rows of every anchor and slot, over all tasks."""
    def combine(batches):
        held = block.value
        best = Best(len(held.id) * groups_per_anchor, k)
        for b in batches:
            for mine, ids, labels, score in held.scores(b, scale):
                take(held, best, mine, ids, labels, score)
        group, score, ids = best.entries()
        for i in range(0, len(group), 10_000):
            g = group[i:i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g // groups_per_anchor, pa.int32()), pa.array(g % groups_per_anchor, pa.int32()),
                 pa.array(score[i:i + 10_000]), pa.array(ids[i:i + 10_000])], names=["a", "slot", "score", "id"])

    parts = rows.mapInArrow(combine, "a int, slot int, score bigint, id bigint").distinct()
    return top_n_per_group(parts, ["a", "slot"], [F.desc("score"), F.col("id")], k, salt_on=["id"])


def _take_positives(held: Block, best: Best, mine, ids, labels, score) -> None:
    hit = (score >= best.score[mine, -1][:, None]) & (held.label[mine][:, None] == labels) \
        & (held.id[mine][:, None] != ids)
    r, c = np.nonzero(hit)
    best.offer(mine[r], score[r, c], ids[c])


def _take_slots(limits) -> Callable:
    def take(held: Block, best: Best, mine, ids, labels, score) -> None:
        edge = limits.value[mine]
        slots = edge.shape[1] - 1
        other = (held.label[mine][:, None] != labels) & (held.id[mine][:, None] != ids)
        for j in range(slots):
            group = mine * slots + j
            # above the slot's lower edge, and no worse than the last one held
            least = np.maximum(edge[:, j + 1] + 1, best.score[group, -1])
            r, c = np.nonzero(other & (score <= edge[:, j][:, None]) & (score >= least[:, None]))
            best.offer(group[r], score[r, c], ids[c])
    return take


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         scale: int = SCALE, block_anchors: int = BLOCK_ANCHORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``anchors`` against ``rows``,
    both of columns id, label, v (a float vector).  The answers of every block are written to the scratch folder and
    the result reads them."""
    spark = rows.sparkSession
    scratch, work = Scratch(spark, "negatives"), Scratch(spark, "negatives-anchors")

    def tidy(batches):
        for b in batches:
            for at, q in integer_groups(b.column(2), scale, 1 << 53):
                at, flat = pa.array(at), pa.array(q.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, q.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), lists],
                                                 names=["id", "label", "q"])

    known = F.col("id").isNotNull() & F.col("label").isNotNull()
    asked = work.table(anchors.filter(known).mapInArrow(tidy, "id bigint, label bigint, q array<bigint>").distinct(),
                       "anchors")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("q").cast("bigint") * 8).alias("bytes")).first()
    # blocks by a hash of the anchor hold half of the bound each, about
    blocks = max(1, -(-2 * size.n // block_anchors), -(-2 * (size.bytes or 0) // block_bytes)) \
        if size.n > block_anchors or (size.bytes or 0) > block_bytes else 1
    number = F.pmod(F.xxhash64("id", "label", "q"), F.lit(blocks))
    for i in range(blocks):
        held = Block(asked.filter(number == i).collect())  # one block
        block = spark.sparkContext.broadcast(held)
        found = _kept(rows, block, 1, positives, scale, _take_positives).select("a", "id", "score").collect()
        own: list[list[int]] = [[] for _ in held.id]
        for r in found:  # ``positives`` rows of each anchor of the block at most
            own[r.a].append(r.score)
        edge = edges(own, positives)
        limits = spark.sparkContext.broadcast(edge)
        windows = [(r.a, int(np.flatnonzero(edge[r.a] == r.score * HIGH // 100)[0]), int(held.id[r.a]), r.id, r.score)
                   for r in found if r.score >= 0]
        windows = spark.createDataFrame(windows, "a int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint")
        kept = _kept(rows, block, positives, negatives, scale, _take_slots(limits))
        # an entry serves the windows of its own slot and of all slots above it
        merged = kept.select("a", "score", "id", F.explode(F.sequence(F.lit(0), F.col("slot"))).alias("slot"))
        order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
        merged = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        low = F.col("score") * 100 >= F.col("positive_score") * LOW
        scratch.table(windows.join(merged, ["a", "slot"]).filter(low).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")), f"answers/{i}")
        limits.destroy(), block.destroy()
    work.drop()
    return spark.read.parquet(*[f"{scratch.root}/answers/{i}" for i in range(blocks)])


def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the label moves on by one."""
    label = F.col("`label`").cast("bigint")
    rows = vectors.select(F.col("`vec_id`").cast("bigint").alias("id"),
                          F.when(F.col("`vec_id`") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                          F.col("`embedding`").alias("v"))
    return mine(rows, rows.filter(F.col("id") % 100 == 0))


ORACLE = f"""
WITH e AS MATERIALIZED (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), a AS MATERIALIZED (
  SELECT row_number() OVER () AS a, * FROM e WHERE id % 100 = 0
), s AS MATERIALIZED (
  SELECT DISTINCT a.a, a.id AS anchor_id, r.id, r.label = a.label AS same,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i]))::BIGINT AS score
  FROM a JOIN e r ON r.id <> a.id AND len(r.q) = len(a.q)
), p AS (
  SELECT a, anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, p.id AS positive_id,
  (row_number() OVER (PARTITION BY p.a, p.id, p.score ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
