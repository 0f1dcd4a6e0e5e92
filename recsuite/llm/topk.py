"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector becomes a code of one bit per component (its sign; see ``codes``) in as many 64-bit words as the longest vector
needs.  Every word is cut into segments of about log2(rows) - 2 bits, m in all, so that a probe meets a few codes.  A code within distance ``m * (a + 1) - 1`` of a query has a segment within distance ``a`` of the query's, so
round ``a`` probes every segment up to radius ``a`` and takes the codes at the distances it newly covers.  A query is finished
as soon as k rows are known within the covered distance; the others go on with the next radius.

Equal codes are one entry of the index with its k smallest ids, so a very common vector is one entry, and no probe ever
returns more than the pairs that are provably covered in the round.  Queries are rows whose id is divisible by 20.

Defined results: neighbours are ordered by (distance, id); a query's own row is no neighbour; NULL ids and NULL or
empty vectors, or vectors with a NULL component, are neither queries nor neighbours; components that a shorter vector lacks count
as not positive; rows with equal ids are one row (the one with the smallest code); with k or fewer other rows all
of them are returned; an empty table gives an empty result.  A round probes the smaller radii again rather than keep every
pair it met beyond the distances it covers.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import top_n_per_group
from ..session import ensure_checkpoint_dir

BITS = 64
K = 10
EVERY = 20  # queries are the rows whose id is divisible by this


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i % 64 of word i // 64 is set if component i is positive."""
    own = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    own = own.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    words = -(-(own.agg(F.max(F.size("v"))).first()[0] or 1) // BITS)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def word(j: int):
        bits = F.transform(F.slice("v", BITS * j + 1, BITS), lambda x, i: F.when(
            x > 0, F.call_function("shiftleft", one, i.cast("int"))).otherwise(none))
        return F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b))

    return own.groupBy("id").agg(F.min(F.array(*[word(j) for j in range(words)])).alias("code"))


def _segments(code, edges: list[int], words: int):
    """Array of the bits between neighbouring edges, word by word."""
    return F.array(*[F.shiftrightunsigned(F.element_at(code, j + 1), a).bitwiseAND(F.lit((1 << (b - a)) - 1))
                     for j in range(words) for a, b in zip(edges[:-1], edges[1:])])


def _distance(x, y, words: int):
    """Bits in which two codes differ, word by word."""
    word = lambda j: F.bit_count(F.element_at(x, j + 1).bitwiseXOR(F.element_at(y, j + 1)))
    return sum((word(j) for j in range(1, words)), word(0))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, segments: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of ``vectors`` (id, code) for every row of ``queries``; ``segments``: per
    word."""
    spark = vectors.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/topk-{uuid.uuid4().hex}"

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    # k + 1 ids of a code are enough: one of them may be the query's own
    entries = (top_n_per_group(vectors.select("id", "code"), ["code"], ["id"], k + 1, salt_on=["id"])
               .groupBy("code").agg(F.collect_list("id").alias("ids")))
    entries = table(entries, "entries")
    if segments is None:
        segments = -(-BITS // max(4, int(math.log2(max(2, entries.count()))) - 2))
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    width = entries.select(F.size("code").alias("w")).first()
    words = width.w if width else 1
    widths = [b - a for a, b in zip(edges[:-1], edges[1:])] * words
    segments, whole = segments * words, BITS * words
    index = table(entries.select(F.posexplode(_segments(F.col("code"), edges, words)).alias("seg", "value"), "code"), "index")
    open_queries = table(queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")), "queries")
    found, results = None, []
    for a in range(max(widths) + 1):
        low, high = segments * a, min(whole, segments * (a + 1) - 1)  # distances that this round adds
        masks = [sum(1 << b for b in bits) for r in range(a + 1) for bits in combinations(range(max(widths)), r)]
        probes = (open_queries.select("q").distinct()
                  .select("q", F.posexplode(_segments(F.col("q"), edges, words)).alias("seg", "own"))
                  .select("q", "seg", F.explode(_literal(masks)).alias("mask"), "own")
                  .filter(F.col("mask") < F.element_at(_literal([1 << w for w in widths]), F.col("seg") + 1))
                  .select("q", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
        # the planner takes the exploded probes for small; neither side is to be broadcast
        x, y = probes.hint("merge").alias("x"), index.hint("merge").alias("y")
        distance = _distance(F.col("x.q"), F.col("y.code"), words)
        near = (x.join(y, (F.col("x.seg") == F.col("y.seg")) & (F.col("x.value") == F.col("y.value"))
                       & (distance >= low) & (distance <= high))
                .select(F.col("x.q").alias("q"), F.col("y.code").alias("code"), distance.alias("distance")))
        found = near if found is None else found.unionByName(near)
        found = table(found.distinct(), f"found_{a}")
        pairs = (open_queries.join(found, "q").join(entries, "code")
                 .select("query_id", "distance", F.explode("ids").alias("id")).filter("id <> query_id"))
        best = top_n_per_group(pairs, ["query_id"], ["distance", "id"], k, salt_on=["id"])
        best = table(best.select("query_id", "id", "distance", F.col("_rank").cast("int").alias("rank")), f"best_{a}")
        if high >= whole:
            results.append(best)
            break
        done = best.filter(F.col("rank") == k).select("query_id")
        results.append(best.join(done, "query_id"))
        open_queries = table(open_queries.join(done, "query_id", "left_anti"), f"open_{a}")
        if open_queries.isEmpty():
            break
        found = found.join(open_queries.select("q").distinct(), "q", "left_semi")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select("query_id", "id", "distance", "rank")


def _literal(masks: list[int]):
    """The masks of a round (2 ** width numbers at most) as one constant."""
    return F.from_json(F.lit("[" + ",".join(map(str, masks)) + "]"), "array<bigint>")


def op3_top_k(vectors: DataFrame) -> DataFrame:
    rows = codes(vectors)
    got = search(rows, rows.filter(F.col("id") % EVERY == 0))
    return got.withColumnRenamed("id", "vec_id")


ORACLE = f"""
WITH own AS (
  SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
), w AS (
  SELECT (max(len(embedding)) + {BITS - 1}) // {BITS} AS words FROM own
), c AS (
  SELECT vec_id AS id, min(list_transform(range(0, words), lambda j: coalesce(list_sum(list_transform(
    range(1, least(len(embedding) - {BITS} * j, {BITS}) + 1),
    lambda i: CASE WHEN embedding[{BITS} * j + i] > 0 THEN (CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT
      ELSE (1::HUGEINT << (i - 1)::HUGEINT) END) ELSE 0::HUGEINT END)), 0)::BIGINT)) AS code
  FROM own, w GROUP BY vec_id
), p AS (
  SELECT q.id AS query_id, v.id AS vec_id,
    list_sum(list_transform(range(1, len(q.code) + 1), lambda j: bit_count(xor(q.code[j], v.code[j]))))::INTEGER AS distance
  FROM c q JOIN c v ON q.id <> v.id WHERE q.id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p
)
SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= {K}
"""
