"""Iterative dataset curation by peeling: fixed-point filtering of per-user item lists.

The lists are exploded once into incidences (row, list, position, item), which are kept twice: laid out by item and by row, each
in hash buckets.  Item and row degrees are two small tables.  A round removes the items whose degree is out of bounds, looks up
only *their* incidences to lower the rows' degrees, removes the rows that fell short, and looks up only *their* incidences to lower
the items' degrees; no list is exploded, counted or collected again.  A lookup reads the buckets that hold something removed, so
what a round reads falls with what it removes.  Only O1's length cap, which shrinks a handful of times, rewrites the incidences.

Degrees are checkpointed into the shared folder (``spark.checkpoint.dir``) every round, so lineage stays one round deep and an
executor loss re-reads the last round.  The driver sees two counts a round and the numbers of the touched buckets.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsuite.operators.common import as_list
from recsuite.operators.sampling import remove_random
from recsuite.session import cut_lineage, remove_folder
from recsuite.sources.io import scratch_dir

BUCKET_ROWS = 4 << 20   # incidences of a bucket, about
MAX_BUCKETS = 1024
SENT_KEYS = 1 << 20     # keys that are sent to the incidences at a time, which then are not shuffled
MAX_SENDS = 8           # parts that a lookup's keys are sent in; more keys are joined by a shuffle
SPREAD = 8              # files that a bucket is spread over, so a hot item or row is in no single one


class Incidences:
    """The incidences ``(k, c, p, item)`` of the rows' lists, readable by the items or rows that are asked for."""

    def __init__(self, edges: DataFrame, buckets: int):
        self.spark, self.buckets = edges.sparkSession, buckets
        self.root = scratch_dir(self.spark, f"incidences_{uuid.uuid4().hex}")
        self.read: list[int] = []  # incidences in the buckets of every lookup
        self._by, self._size = {}, {}
        for side in ("k", "item"):
            spread = F.pmod(F.xxhash64("k", "item", "c", "p"), F.lit(SPREAD))
            t = (self.all if self._by else edges).withColumn("b", self._bucket(side))
            t.repartition(F.col("b"), spread).write.partitionBy("b").parquet(f"{self.root}/{side}")
            self._by[side] = self.spark.read.schema(t.schema).parquet(f"{self.root}/{side}")  # there may be no file
            self._size[side] = {r.b: r["count"] for r in self._by[side].groupBy("b").count().collect()}  # a row per bucket

    @property
    def all(self) -> DataFrame:
        return self._by["k"].drop("b")

    @property
    def rows(self) -> int:
        return sum(self._size["k"].values())

    def _bucket(self, side: str):
        return F.pmod(F.xxhash64(side), F.lit(self.buckets)).cast("int")

    def of(self, side: str, keys: DataFrame, n: int) -> DataFrame:
        """Incidences of the ``n`` items or rows in ``keys``; only the buckets that hold one are read.  Keys go to their buckets
        in parts, a group of buckets each."""
        keys = keys.select(side)
        touched = sorted(r.b for r in keys.select(self._bucket(side).alias("b")).distinct().collect())
        self.read.append(sum(self._size[side].get(b, 0) for b in touched))
        sends = min(len(touched), -(-n // SENT_KEYS))
        if sends > MAX_SENDS or n > 2 * sends * SENT_KEYS:
            return self._by[side].filter(F.col("b").isin(touched)).join(keys, side, "left_semi")
        out = self._by[side].filter(F.lit(False))
        for i in range(sends):
            part = self._by[side].filter(F.col("b").isin(touched[i::sends]))
            own = keys.filter(self._bucket(side).isin(touched[i::sends])) if sends > 1 else keys
            part = part.join(F.broadcast(own), side, "left_semi")
            out = out.unionByName(part) if i else part
        return out

    def drop(self) -> None:
        remove_folder(self.spark, self.root)


class Peeling:
    """Degrees of the items (over all lists) and of the rows (in list 0, the history) that are left."""

    def __init__(self, edges: DataFrame, rows: DataFrame, buckets: int):
        self.edges = Incidences(edges, buckets)
        self.items = cut_lineage(self.edges.all.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
        own = self.edges.all.filter("c = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        self.rows = cut_lineage(rows.join(own, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n")))

    @staticmethod
    def _lowered(degrees: DataFrame, key: str, hit: DataFrame) -> DataFrame:
        less = hit.groupBy(key).agg(F.count(F.lit(1)).alias("less"))
        return cut_lineage(degrees.join(less, key, "left").select(key, (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")))

    def remove_items(self, keep) -> None:
        """Keep the items whose degree satisfies ``keep``; rows lose the others."""
        gone = self.items.filter(~keep)
        self.items = self.items.filter(keep)
        n = gone.count()
        if n:
            self.rows = self._lowered(self.rows, "k", self.edges.of("item", gone, n).filter("c = 0"))

    def remove_rows(self, gone: DataFrame) -> None:
        """Drop rows; the items of their lists lose them."""
        n = gone.count()
        if n:
            self.rows = cut_lineage(self.rows.join(gone.select("k"), "k", "left_anti"))
            self.items = self._lowered(self.items, "item", self.edges.of("k", gone, n))

    def left(self) -> DataFrame:
        n = self.items.count()
        items = self.items.select("item")
        return self.edges.of("k", self.rows, self.rows.count()).drop("b") \
            .join(F.broadcast(items) if n <= SENT_KEYS else items, "item", "left_semi")

    def capped(self, cap: int) -> "Peeling":
        """Peeling of what is left, each list cut to its first ``cap`` items."""
        place = F.row_number().over(Window.partitionBy("k", "c").orderBy("p"))  # a list is one row's
        cut = self.left().withColumn("_r", place).filter(F.col("_r") <= cap).select("k", "c", "p", "item")
        out = Peeling(cut, self.rows.select("k"), self.edges.buckets)
        out.edges.read = self.edges.read
        self.edges.drop()
        return out

    def lists(self, df: DataFrame, key: str, cols) -> DataFrame:
        """``df``'s remaining rows with their remaining lists, in order."""
        e = self.left().groupBy("k").agg(F.collect_list(F.struct("c", "p", "item")).alias("_l"))
        out = df.join(self.rows.select(F.col("k").alias(key)), key, "left_semi").join(e.withColumnRenamed("k", key), key, "left")
        for i, c in enumerate(as_list(cols)):
            own = F.transform(F.array_sort(F.filter("_l", _in_list(i))), lambda x: x["item"])
            out = out.withColumn(c, F.coalesce(own, F.array()).cast(df.schema[c].dataType))
        out = cut_lineage(out.select(*df.columns))
        self.edges.drop()
        return out


def _in_list(i: int):
    return lambda x: x["c"] == i


def _start(df: DataFrame, key: str, cols, history: str, buckets: int | None) -> tuple[Peeling, list, int]:
    """(peeling, list columns with the history first, longest list).  Rows with a NULL key and NULL items take no part."""
    cols = [history, *[c for c in as_list(cols) if c != history]]
    df = df.filter(F.col(key).isNotNull())
    parts = None
    for i, c in enumerate(cols):
        part = df.select(F.col(key).alias("k"), F.lit(i).alias("c"), F.posexplode(c).alias("p", "item")).filter("item IS NOT NULL")
        parts = part if parts is None else parts.unionByName(part)
    sizes = [F.greatest(F.size(c), F.lit(0)) for c in cols]  # -1 for NULL
    total = df.agg(F.sum(sum(sizes[1:], sizes[0]).cast("bigint")).alias("n"),
                   F.max(F.greatest(*sizes, F.lit(0))).alias("longest")).first()
    buckets = buckets or max(1, min(MAX_BUCKETS, -(-(total.n or 0) // BUCKET_ROWS)))
    return Peeling(parts, df.select(F.col(key).alias("k")), buckets), cols, total.longest or 0


def shrinking_cap_fixed_point(df: DataFrame, key: str = "user_id", cols=("history", "neg"), history: str = "history",
                              min_count: int = 5, max_count: int = 10000, start_cap: int = 30000,
                              shrink: float = 0.2, final_cap: int = 100, buckets: int | None = None) -> tuple[DataFrame, list]:
    """O1: repeat {count items over the lists; keep items seen min..max times; when the kept-item count did not
    change, shrink the length cap (x0.2, not below ``final_cap``) or stop if it is already ``final_cap``; keep
    listed items only, cut each list to the cap, drop users with an empty history}.  Returns the final table
    and a per-round log ``(round, vocab_size, users, cap)``.  ``key`` identifies a row."""
    df = cut_lineage(df)
    s, cols, longest = _start(df, key, cols, history, buckets)
    keep = F.col("n").between(min_count, max_count)
    last, cap, log = None, start_cap, []
    for r in itertools.count(1):  # every round but the last removes items or shrinks the cap, so it ends
        size = s.items.filter(keep).count()
        if last == size:
            if cap == final_cap:
                log.append((r, size, s.rows.count(), cap))
                break
            cap = max(final_cap, int(cap * shrink))
        last = size
        s.remove_items(keep)
        if longest > cap:  # degrees are counted anew from the shorter lists
            s, longest = s.capped(cap), cap
        s.remove_rows(s.rows.filter("n < 1"))
        log.append((r, size, s.rows.count(), cap))
    return s.lists(df, key, cols), log


def core_fixed_point(df: DataFrame, key: str = "user_id", cols=("history", "neg"), history: str = "history",
                     min_item_count: int = 5, min_history: int = 10, remove_counts=(), seed=42, buckets: int | None = None,
                     reads: list | None = None) -> tuple[DataFrame, list]:
    """O2: k-core-like fixed point: keep items seen >= ``min_item_count`` times, filter the lists, keep users
    with >= ``min_history`` history items; repeat until the kept-item count is stable.  At each stable point the
    next value of ``remove_counts`` removes that many random users (md5-seeded, F18) and the loop continues;
    exhausted or 0 -> stop (the reference asks interactively).  ``reads`` gets the incidences each lookup had to read.  ``key``
    identifies a row."""
    df = cut_lineage(df)
    s, cols, _ = _start(df, key, cols, history, buckets)
    keep = F.col("n") >= min_item_count
    last, log, removals = None, [], list(remove_counts)
    for r in itertools.count(1):  # every round but the last removes items or uses up a removal, so it ends
        size = s.items.filter(keep).count()
        if last == size:
            n = removals.pop(0) if removals else 0
            if n == 0:
                log.append((r, size, s.rows.count(), None))
                break
            kept = remove_random(s.rows.select(F.col("k").alias(key)), n, f"{seed}:{r}", key).select(F.col(key).alias("k"))
            s.remove_rows(s.rows.join(kept, "k", "left_anti"))
            last = None
            log.append((r, size, s.rows.count(), n))
            continue
        last = size
        s.remove_items(keep)
        s.remove_rows(s.rows.filter(F.col("n") < min_history))
        log.append((r, size, s.rows.count(), None))
    if reads is not None:
        reads += s.edges.read
    return s.lists(df, key, cols), log
