"""Structured Streaming forms of two batch operators.

* P1 — windowed CTR over event time: watermark + tumbling window aggregation in append mode into a Parquet file
  sink: a window is emitted once the watermark (max event time - delay) passes its end; rows later than the
  watermark are dropped.  Checkpoint and output live under the shared checkpoint folder.
  Exact AUC needs the counts of every score; ``windowed_auc_sketch`` keeps a bounded number of score buckets per window and
  gives AUC with its error bound.
* P2 — last-N history per user as a stateful operator.  ``last_n_history_stream`` keeps N items per user and orders the rows
  of a micro-batch, which is right for in-order input.  ``ordered_last_n_history_stream`` lets rows wait until the
  watermark has passed them (event-time timers), so rows that come late within the delay are ordered, too; its
  state is N items and the rows inside the delay.  Its output equals the batch E1 operator.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from recsuite.operators.metrics import score_bucket
from recsuite.sources.io import scratch_dir


def event_stream(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """A file stream over the Parquet files of ``folder`` matching ``file_glob``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def windowed_ctr(stream: DataFrame, ts="ts", kind="event_type", window="1 day", delay="1 hour",
                 shown=("view", "click"), clicked=("click",)) -> DataFrame:
    """Per event-time window: shown events, clicks and CTR (late rows beyond the watermark dropped)."""
    s = stream.filter(F.col(kind).isin(list(shown))).withColumn(ts, F.col(ts).cast("timestamp"))
    g = s.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("shown"), F.sum(F.col(kind).isin(list(clicked)).cast("int")).alias("clicks"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "shown",
                    F.col("clicks").cast("bigint").alias("clicks"),
                    F.try_divide(F.col("clicks").cast("double"), F.col("shown")).alias("ctr"))


def windowed_score_counts(stream: DataFrame, score: str, ts="ts", kind="event_type", window="1 day", delay="1 hour",
                          shown=("view", "click"), clicked=("click",)) -> DataFrame:
    """Clicks ``p`` and other shown events ``q`` per event-time window and score: what an exact AUC needs, as a
    streaming aggregation (late rows beyond the watermark dropped)."""
    s = stream.filter(F.col(kind).isin(list(shown))).withColumn(ts, F.col(ts).cast("timestamp"))
    hit = F.col(kind).isin(list(clicked)).cast("bigint")
    g = s.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), F.col(score).alias("score")) \
        .agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("q"))
    return g.select(F.col("w.start").alias("window_start"), "score", "p", "q")


def windowed_auc(counts: DataFrame) -> DataFrame:
    """Exact ROC AUC (ties 1/2) per window from its score counts; NULL where a window has one class only."""
    above = Window.partitionBy("window_start").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("q_above", F.coalesce(F.sum("q").over(above), F.lit(0)))
    P, N = F.sum("p"), F.sum("q")
    lost = F.sum(F.col("p") * (F.col("q_above") + 0.5 * F.col("q")))
    return c.groupBy("window_start").agg(P.alias("clicks"), (P + N).alias("shown"),
                                         F.when((P > 0) & (N > 0), 1 - lost / (P * N)).alias("auc"))


def windowed_auc_sketch(stream: DataFrame, score: str, ts="ts", kind="event_type", window="1 day", delay="1 hour",
                        shown=("view", "click"), clicked=("click",), bucket=score_bucket) -> DataFrame:
    """One row per event-time window, made by the stream itself: clicks, shown, ``auc`` and ``auc_error`` with
    |exact AUC - auc| <= auc_error.  The state is a mergeable sketch: clicks, other events, least and largest score per
    bucket of ``bucket(score)``, a function that never inverts the order and has boundedly many values (``score_bucket``), so
    its size does not depend on the number of distinct scores.  Pairs from different buckets are ordered exactly; pairs inside a
    bucket count 1/2, exactly so if it holds a single score.  A NULL score is left out; AUC is NULL where a window has
    one class only."""
    s = stream.filter(F.col(kind).isin(list(shown)) & F.col(score).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    hit = F.col(kind).isin(list(clicked)).cast("bigint")
    sketch = s.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), bucket(F.col(score)).alias("b")) \
        .agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("q"), (F.min(score) == F.max(score)).alias("one"))
    # a window's buckets meet in a second aggregation of the same stream
    whole = sketch.groupBy(F.window(F.window_time("w"), window).alias("w")).agg(
        F.array_sort(F.collect_list(F.struct("b", "p", "q", "one"))).alias("l"))
    total = lambda f: F.aggregate("l", F.lit(0).cast("double"), lambda a, e: a + f(e))
    won = F.aggregate("l", F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("s")), lambda a, e: F.struct(
        (a["below"] + e["q"]).alias("below"), (a["s"] + e["p"] * (a["below"] + 0.5 * e["q"])).alias("s")))["s"]
    c = whole.select("w", total(lambda e: e["p"]).alias("P"), total(lambda e: e["q"]).alias("Q"), won.alias("s"),
                     total(lambda e: F.when(e["one"], 0.0).otherwise(0.5 * e["p"] * e["q"])).alias("open"))
    both = (F.col("P") > 0) & (F.col("Q") > 0)
    return c.select(F.col("w.start").alias("window_start"), F.col("P").cast("bigint").alias("clicks"),
                    (F.col("P") + F.col("Q")).cast("bigint").alias("shown"),
                    F.when(both, F.col("s") / (F.col("P") * F.col("Q"))).alias("auc"),
                    F.when(both, F.col("open") / (F.col("P") * F.col("Q"))).alias("auc_error"))


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_parquet(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> str:
    """Run a streaming query once over everything available (append mode, Parquet sink, checkpointed in the
    shared folder) and return the output path.  ``conf``: settings of the session while the query starts and runs."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        return _run_to_parquet(df, name)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run_to_parquet(df: DataFrame, name: str) -> str:
    base = scratch_dir(df.sparkSession, f"{name}_{uuid.uuid4().hex}")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    q = df.writeStream.outputMode("append").format("parquet").option("path", out) \
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


HISTORY_SCHEMA = "user_id long, event_id long, ts timestamp, history array<long>"
STATE_SCHEMA = "items array<long>"


def _last_n_fn(n: int, item: str, ts: str):
    def fn(key, pdfs, state):
        buf = list(state.get[0]) if state.exists else []
        out = []
        # a user's rows of a micro-batch may come in several Arrow batches: order them all before folding
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values([ts, item], kind="mergesort")
        for it, t in zip(pdf[item].tolist(), pdf[ts].tolist()):
            out.append((key[0], it, t, [x for x in buf[-n:] if x is not None]))
            buf = (buf + [it])[-n:]
        state.update((buf,))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "history"])
    return fn


def last_n_history_stream(stream: DataFrame, n: int, user="user_id", item="event_id", ts="ts") -> DataFrame:
    """For every event, the user's previous n items (NULL items use a slot and are dropped), with per-user
    state of at most n items."""
    s = stream.select(F.col(user).alias("user_id"), F.col(item).alias(item), F.col(ts).alias(ts))
    return s.groupBy("user_id").applyInPandasWithState(
        _last_n_fn(n, item, ts), HISTORY_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


class OrderedLastN(StatefulProcessor):
    """Rows wait in ``waiting`` until the watermark has passed their time, then leave in (time, id) order, each with the ids in
    ``seen`` before it.  One timer per user, at the earliest waiting row."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "item bigint")
        self.waiting = handle.getListState("waiting", "us bigint, item bigint")

    def _wake(self, rows: list, before: bool = False) -> None:
        """One timer, at the earliest of ``rows`` or, with ``before``, at the one that is set already if that is earlier."""
        first = [-(-min(us for us, _ in rows) // 1000)] if rows else []
        timers = list(self.handle.listTimers())
        if before and timers:
            first = [min(first + timers)]
        for t in timers:
            if t not in first:
                self.handle.deleteTimer(t)
        for t in first:
            if t not in timers:
                self.handle.registerTimer(t)

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for pdf in rows:
            new += [(int(us), None if pd.isna(i) else int(i)) for us, i in zip(pdf["us"].tolist(), pdf["item"].tolist())]
        self.waiting.appendList(new)
        self._wake(new, before=True)  # the rows that wait already have their timer and are not read for it
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get())
        ready = sorted((r for r in held if r[0] <= passed), key=lambda r: (r[0], r[1] is None, r[1] or 0))
        later = [r for r in held if r[0] > passed]
        seen, out = [i for i, in self.seen.get()], []
        for us, item in ready:
            out.append((key[0], item, us, [x for x in seen[-self.n:] if x is not None]))
            seen = (seen + [item])[-self.n:]
        self.seen.put([(i,) for i in seen]) if seen else self.seen.clear()
        self.waiting.put(later) if later else self.waiting.clear()
        self._wake(later)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "us", "history"])

    def close(self) -> None:
        pass


def ordered_last_n_history_stream(stream: DataFrame, n: int, user="user_id", item="event_id", ts="ts",
                                  delay="1 hour") -> DataFrame:
    """For every event, the user's previous n items in (time, id) order (NULL items use a slot and are dropped), whatever
    order the rows come in within ``delay``.  A row is emitted once the watermark has passed it; rows later than that
    are dropped, as are rows without a time.  Run it with ``ROCKSDB`` as the state store."""
    s = stream.select(F.col(user).cast("bigint").alias("user_id"), F.col(item).cast("bigint").alias("item"),
                      F.col(ts).cast("timestamp").alias("ts")).filter("ts IS NOT NULL")
    s = s.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    out = s.groupBy("user_id").transformWithStateInPandas(
        OrderedLastN(n), "user_id bigint, event_id bigint, us bigint, history array<bigint>", "append", "eventTime")
    return out.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"), "history")
