"""P1 and P2 over several micro-batches, K2 over ranges of scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsuite.operators import metrics as M
from recsuite.streaming import streams as ST


def batches_of(spark, rows, schema, tmp_path, size):
    """A file stream that gives ``rows`` in this order, ``size`` at a time."""
    path = str(tmp_path / "in")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def test_history_of_rows_that_come_late_within_the_delay(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for i in range(600):
        t = 1_700_000_000 + 60 * i
        rows.append((rnd.choice([1, 1, 2, 3]), i if i % 13 else None, t))
    rows += [(1, 7000 + i, 1_700_000_000 + 60 * 300) for i in range(5)]  # ties in time
    order = sorted(rows, key=lambda r: r[2] + rnd.uniform(-1700, 1700))  # at most an hour out of order
    late = (2, 9999, 1_700_000_000)
    order = order[:-5] + [late] + order[-5:]
    data = [(u, i, t) for u, i, t in order]
    s = batches_of(spark, data, "user_id bigint, event_id bigint, t bigint", tmp_path, 90)
    s = s.select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    out = spark.read.parquet(ST.run_to_parquet(ST.ordered_last_n_history_stream(s, 3), "p2_late", ST.ROCKSDB))
    passed = max(t for *_, t in rows) - 3600
    expected = []
    for u in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1] is None, r[1] or 0))
        for k, (_, i, t) in enumerate(mine):
            if t <= passed:
                expected.append((u, i, t, [x for _, x, _ in mine[max(0, k - 3):k] if x is not None]))
    got = [(r.user_id, r.event_id, int(r.ts.timestamp()), list(r.history)) for r in out.collect()]
    key = lambda r: (r[0], r[2], r[1] is None, r[1] or 0)
    assert sorted(got, key=key) == sorted(expected, key=key) and len(expected) > 500


class _State:
    """What a processor needs of its handle, over a list."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        own = _State()
        own.get, own.appendList = (lambda: iter(own.rows)), (lambda x: own.rows.extend(x))
        own.put, own.clear = (lambda x: own.rows.__setitem__(slice(None), x)), (lambda: own.rows.clear())
        return own

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_state_is_n_items_and_the_rows_inside_the_delay():
    import pandas as pd
    p, h = ST.OrderedLastN(4), _State()
    p.init(h)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.ms})()
    for i in range(200):
        list(p.handleInputRows((1,), iter([pd.DataFrame({"us": [i * 1_000_000], "item": [i]})]), None))
        clock.ms = (i - 10) * 1000
        if h.timers and h.timers[0] <= clock.ms:
            out = pd.concat(list(p.handleExpiredTimer((1,), clock, None)))
            assert out.event_id.tolist() == [i - 10] and out.history.iloc[-1] == list(range(max(0, i - 14), i - 10))
        assert len(p.seen.rows) <= 4 and len(p.waiting.rows) <= 11 and len(h.timers) == 1


def plain_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_sketched_auc_is_within_its_bound(spark, tmp_path, scale):
    rnd = np.random.default_rng(5)
    n, day = 4000, 86_400
    t = np.sort(rnd.integers(0, 4 * day, n))
    y = (rnd.random(n) < 0.3).astype(int)
    v = (0.5 if scale < 1 else 0.0) + scale * (rnd.normal(0, 1, n) + y)
    v[::7] = v[0]                          # many equal scores
    y[(t >= day) & (t < 2 * day)] = 0      # a window of one class
    rows = [("click" if b else "view", float(x), int(a)) for a, b, x in zip(t, y, v)] + [("view", None, 5), ("buy", 1.0, 6)]
    s = batches_of(spark, rows, "event_type string, value double, t bigint", tmp_path, 1500).withColumn("ts", F.timestamp_seconds("t"))
    out = spark.read.parquet(ST.run_to_parquet(ST.windowed_auc_sketch(s, "value"), "p1_bound")).orderBy("window_start").collect()
    assert len(out) == 3
    for d, r in enumerate(out):
        w = (t >= d * day) & (t < (d + 1) * day)
        assert (r.shown, r.clicks) == (w.sum(), y[w].sum())
        if d == 1:
            assert r.auc is None and r.auc_error is None
        else:
            assert abs(plain_auc(y[w], v[w]) - r.auc) <= r.auc_error + 1e-12
            assert r.auc_error < 0.02 if scale == 1.0 else r.auc_error <= 0.5
    exact = ST.windowed_auc_sketch(s, "value", bucket=lambda c: F.floor(c * 1e12))  # a bucket per score: no error
    rows = spark.read.parquet(ST.run_to_parquet(exact, "p1_exact")).orderBy("window_start").collect()
    assert rows[0].auc_error == 0 and abs(rows[0].auc - plain_auc(y[t < day], v[t < day])) < 1e-9


def test_sketch_state_does_not_grow_with_the_scores(spark, tmp_path):
    rows = [("view", 1 + i / 1e7, i) for i in range(20_000)]
    s = batches_of(spark, rows, "event_type string, value double, t bigint", tmp_path, 10_000).withColumn("ts", F.timestamp_seconds("t"))
    q = ST.windowed_auc_sketch(s, "value").writeStream.format("memory").queryName("sketch_state").trigger(availableNow=True) \
        .option("checkpointLocation", str(tmp_path / "ckpt")).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 10


@pytest.mark.parametrize("spread", [1.0, 1e-7])
def test_global_auc_of_close_scores(spark, spread):
    rnd = np.random.default_rng(7)
    s = 0.5 + spread * np.round(rnd.random(6000), 4)
    y = (rnd.random(6000) < 0.4).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double").repartition(6)
    assert abs(M.global_auc(df, partitions=12).first().auc - plain_auc(y, s)) < 1e-12
    down = F.col("score").desc_nulls_last()
    sizes = [r["count"] for r in df.groupBy("score").count().repartitionByRange(12, down)
             .groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_global_auc_edge_cases(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert M.global_auc(one).first().auc is None and M.global_auc(one.limit(0)).first().auc is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, None), (0, None)], "label int, score double")
    assert M.global_auc(tied).first().auc == 0.5
