"""Inputs are worked out once, and vectors are summed without sorting or shuffling them."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recsuite.operators import encode as E
from recsuite.operators import vectors as M
from recsuite.streaming import streams as ST


def counted(spark, df, col):
    """``df`` whose rows are counted each time that they are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x
    return df.withColumn(col, F.udf(count, df.schema[col].dataType)(col).alias(col)), seen


def test_members_of_the_clusters_are_worked_out_once(spark):
    rows = [(i, i % 3, float((i * 7) % 11), [float(i % 5), float(i % 7)]) for i in range(60)]
    a, seen = counted(spark, spark.createDataFrame(rows, "k long, cluster int, dist double, t array<double>"), "dist")
    got = M.select_per_cluster(a, "k", "t", 2, 0.5)
    chosen = {(r.cluster, r._rank): r.k for r in got.collect()}
    got.count()
    assert seen.value == 60
    for c in range(3):
        mine = [r for r in rows if r[1] == c]
        mean = [sum(r[3][j] for r in mine) / len(mine) for j in (0, 1)]
        score = lambda r: r[2] ** 0.5 + 0.5 * sum((x - m) ** 2 for x, m in zip(r[3], mean)) ** 0.5  # noqa: B023, E731
        assert [chosen[c, 1], chosen[c, 2]] == [r[0] for r in sorted(mine, key=lambda r: (score(r), r[0]))[:2]]


def test_user_vectors_are_sums_of_numbers(spark):
    vecs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -4.0]), (3, None)], "item_id long, embedding array<float>")
    rows = [(1, 1), (1, 1), (1, 2), (1, None), (1, 9), (2, 2), (3, 3), (None, 1), (4, None)]
    h = spark.createDataFrame(rows, "user_id long, item_id long")
    got = M.user_vectors(h, vecs)
    assert {r.user_id: r.user_vector for r in got.collect()} == {1: [5 / 3, 0.0], 2: [3.0, -4.0], None: [1.0, 2.0]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert M.user_vectors(h, vecs.limit(0)).count() == 0
    bad = vecs.unionByName(spark.createDataFrame([(9, [1.0])], vecs.schema))
    with pytest.raises(Exception, match="without 2 components"):
        M.user_vectors(h, bad).collect()
    hole = vecs.unionByName(spark.createDataFrame([(9, [1.0, None])], vecs.schema))
    with pytest.raises(Exception, match="without 2 components"):
        M.user_vectors(h, hole).collect()


def test_an_encoded_table_is_worked_out_once(spark):
    df = spark.createDataFrame([(i, f"t{i % 4}", [f"t{i % 3}", "x"]) for i in range(20)], "k long, s string, l array<string>")
    t, seen = counted(spark, df, "s")
    spec = {"s": {"vocab": "a"}, "l": {"vocab": "b", "kind": "list"}}
    out, vocabs = E.encode_tables([E.TableJob("t", t, "k", spec, index="i")])
    assert sorted(tuple(r) for r in out["t"].select("k", "s", "i").collect()) == [(i, i % 4, i) for i in range(20)]
    assert {r.token: r.idx for r in vocabs["b"].collect()} == {"t0": 0, "x": 1, "t1": 2, "t2": 3}
    assert seen.value == 20


class _Held:
    """A processor's handle over lists that counts how often a list is read."""

    def __init__(self):
        self.rows, self.timers, self.reads, self.own = [], [], 0, {}

    def getListState(self, name, schema):
        return self.own.setdefault(name, _Held())

    def get(self):
        self.reads += 1
        return iter(list(self.rows))

    def appendList(self, x):
        self.rows.extend(x)

    def put(self, x):
        self.rows[:] = x

    def clear(self):
        self.rows.clear()

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_rows_that_wait_are_read_when_their_timer_fires_only():
    h, p = _Held(), ST.OrderedLastN(2)
    p.init(h)
    add = lambda *us: list(p.handleInputRows((1,), iter([pd.DataFrame({"us": [u * 1000 for u in us], "item": list(us)})]), None))
    add(50, 40)
    add(60)
    assert h.timers == [40]
    add(20, 90)                              # a late row moves the timer forward
    add()
    assert h.timers == [20] and h.own["waiting"].reads == 0
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.ms})()
    clock.ms = 55
    out = pd.concat(list(p.handleExpiredTimer((1,), clock, None)))
    assert out.event_id.tolist() == [20, 40, 50] and out.history.tolist() == [[], [20], [20, 40]] and h.timers == [60]
    clock.ms = 95
    out = pd.concat(list(p.handleExpiredTimer((1,), clock, None)))
    assert out.event_id.tolist() == [60, 90] and out.history.tolist() == [[40, 50], [50, 60]] and h.timers == []
