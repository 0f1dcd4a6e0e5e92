"""O1 / O2 against the plain loops over Python lists."""

import random
from collections import Counter

import pytest

from recsuite.functions import rng
from recsuite.operators import curate as O


def plain_o1(rows, low, high, cap, shrink, final):
    last, log = None, []
    while True:
        n = Counter(x for _, h, g in rows for x in h + g)
        keep = {x for x, c in n.items() if low <= c <= high}
        if last == len(keep):
            if cap == final:
                return rows, log + [(len(log) + 1, len(keep), len(rows), cap)]
            cap = max(final, int(cap * shrink))
        last = len(keep)
        cut = lambda xs: [x for x in xs if x in keep][:cap]
        rows = [(u, cut(h), cut(g)) for u, h, g in rows]
        rows = [r for r in rows if r[1]]
        log.append((len(log) + 1, len(keep), len(rows), cap))


def plain_o2(rows, low, least, remove, removed_by):
    last, log, remove = None, [], list(remove)
    while True:
        n = Counter(x for _, h, g in rows for x in h + g)
        keep = {x for x, c in n.items() if c >= low}
        r = len(log) + 1
        if last == len(keep):
            k = remove.pop(0) if remove else 0
            if not k:
                return rows, log + [(r, len(keep), len(rows), None)]
            gone = removed_by([u for u, *_ in rows], k, r)
            rows = [x for x in rows if x[0] not in gone]
            last = None
            log.append((r, len(keep), len(rows), k))
            continue
        last = len(keep)
        rows = [(u, [x for x in h if x in keep], [x for x in g if x in keep]) for u, h, g in rows]
        rows = [x for x in rows if len(x[1]) >= least]
        log.append((r, len(keep), len(rows), None))


@pytest.fixture(scope="module")
def lists(spark):
    rnd = random.Random(4)
    rows = []
    for u in range(260):
        size = rnd.choice([0, 1, 3, 6, 9, 14, 40])
        pick = lambda n: [min(rnd.randrange(1, 90), rnd.randrange(1, 200)) if rnd.random() > 0.3 else 0 for _ in range(n)]
        rows.append((u, pick(size), pick(rnd.randrange(0, 9))))
    rows += [(1000 + i, [300 + i, 301 + i, 300 + i, 302 + i], [301 + i]) for i in range(40)]  # a chain that peels from its end
    df = spark.createDataFrame([(u, f"x{u}", g, h) for u, h, g in rows], "user_id int, other string, neg array<int>, history array<int>")
    return rows, df.repartition(5)


def got(out):
    return sorted((r.user_id, list(r.history), list(r.neg)) for r in out.collect())


@pytest.mark.parametrize("buckets", [None, 16])
def test_shrinking_cap_equals_the_plain_loop(lists, buckets):
    rows, df = lists
    out, log = O.shrinking_cap_fixed_point(df, min_count=4, max_count=700, start_cap=25, shrink=0.5, final_cap=6, buckets=buckets)
    expected, steps = plain_o1(rows, 4, 700, 25, 0.5, 6)
    assert got(out) == sorted(expected) and log == steps and len(log) >= 4
    assert out.columns == df.columns and {r.other for r in out.collect()} == {f"x{u}" for u, *_ in expected}
    assert out.dtypes == df.dtypes


def test_core_equals_the_plain_loop(spark, lists):
    rows, df = lists
    import hashlib

    def removed_by(users, n, r):
        order = sorted(users, key=lambda u: (hashlib.md5(f"42:{r}|{u}".encode()).hexdigest(), u))
        kept = {x.user_id for x in O.remove_random(spark.createDataFrame([(u,) for u in users], "user_id int"), n, f"42:{r}", "user_id").collect()}
        assert len(order) - len(kept) == n
        return set(users) - kept

    for buckets in (None, 32):
        out, log = O.core_fixed_point(df, min_item_count=5, min_history=4, remove_counts=[20, 7], buckets=buckets)
        expected, steps = plain_o2(rows, 5, 4, [20, 7], removed_by)
        assert got(out) == sorted(expected) and log == steps and len(log) >= 4
    assert rng.md5_key is not None


def test_a_round_reads_what_it_removes(spark):
    """A long chain peels one end at a time: each round reads a few buckets, not all incidences."""
    n = 24
    rows = [(i, [i, i + 1]) for i in range(n)] + [(1000 + i, [9000 + i % 40, 9100 + i % 40]) for i in range(1000)]
    df = spark.createDataFrame(rows, "user_id int, history array<int>")
    reads = []
    out, log = O.core_fixed_point(df, cols=("history",), min_item_count=2, min_history=2, buckets=32, reads=reads)
    assert out.count() == 1000 and len(log) == 2 + n // 2
    assert sum(reads) < 0.25 * len(reads) * 2048


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([(None, [1, 1, 1], [1]), (1, None, None), (2, [None, 3, 3], [3]), (3, [], [3])],
                               "user_id int, history array<int>, neg array<int>")
    out, _ = O.core_fixed_point(df, min_item_count=2, min_history=1)
    assert got(out) == [(2, [3, 3], [3])]
    assert got(O.core_fixed_point(df.limit(0), min_item_count=2, min_history=1)[0]) == []
    assert got(O.shrinking_cap_fixed_point(df, min_count=1, final_cap=1)[0]) == [(2, [3], [3])]


@pytest.mark.parametrize("sent,sends", [(1 << 20, 8), (7, 8), (7, 1)])
def test_lookup_by_sent_keys_shuffles_no_incidences(spark, monkeypatch, sent, sends):
    """Keys are sent, whole or in parts, whatever Spark thinks of their size; too many of them are joined by a shuffle."""
    monkeypatch.setattr(O, "SENT_KEYS", sent)
    monkeypatch.setattr(O, "MAX_SENDS", sends)
    rows = [(k, 0, p, (k * 7 + p * 3) % 50) for k in range(60) for p in range(5)]
    edges = O.Incidences(spark.createDataFrame(rows, "k bigint, c int, p int, item bigint"), 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side, at in (("k", 0), ("item", 3)):
            for n in (0, 3, 30):
                keys = spark.range(n).withColumnRenamed("id", side)
                got = edges.of(side, keys, n)
                assert sorted(map(tuple, got.select("k", "c", "p", "item").collect())) == sorted(r for r in rows if r[at] < n)
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert ("SortMergeJoin" in plan) == (n == 30 and sends == 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        edges.drop()
