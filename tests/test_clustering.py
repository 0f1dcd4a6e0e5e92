"""M2, M3 / M10 and M7 against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsuite.operators import clustering as K
from recsuite.operators import vectors as V


def dist(x, c, kind):
    if kind == "cosine":
        n = lambda a: a / np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]
        return 1 - n(x) @ n(c).T
    return ((x[:, None, :] - c[None]) ** 2).sum(axis=2)


def plain_lloyd(x, c, kind, rounds):
    for _ in range(rounds):
        d = dist(x, c, kind)
        own, new = d.argmin(axis=1), c.copy()
        empty = [i for i in range(len(c)) if not (own == i).any()]
        for i in set(range(len(c))) - set(empty):
            new[i] = x[own == i].mean(axis=0)
        far = sorted({(-round(d[j].min(), 12), tuple(x[j])) for j in range(len(x)) if d[j].min() > 0})
        for i, (_, v) in zip(empty, far):
            new[i] = v
        c = new
    return c, dist(x, c, kind).argmin(axis=1), dist(x, c, kind).min(axis=1)


@pytest.fixture(scope="module")
def points(spark):
    rnd = np.random.default_rng(3)
    x = np.vstack([rnd.normal(m, 0.4, (60, 5)) for m in (-3.0, 0.5, 4.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(5)
    return x, df.unionByName(spark.createDataFrame([(999, None)], df.schema))


def start_table(spark, c):
    return spark.createDataFrame([(10 * i, v.tolist()) for i, v in reversed(list(enumerate(c)))], "cluster int, centre array<double>")


@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
def test_kmeans_equals_plain_lloyd(spark, points, kind):
    x, df = points
    c = x[[0, 1, 70, 130]]
    rows, centres = K.kmeans(df, "v", 4, distance=kind, start=start_table(spark, c), snap=False, tol=0, max_iter=4)
    expected, own, d = plain_lloyd(x, c, kind, 4)
    got = np.array([r.centre for r in centres.orderBy("cluster").collect()])
    assert np.allclose(got, expected, rtol=0, atol=1e-9)
    by = {r.id: (r.cluster, r.dist) for r in rows.collect()}
    assert by.pop(999) == (None, None)
    assert [by[i][0] for i in range(len(x))] == own.tolist() and np.allclose([by[i][1] for i in range(len(x))], d, atol=1e-9)


def test_warm_start_from_converged_centres_stops_after_one_round(spark, points):
    _, df = points
    log = []
    _, centres = K.kmeans(df, "v", 3, key="id", tol=1e-12, max_iter=0, seen=lambda n, s: log.append((n, s)))
    assert len(log) > 1 and log[-1][1] < 1e-12
    again = []
    _, same = K.kmeans(df, "v", 3, start=centres, snap=False, tol=1e-9, max_iter=0, seen=lambda n, s: again.append(n))
    assert again == [1]
    snapped = []
    K.kmeans(df, "v", 3, start=centres, tol=1e-9, max_iter=0, seen=lambda n, s: snapped.append(n))
    assert snapped[-1] >= 1


def test_an_empty_cluster_takes_the_farthest_point(spark, points):
    x, df = points
    far = np.full((1, 5), 1e6)
    c = np.vstack([x[:1], far, x[70:71], far + 1])
    rows, centres = K.kmeans(df, "v", 4, start=start_table(spark, c), snap=False, tol=0, max_iter=1)
    expected, own, _ = plain_lloyd(x, c, "euclidean", 1)
    assert np.allclose([r.centre for r in centres.orderBy("cluster").collect()], expected, atol=1e-9)
    assert rows.select("cluster").filter("cluster is not null").distinct().count() == 4 == len(set(own))


def test_fewer_distinct_points_than_centres(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id int, v array<double>")
    rows, centres = K.kmeans(df, "v", 3, key="id", max_iter=0)
    assert {r.cluster for r in rows.collect()} == {0} and centres.count() == 3
    with pytest.raises(ValueError):
        K.kmeans(df, "v", 7, key="id")
    with pytest.raises(ValueError):
        K.kmeans(df, "v", 2, start=centres)


def test_centres_are_kept_by_k_and_seed(spark, points, tmp_path):
    _, df = points
    path = str(tmp_path / "centres")
    first = K.stored_centres(df, "v", 3, path, key="id", max_iter=2).collect()
    spark.createDataFrame([(0, [9.0] * 5), (1, [8.0] * 5), (2, [7.0] * 5)], "cluster int, centre array<double>") \
        .write.mode("overwrite").parquet(f"{path}/k=3/seed=42")
    kept = K.stored_centres(df, "v", 3, path, key="id", max_iter=2)
    assert sorted(r.centre[0] for r in kept.collect()) == [7.0, 8.0, 9.0] and len(first) == 3
    assert K.stored_centres(df, "v", 3, path, seed=7, key="id", max_iter=2).count() == 3   # another seed is another entry
    assert K.stored_centres(df, "v", -60, path, key="id", max_iter=1).count() == 181 // 60
    wide = df.select("id", F.concat("v", "v").alias("v"))                                  # other vectors: made anew
    assert {len(r.centre) for r in K.stored_centres(wide, "v", 3, path, key="id", max_iter=2).collect()} == {10}


@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
def test_many_centres_in_bounded_blocks(spark, monkeypatch, kind):
    rnd = np.random.default_rng(8)
    x, c = np.round(rnd.normal(0, 1, (90, 6)), 1), np.round(rnd.normal(0, 1, (230, 6)), 1)
    c[200:] = c[:30]                     # equal centres: the smaller id wins
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "id int, v array<double>, `a.b` int").repartition(3)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster bigint, centre array<double>")
    monkeypatch.setattr(K, "PASS_BLOCKS", 3)
    collected = []
    plain = K._blocks

    def blocks(*a):
        for b in plain(*a):
            collected.append(b[1].nbytes)
            yield b

    monkeypatch.setattr(K, "_blocks", blocks)
    got = K.assign_nearest(df, "v", t, distance=kind, block_bytes=20 * 48)
    assert len(collected) == 12 and max(collected) <= 20 * 48
    d = np.array([[(((a - b) ** 2).sum() if kind == "euclidean" else 1 - (a @ b) / max(1e-300, np.sqrt((a @ a) * (b @ b)))) for b in c] for a in x])
    for r in got.collect():
        best = int(np.flatnonzero(d[r.id] <= d[r.id].min() + 1e-12)[0])
        assert (r.cluster, r["a.b"]) == (best, r.id) and abs(r.dist - d[r.id].min()) < 1e-9
    m = K.distance_matrix(df, "id", "v", t, block_bytes=20 * 48)
    cells = {(r.id, r.cluster): r.sq_euclidean if kind == "euclidean" else r.cosine for r in m.collect()}
    assert len(cells) == d.size and all(abs(cells[i, j] - d[i, j]) < 1e-9 for i in range(90) for j in range(230))


def test_distilled_sets_number_rows_under_a_total_order(spark):
    train = spark.createDataFrame([(1, 5, 1), (1, 4, 1), (2, 4, 1), (3, 9, 1), (1, 6, 0)], "u int, i int, label int")
    dev = spark.createDataFrame([(1, 7, 0), (3, 7, 1), (2, 1, 1)], "u int, i int, label int")
    kept = spark.createDataFrame([(1,), (2,), (1,)], "u int")
    a, b = V.distilled_sets(train, dev, kept, "u", order=["u", "i"], index="n")
    assert sorted(map(tuple, a.collect())) == [(1, 4, 1, 0), (1, 5, 1, 1), (2, 4, 1, 2)]
    assert sorted(map(tuple, b.collect())) == [(1, 7, 0, 0), (2, 1, 1, 1)]
    with pytest.raises(ValueError):
        V.distilled_sets(train, dev, kept, "u")
