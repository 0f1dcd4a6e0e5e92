"""t0: the reference's documented examples, recomputed through our operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.functions import text as H
from recsuite.operators import beyond as B
from recsuite.operators import history as HI
from recsuite.operators import labels as J
from recsuite.operators import lookup as LK
from recsuite.operators import metrics as M
from recsuite.operators import prep as P
from recsuite.operators import sampling as S
from recsuite.operators import stats as D
from recsuite.operators import vocab as V


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_j1_binary_labels(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [2, 3, 4]), (1, [4, 5, 6], [3, 5]), (2, [7, 8], None)],
                               "k int, inview array<int>, clicked array<int>")
    got = sorted(rows(df.select("k", L.binary_labels().alias("l")), "k", "l"))
    assert [g[1] for g in got] == [[0, 1, 1], [0, 1, 0], [0, 0]]


def test_b5_min_negatives(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1]), (2, [1], [1]), (3, [1, 2, 3], [1, 2])],
                               "k int, inview array<int>, clicked array<int>")
    assert sorted(r.k for r in L.min_negatives(df, 1).collect()) == [1, 3]


def test_j2_remove_positives(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2]), (2, [1, 2, 3], [1]), (3, [1, 2, 3], [3])],
                               "k int, inview array<int>, clicked array<int>")
    got = sorted(rows(df.select("k", L.remove_positives().alias("n")), "k", "n"))
    assert [g[1] for g in got] == [[3], [2, 3], [1, 2]]


def test_e4_tail_and_pad(spark):
    df = spark.createDataFrame([(1, list("abc")), (2, list("defg")), (3, list("hi"))], "k int, h array<string>")
    got = sorted(rows(df.select("k", L.tail("h", 3).alias("t"), L.tail("h", 3, pad="-").alias("p")), "k", "t", "p"))
    assert [g[1] for g in got] == [list("abc"), list("efg"), list("hi")]
    assert got[2][2] == ["-", "h", "i"]


def test_e1_dynamic_history(spark):
    d = dt.datetime
    data = [(0, 9604210, d(2023, 2, 18)), (0, 9634540, d(2023, 2, 18)), (0, 9640420, d(2023, 2, 25)),
            (1, 9647983, d(2023, 2, 22)), (1, 9647984, d(2023, 2, 21)), (1, 9647981, d(2023, 2, 23)),
            (0, None, d(2023, 2, 19)), (2, None, d(2023, 2, 26))]
    df = spark.createDataFrame(data, "user_id long, item_id long, ts timestamp")
    out = HI.dynamic_history(df, 3, tiebreak=["item_id"], out="h")
    got = {(r.user_id, r.item_id): r.h for r in out.collect()}
    assert got[(0, 9604210)] == [] and got[(0, 9634540)] == [9604210]
    assert got[(0, None)] == [9604210, 9634540] and got[(0, 9640420)] == [9604210, 9634540]
    assert got[(1, 9647981)] == [9647984, 9647983] and got[(2, None)] == []


def test_f2_rank_in_list(spark):
    df = spark.createDataFrame([(1, [.2, .1, .3]), (2, [.1, .2]), (3, [.4, .2, .1, .3])], "k int, s array<double>")
    got = sorted(rows(df.select("k", L.rank_in_list("s").alias("r")), "k", "r"))
    assert [g[1] for g in got] == [[2, 3, 1], [2, 1], [1, 3, 4, 2]]


def _scored(spark, y_true, y_pred):
    data = [(g, p, y, s) for g, (ys, ss) in enumerate(zip(y_true, y_pred)) for p, (y, s) in enumerate(zip(ys, ss))]
    return spark.createDataFrame(data, "impression_id int, pos int, label int, score double")


def test_k_metric_goldens(spark):
    df = _scored(spark, [[1, 0, 0], [1, 1, 0], [1, 0, 0, 0]],
                 [[0.2, 0.3, 0.5], [0.18, 0.7, 0.1], [0.18, 0.2, 0.1, 0.1]])
    r = M.macro_mean(M.list_metrics(df, ks=(5, 10))).first()
    assert r.auc == pytest.approx(0.555556, abs=1e-6)
    assert r.mrr == pytest.approx(0.527778, abs=1e-6)
    assert r.ndcg_5 == pytest.approx(0.710310, abs=1e-6) and r.ndcg_10 == pytest.approx(0.710310, abs=1e-6)
    assert r.logloss == pytest.approx(0.716399, abs=1e-6)
    assert r.rmse == pytest.approx(0.502287, abs=1e-6)
    assert r.accuracy == pytest.approx(0.583333, abs=1e-6)
    assert r.f1 == pytest.approx(0.222222, abs=1e-6)


def test_k3_strict_vs_tied_auc(spark):
    df = _scored(spark, [[1, 1, 0, 0, 1, 0, 0, 0]], [[0.9999, 0.8, 0.8, 0.8485, 0.8624, 0.4502, 0.3357, 0.8985]])
    r = M.list_metrics(df).first()
    assert r.auc_strict == pytest.approx(0.7333, abs=1e-4)
    assert r.auc == pytest.approx(0.7667, abs=1e-4)


def test_k4_mrr_doc_example(spark):
    df = _scored(spark, [[1, 0, 0, 1, 0]], [[0.5, 0.2, 0.1, 0.8, 0.4]])
    # the reference's formula: sum(rel / rank) / sum(rel) = (1/1 + 1/2) / 2 (its docstring prints 0.25)
    assert M.list_metrics(df).first().mrr == pytest.approx(0.75)


def test_global_auc_matches_pairs(spark):
    import random
    rnd = random.Random(3)
    data = [(0, i, rnd.randint(0, 1), rnd.choice([-2.5, -0.3, 0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.71, 3e5])) for i in range(400)]
    df = spark.createDataFrame(data, "impression_id int, pos int, label int, score double")
    pos = [s for _, _, y, s in data if y == 1]
    neg = [s for _, _, y, s in data if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert M.global_auc(df).first().auc == pytest.approx(brute, abs=1e-12)
    assert M.list_metrics(df).first().auc == pytest.approx(brute, abs=1e-12)


def test_l1_intra_list_diversity(spark):
    vec = {"item1": [0.1, 0.2], "item2": [0.2, 0.3], "item3": [0.3, 0.4], "item4": [0.4, 0.5]}
    items = spark.createDataFrame(list(vec.items()), "item_id string, embedding array<double>")
    R = spark.createDataFrame([(0, ["item1", "item2"]), (1, ["item2", "item3"]), (2, ["item3", "item4"])],
                              "list_id int, items array<string>")
    got = sorted(rows(B.intra_list_diversity(R, items), "list_id", "diversity"))
    assert [g[1] for g in got] == pytest.approx([0.00772212, 0.00153965, 0.00048792], abs=1e-8)
    cand = spark.createDataFrame([(k,) for k in vec], "item_id string")
    b = B.candidate_diversity_bounds(cand, items, 2, 42).first()
    assert (b.min_diversity, b.max_diversity) == pytest.approx((0.0004879239129211843, 0.02219758592259058), abs=1e-10)


def test_d14_index_of_dispersion(spark):
    cats = [1] * 25 + [2] * 42 + [3] * 13 + [4] * 8 + [5] * 13
    df = spark.createDataFrame([(c,) for c in cats], "c int")
    assert D.index_of_dispersion(df, "c").first()[0] == pytest.approx(0.9079992157631604)
    one = spark.createDataFrame([(1,)], "c int")
    assert D.index_of_dispersion(one, "c").first()[0] is None


def test_d12_popularity(spark):
    R = spark.createDataFrame([(["item1", "item2", "item3"],), (["item1", "item3"],), (["item1", "item4"],)], "l array<string>")
    got = dict(rows(D.popularity(R, "l"), "item_id", "popularity"))
    assert got == pytest.approx({"item1": 1.0, "item2": 1 / 3, "item3": 2 / 3, "item4": 1 / 3})


def test_d15_neg_pos_ratio(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 7, "label int")
    assert D.neg_pos_ratio(df).first()[0] == pytest.approx(7 / 3)


def test_e12_e13_decay(spark):
    df = spark.createDataFrame([(list(range(5)), [[1.0], None], [0.5, 1.0])], "l array<int>, v array<array<double>>, w array<double>")
    r = df.select(L.linear_decay("l").alias("lin"), L.exponential_decay("l", 0.5).alias("ex"),
                  L.weight_vectors("v", "w").alias("wv")).first()
    assert r.lin == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0])
    assert r.ex == pytest.approx([0.0625, 0.125, 0.25, 0.5, 1.0])
    assert r.wv[0] == [0.5] and r.wv[1] == [None]


def test_f11_equal_parts(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    parts = [r.part for r in S.equal_parts(df, 3, ["k"]).orderBy("k").collect()]
    assert [parts.count(p) for p in sorted(set(parts))] == [3, 3, 1]


def test_b9_b8_b10(spark):
    df = spark.createDataFrame([(0, [1, 3]), (1, [3, 4]), (2, None), (3, [7, 8]), (4, [9, 10])], "k int, l array<int>")
    got = sorted(rows(df.select("k", L.keep_elements_in("l", [1, 3, 5, 7]).alias("x")), "k", "x"))
    assert [g[1] for g in got] == [[1, 3], [3], None, [7], None]
    ids = spark.createDataFrame([(1,), (3,), (5,), (7,)], "id int")
    sc = spark.createDataFrame([(i,) for i in range(1, 6)], "v int")
    assert sorted(rows(P.null_unless_in(sc, "v", ids, "id"), "v"), key=lambda t: (t[0] is None, t)) == \
        [(1,), (3,), (5,), (None,), (None,)]
    nn = spark.createDataFrame([([1, None, 3],), (None,), ([4, 5],)], "l array<int>")
    assert [r[0] for r in nn.select(L.drop_null_elements("l")).collect()] == [[1, 3], None, [4, 5]]


def test_c3_map_list_modes(spark):
    b = spark.createDataFrame([(1, ["A1", "A2"]), (2, ["A2", "A3"]), (3, ["A1", "A4"]), (4, ["A4", "A4"]), (5, None)],
                              "user_id int, ids array<string>")
    m = spark.createDataFrame([("A1", "News"), ("A2", "Sports"), ("A3", "Entertainment")], "k string, v string")
    fill = dict(rows(LK.map_list(b, "ids", m, "k", "v", "user_id", mode="fill", fill="Unknown"), "user_id", "ids"))
    assert fill == {1: ["News", "Sports"], 2: ["Sports", "Entertainment"], 3: ["News", "Unknown"],
                    4: ["Unknown", "Unknown"], 5: ["Unknown"]}
    drop = dict(rows(LK.map_list(b, "ids", m, "k", "v", "user_id", mode="drop"), "user_id", "ids"))
    assert drop == {1: ["News", "Sports"], 2: ["Sports", "Entertainment"], 3: ["News"], 4: None, 5: None}
    keep = dict(rows(LK.map_list(b, "ids", m, "k", "v", "user_id", mode="keep"), "user_id", "ids"))
    assert keep == {1: ["News", "Sports"], 2: ["Sports", "Entertainment"], 3: ["News", None], 4: [None, None], 5: [None]}


def test_i7_i8_first_appearance(spark):
    df = spark.createDataFrame([(0, "Hello world"), (1, "Debug the world")], "id int, t string")
    v = V.build_vocab(df.withColumn("w", F.split("t", " ")), ["w"], "id", "tok")
    e = V.encode_list(df, "t", v, "id", out="ids", sep=" ")
    assert dict(rows(e, "id", "ids")) == {0: [0, 1], 1: [2, 3, 1]}


def test_i2_reserved(spark):
    assert V.reserved_tokens(3) == ["[UNUSED0]", "[UNUSED1]", "[UNUSED2]"]
    assert V.reserved_tokens(100)[:2] == ["[UNUSED00]", "[UNUSED01]"]


def test_f1_rank_score(spark):
    df = spark.createDataFrame([(1, 100), (2, 150), (3, 200), (4, 50), (5, 300)], "id int, views int")
    got = dict(rows(S.rank_score(df, "views", "id"), "id", "score"))
    assert got == pytest.approx({5: 1.0, 3: 0.5, 2: 1 / 3, 1: 0.25, 4: 0.2})


def test_h10_h15(spark):
    df = spark.createDataFrame([(1 * 86400 + 3 * 3600 + 42 * 60 + 54,)], "s long")
    assert df.select(H.duration_text("s")).first()[0] == "1 days 3:42:54"
    n = spark.createDataFrame([("value1", ("nested_value1", "nested_value2"), (("deeply_nested_value",),))],
                              "key1 string, key2 struct<nested_key1: string, nested_key2: string>, "
                              "key3 struct<nested_key3: struct<deeply_nested_key: string>>")
    assert H.flatten_struct(n).columns == ["key1", "nested_key1-key2", "nested_key2-key2", "deeply_nested_key-nested_key3-key3"]


def test_h9_web_date(spark):
    df = spark.createDataFrame([("Fri Dec 09 15:51:44 -0800 2016",)], "d string")
    r = df.select(H.parse_web_date("d", True).alias("w"), H.parse_web_date("d", False).alias("i")).first()
    wall = int(dt.datetime(2016, 12, 9, 15, 51, 44, tzinfo=dt.timezone.utc).timestamp())
    assert r.w == wall and r.i == wall + 8 * 3600


def test_j3_npratio_shape(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 3], [1, 2]), (1, 1, [1, 2, 3, 4], [1, 3]), (2, 2, [1, 2, 3], [1]),
                                (3, 3, [1], [1])], "impression_id int, user_id int, inview array<int>, clicked array<int>")
    out = J.sample_negatives_npratio(df, 1, 123).collect()
    assert len(out) == 6
    assert all(len(r.inview) == 2 and r.inview[-1] == r.clicked[0] for r in out)
    assert [r.inview for r in out if r.impression_id == 3] == [[None, 1]]


def test_c5_union_config_conflict(spark):
    a = spark.createDataFrame([(1, "x")], "id int, title string")
    b = spark.createDataFrame([(1, "y")], "bid int, title string")
    assert LK.union_by_key(a, [(b, "bid")], "id").first().title == "y"
    b2 = b.withMetadata("title", {"vocab": "other", "max_length": 5})
    with pytest.raises(ValueError):
        LK.union_by_key(a, [(b2, "bid")], "id")
