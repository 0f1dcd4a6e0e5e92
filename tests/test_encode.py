"""Growing vocabularies, encode jobs over several tables, and gathered lists of lists."""

import pytest
from pyspark.sql import functions as F

from recsuite.operators import encode as E


def ids(v):
    return {r.token: r.idx for r in v.collect()}


def test_a_grown_vocabulary_keeps_every_id(spark):
    a = spark.createDataFrame([(1, "b", ["x", "b"]), (2, "a", None), (3, None, ["x", None])], "k int, s string, l array<string>")
    b = spark.createDataFrame([(1, "new2", ["x", "new1"]), (2, "a", ["new2"])], a.schema)
    first = E.grow_vocab(None, a, ["s", "l"], "k", "v", reserved=["[PAD]"])
    assert ids(first) == {"[PAD]": 0, "b": 1, "a": 2, "x": 3}
    grown = E.grow_vocab(first, b, ["l", "s"], "k", "v")
    assert ids(grown) == {"[PAD]": 0, "b": 1, "a": 2, "x": 3, "new1": 4, "new2": 5}
    assert {r.token: r.cnt for r in grown.collect()} == {"[PAD]": 0, "b": 2, "a": 2, "x": 3, "new1": 1, "new2": 2}
    assert ids(E.grow_vocab(grown, b, ["l", "s"], "k", "v")) == ids(grown)
    assert ids(E.grow_vocab(grown, b.limit(0), ["l"], "k", "v")) == ids(grown)


def test_growing_does_not_depend_on_the_partitions(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 701)).alias("s"))
    old = E.grow_vocab(None, df.filter("id < 500"), ["s"], "id", "v")
    one = ids(E.grow_vocab(old, df.coalesce(1), ["s"], "id", "v"))
    assert one == ids(E.grow_vocab(old, df.repartition(7), ["s"], "id", "v"))
    assert sorted(one.values()) == list(range(702)) and all(one[t] == i for t, i in ids(old).items())


def test_reserved_ranges(spark):
    df = spark.createDataFrame([(1, 4, [0, 7]), (2, None, None), (3, 2, [])], "k int, s int, l array<int>")
    v = E.reserve_ids(None, df, ["s", "l"], "v")
    assert ids(v) == {str(i): i for i in range(8)}
    assert ids(E.reserve_ids(v, df.select("k", (F.col("s") + 6).alias("s")), ["s"], "v")) == {str(i): i for i in range(11)}
    assert ids(E.reserve_ids(v, df, ["s"], "v")) == ids(v)
    zero = E.reserve_ids(None, df.select(F.lit(0).alias("s")), ["s"], "v")
    assert ids(E.reserve_ids(zero, df, ["s"], "v")) == {str(i): i for i in range(5)}
    assert ids(E.reserve_ids(None, df.limit(0), ["s"], "v")) == {}
    with pytest.raises(ValueError):
        E.reserve_ids(None, df.select((F.col("s") - 9).alias("s")), ["s"], "v")


def test_lists_are_encoded_together(spark):
    df = spark.createDataFrame([(1, ["a", "q", "b"], ["b", None], "keep"), (2, None, [], None), (3, ["q"], ["q"], "x")],
                               "k int, l array<string>, m array<string>, other string")
    v = spark.createDataFrame([("v", "a", 5, 1), ("v", "b", 6, 1)], E.VOCAB)
    w = spark.createDataFrame([("w", "b", 9, 1), ("w", "a", 8, 1)], E.VOCAB)
    got = E.encode_lists(df, {"l": E.ListColumn("v"), "m": E.ListColumn("w", oov=0)}, {"v": v, "w": w}, "k")
    assert {r.k: (r.l, r.m, r.other) for r in got.collect()} == {1: ([5, 6], [9, 0], "keep"), 2: ([], [], None), 3: ([], [0], "x")}
    assert got.select("k", "l", "m", "other").schema["l"].dataType.simpleString() == "array<bigint>"


def jobs(spark):
    items = spark.createDataFrame([(10, "x", "Red, red"), (11, "y", "blue"), (12, "x", None)], "nid int, cat string, title string")
    users = spark.createDataFrame([("u1", "10 99 12"), ("u2", None), ("u3", "11")], "uid string, history string")
    spec = {"item": {"id": "nid", "columns": {"nid": {"vocab": "nid", "kind": "id"}, "cat": {"vocab": "cat"},
                                              "title": {"vocab": "word", "kind": "words", "max_length": 2}}},
            "user": {"id": "uid", "columns": {"uid": {"vocab": "uid", "kind": "id"}, "history": {
                "vocab": "nid", "kind": "split", "max_length": 3, "keep": "tail", "pad": -1}}}}
    return spec, {"item": items, "user": users}


def test_jobs_share_vocabularies(spark):
    spec, tables = jobs(spark)
    out, vocabs = E.encode_tables(E.dataset_jobs(spec, tables))
    assert {(r.nid, r.cat, tuple(r.title)) for r in out["item"].collect()} == {(0, 0, (0, 1)), (1, 1, (2,)), (2, 0, ())}
    assert {(r.uid, tuple(r.history)) for r in out["user"].collect()} == {(0, (0, 3, 2)), (1, (-1, -1, -1)), (2, (1, -1, -1))}
    assert ids(vocabs["nid"]) == {"10": 0, "11": 1, "12": 2, "99": 3}
    again = spark.createDataFrame([(98, "z", "blue green")], tables["item"].schema)
    out2, more = E.encode_tables(E.dataset_jobs(spec, {"item.late": again}), vocabs)
    assert [tuple(r) for r in out2["item.late"].select("nid", "cat", "title").collect()] == [(4, 2, [2, 3])]
    assert all(ids(more[n])[t] == i for n, v in vocabs.items() for t, i in ids(v).items())


def test_closed_vocabularies(spark):
    spec, tables = jobs(spark)
    _, vocabs = E.encode_tables(E.dataset_jobs(spec, tables))
    t = spark.createDataFrame([("u1", "10 55"), ("nobody", "11")], "uid string, neg string")
    closed = lambda policy, **o: {"uid": {"vocab": "uid", "kind": "id", "open": False, "policy": policy, **o},
                                  "neg": {"vocab": "nid", "kind": "split", "open": False, "policy": "oov", "oov": 77}}
    run = lambda c: E.encode_tables([E.TableJob("neg", t, "uid", c)], vocabs)
    out, after = run(closed("drop"))
    assert [tuple(r) for r in out["neg"].select("uid", "neg").collect()] == [(0, [0, 77])] and ids(after["uid"]) == ids(vocabs["uid"])
    assert {r.uid for r in run(closed("oov", oov=9))[0]["neg"].collect()} == {0, 9}
    with pytest.raises(Exception, match="unknown token"):
        run(closed("error"))[0]["neg"].collect()
    with pytest.raises(ValueError, match="no vocabulary"):
        E.encode_tables([E.TableJob("neg", t, "uid", closed("drop"))])
    with pytest.raises(ValueError, match="not unique"):
        E.encode_tables([E.TableJob("neg", t.unionByName(t), "uid", closed("drop"))], vocabs)
    with pytest.raises(ValueError, match="no configuration"):
        E.dataset_jobs(spec, {"nothing": t})


def test_columns_of_ids_are_checked(spark):
    t = spark.createDataFrame([(1, 3, [0, 5, 2]), (2, None, None)], "k int, a int, l array<int>")
    spec = {"a": {"vocab": "v", "kind": "ids"}, "l": {"vocab": "v", "kind": "ids", "max_length": 2, "keep": "tail", "pad": 0}}
    out, vocabs = E.encode_tables([E.TableJob("t", t, "k", spec)])
    assert {(r.k, r.a, tuple(r.l or ())) for r in out["t"].collect()} == {(1, 3, (5, 2)), (2, None, ())}
    assert len(ids(vocabs["v"])) == 6


def test_gather_pads_with_the_unknown_row(spark):
    df = spark.createDataFrame([(1, [7, 8, 9, 7], "a"), (2, None, "b"), (3, [1], "c")], "k int, l array<int>, x string")
    t = spark.createDataFrame([(7, [1, 2], 70), (9, [3, 4], None)], "id int, toks array<int>, cat int")
    got = {r.k: r for r in E.gather(df, "k", "l", t, "id", {"tk": ("toks", [0, 0]), "c": ("cat", -1)}, length=3).collect()}
    assert (got[1].tk, got[1].c, got[1].x) == ([[0, 0], [3, 4], [1, 2]], [-1, -1, 70], "a")
    assert (got[2].tk, got[2].c, got[2].l) == ([[0, 0]] * 3, [-1] * 3, None)
    assert got[3].c == [-1, -1, -1]
    whole = {r.k: r.c for r in E.gather(df, "k", "l", t, "id", {"c": ("cat", -1)}).collect()}
    assert whole == {1: [70, -1, -1, 70], 2: [], 3: [-1]}


def test_example_table(spark):
    items = spark.createDataFrame([(5, 1, [9, 8, 7], 3), (6, 2, [], 4)], "item_id int, idx int, tokens array<int>, category_id int")
    imp = spark.createDataFrame([(1, 50, [6, 5, 99]), (2, 51, [5]), (3, 52, [])], "impression_id int, user_id int, inview array<int>")
    past = spark.createDataFrame([(50, [5, 6, 5]), (51, [])], "user_id int, history array<int>")
    got = {r.impression_id: r for r in E.example_table(imp, past, items, history_size=2, title_size=2).collect()}
    assert (got[1].history_idx, got[1].history_tokens, got[1].history_category) == ([2, 1], [[0, 0], [9, 8]], [4, 3])
    assert (got[1].candidate_idx, got[1].candidate_tokens, got[1].candidate_category) == ([2, 1, 0], [[0, 0], [9, 8], [0, 0]], [4, 3, 0])
    assert got[2].history_idx == got[3].history_idx == [0, 0] and got[3].history_tokens == [[0, 0], [0, 0]] and got[3].candidate_idx == []
    wide = E.example_table(imp, past, items, history_size=1).select("history_tokens").first()[0]
    assert len(wide[0]) == 3
