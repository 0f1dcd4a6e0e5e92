"""Inputs that once gave wrong rows, one test each."""

import pytest
from pyspark.sql import functions as F

from recsuite.operators import beyond as B
from recsuite.operators import history as HI
from recsuite.operators import labels as J
from recsuite.operators import lookup as LK
from recsuite.operators import prep as P
from recsuite.operators import prompts as PR
from recsuite.operators import sampling as S
from recsuite.operators import vectors as V
from recsuite.operators import vocab as VO
from recsuite.sources import io as IO


def test_list_literals_with_quotes(spark):
    cases = [("['a', 'b']", ["a", "b"]), ("[\"it's\", 'b']", ["it's", "b"]), ("['say \"x\"']", ['say "x"']),
             (r"['it\'s', 'a\\b']", ["it's", "a\\b"]), ("[]", []), ("[1, 2]", ["1", "2"]), ("['a', None]", ["a", None]),
             ("['x, y', '[z]']", ["x, y", "[z]"]), (None, None), ("text", None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r.i: r.v for r in df.select("i", IO.parse_list_literal("c").alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases]
    assert df.filter("i = 5").select(IO.parse_list_literal("c", "bigint")).first()[0] == [1, 2]


def test_first_k_keeps_null_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, 10, 1, None), (1, 11, 2, None), (1, 11, 2, None), (1, 12, 3, "x"), (2, 9, 1, "y")],
                               "user_id int, item_id int, ts int, note string")
    hist, rest = HI.first_k_history(df, 2)
    assert {r.user_id: r.history for r in hist.collect()} == {1: [10, 11], 2: [9]}
    assert sorted(r.item_id for r in rest.collect()) == [11, 12]


def test_history_versions_compare_arrays(spark):
    df = spark.createDataFrame([(1, 1, ["a,b"]), (1, 2, ["a", "b"]), (1, 3, ["null"]), (1, 4, [None]), (1, 5, None), (1, 6, ["a", "b"])],
                               "user_id int, impression_id int, history array<string>")
    got = {r.impression_id: r.uid_k for r in HI.history_versions(df).collect()}
    assert got == {1: "1_0", 2: "1_1", 3: "1_2", 4: "1_3", 5: "1_4", 6: "1_1"}


def test_content_alignment_keeps_field_bounds(spark):
    a = spark.createDataFrame([(1, "ab", "c"), (2, "x", None)], "id int, t string, s string")
    b = spark.createDataFrame([(7, "a", "bc"), (8, "ab", "c"), (9, "x", "")], "id int, t string, s string")
    assert sorted(map(tuple, LK.align_by_content(a, b, "id", ["t", "s"]).collect())) == [(1, 8), (2, 9)]


def test_tagged_reply_over_several_lines(spark):
    df = spark.createDataFrame([("[summarized_body] first line\nsecond line\n[description] d",), ("[description] only",)], "r string")
    got = [r.v for r in df.select(PR.parse_tagged("r", "summarized_body").alias("v")).collect()]
    assert got == ["first line\nsecond line", None]


def test_filter_cache_is_per_source(spark, tmp_path):
    for name, n in (("one", 5), ("two", 9)):
        spark.range(n).write.parquet(str(tmp_path / name))
    one, two = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "two"))
    cache = str(tmp_path / "cache")
    assert IO.cached_filter(one, ["id > 1"], cache).count() == 3
    assert IO.cached_filter(two, ["id > 1"], cache).count() == 7
    assert IO.cached_filter(one, ["id > 1"], cache).count() == 3
    with pytest.raises(ValueError):
        IO.cached_filter(spark.range(3), ["id > 1"], cache)


def test_tokenizers_are_told_apart_by_configuration():
    from functools import partial

    def build(n):
        return lambda text: [n]
    assert VO._worker_tokenizer(partial(build, 1))("x") == [1] and VO._worker_tokenizer(partial(build, 2))("x") == [2]


def test_random_lists_from_a_large_pool(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    got = S.random_lists(df, spark.range(150_000).withColumnRenamed("id", "item_id"), 5, 1, "k").collect()
    assert len(got) == 20 and all(len(set(r.ranked)) == 5 for r in got)
    small = S.random_lists(df, spark.range(3).withColumnRenamed("id", "item_id"), 5, 1, "k").collect()
    assert all(sorted(r.ranked) == [0, 1, 2] for r in small)


def test_negatives_outside_several_attributes(spark):
    items = spark.range(4000).select(F.col("id").alias("item_id"), (F.col("id") % 37).alias("category"), (F.col("id") % 11).alias("c"))
    hist = spark.createDataFrame([(1, [0, 5]), (2, [7])], "user_id int, history array<bigint>")
    got = {r.user_id: r.neg for r in J.negatives_outside_taste(hist, items, 3, attr=["category", "c"]).collect()}
    for u, own in ((1, (0, 5)), (2, (7,))):
        assert 21 <= len(got[u]) == len(set(got[u])) <= 25
        assert all(x % 37 not in {o % 37 for o in own} and x % 11 not in {o % 11 for o in own} for x in got[u])


def test_centres_in_blocks_give_the_same_rows(spark):
    v = spark.range(50).select(F.col("id").alias("k"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("v"))
    c = spark.range(9).select(F.col("id").cast("int").alias("cluster"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("centre"))
    for op in (lambda b: V.assign_nearest(v, "v", c, block_bytes=16 * b).select("k", "cluster", "dist"),
               lambda b: V.distance_matrix(v, "k", "v", c, block_bytes=16 * b)):
        assert sorted(map(tuple, op(100).collect())) == sorted(map(tuple, op(4).collect()))


def test_unknown_codes_are_named(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "c int")
    assert [r[0] for r in df.select(P.decode_codes("c", {1: "one"}, "Unknown")).collect()] == ["one", "Unknown", None]


def test_last_n_stream_orders_rows_across_arrow_batches(spark, tmp_path):
    from recsuite.streaming import streams as ST
    df = spark.range(2000).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("event_id"),
                                  F.timestamp_seconds(F.col("id")).alias("ts")).orderBy(F.rand(3)).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        s = ST.event_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema)
        out = spark.read.parquet(ST.run_to_parquet(ST.last_n_history_stream(s, 3), "p2_batches"))
        assert all(r.history == list(range(max(0, r.event_id - 3), r.event_id)) for r in out.collect()) and out.count() == 2000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filter_cache_sees_a_replaced_file(spark, tmp_path):
    import os
    import shutil
    table, cache = str(tmp_path / "t"), str(tmp_path / "cache")
    spark.range(5).coalesce(1).write.parquet(table)
    name = next(f for f in os.listdir(table) if f.endswith(".parquet"))
    assert IO.cached_filter(spark.read.parquet(table), ["id > 1"], cache).count() == 3
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "other"))
    new = next(f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet"))
    shutil.copyfile(tmp_path / "other" / new, f"{table}/{name}")
    crc = f"{table}/.{name}.crc"
    shutil.copyfile(tmp_path / "other" / f".{new}.crc", crc)
    assert IO.cached_filter(spark.read.parquet(table), ["id > 1"], cache).count() == 48


def test_filter_cache_heals_a_half_written_entry(spark, tmp_path):
    import os
    table, cache = str(tmp_path / "t"), str(tmp_path / "cache")
    spark.range(5).write.parquet(table)
    df = spark.read.parquet(table)
    path = os.path.join(cache, IO.predicate_key(["id > 1"], IO.source_identity(df)), "data")
    os.makedirs(path)
    open(os.path.join(path, "part-0.parquet"), "w").close()  # what a dying writer leaves
    assert IO.cached_filter(df, ["id > 1"], cache).count() == 3
    assert IO.cached_filter(df.filter("id >= 0"), ["id > 1"], cache).count() == 3  # another plan over the same files


def test_training_set_knows_no_later_click(spark):
    import datetime as dt
    day = lambda d: dt.datetime(1998, 1, d)
    clicks = spark.createDataFrame([(1, 10, day(1)), (1, 11, day(5)), (2, 12, day(2))], "user_id int, item_id int, ts timestamp")
    seen = spark.createDataFrame([(100, 1, day(2), [7, 11], [11]), (101, 1, day(6), [8, 9], [8]), (102, 3, day(7), [1, 2], [2])],
                                 "impression_id int, user_id int, impression_time timestamp, inview array<int>, clicked array<int>")
    got = {r.impression_id: r.history for r in J.training_set(seen, clicks, "1998-01-06", 10, 1, 42).collect()}
    assert got == {101: [10, 11], 102: None}


def test_model_pages_are_bounded(spark, tmp_path):
    class CountingModel:  # local, so workers need not import this file
        def __call__(self, texts):
            assert len(texts) <= 3 and (len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 10)
            return [[len(t), 1.0] for t in texts]

    texts = ["a", "bb", "", None, "x" * 50, "cccc", "dddd", "é", "e", "f", "g", "h"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, `a.text` string").withColumnRenamed("a.text", "text").coalesce(1)
    t = V.embedding_table(df, "id", "text", str(tmp_path / "v"), model_factory=CountingModel, page_bytes=10, page_rows=3)
    assert {r.id: r.text_vector for r in t.collect()} == {i: None if x is None else [len(x), 1.0] for i, x in enumerate(texts)}
    wide = V.embed_texts(df.withColumn("b.c", F.lit(1)), "text", model_factory=CountingModel, page_bytes=10, page_rows=3)
    assert wide.columns == ["id", "text", "b.c", "text_vector"] and wide.count() == len(texts)


def test_pca_equals_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(0)
    x = rnd.normal(0, 1, (80, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 7
    got = V.pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>"), "v", 3)
    c = x - x.mean(axis=0)
    plain = c @ np.linalg.svd(c, full_matrices=False)[2][:3].T
    rows = np.array([r.pca for r in got.orderBy("i").collect()])
    assert np.allclose(np.abs(rows), np.abs(plain), atol=1e-8)


def test_subset_mode_is_the_callers_choice(spark):
    from recsuite.operators import beyond as B
    assert B.candidate_subsets(spark, 6, 2, 1, "all").select("subset_id").distinct().count() == 15
    assert B.candidate_subsets(spark, 6, 2, 1, "sample", 40).select("subset_id").distinct().count() == 40
    with pytest.raises(ValueError):
        B.candidate_subsets(spark, 6, 2, 1, "auto")


def test_bounds_over_all_subsets_make_no_row_per_subset(spark, monkeypatch):
    import itertools
    import random

    rnd = random.Random(3)
    vec = {i: [rnd.gauss(0, 1) for _ in range(4)] for i in range(11)}
    rows = [*vec.items(), (4, [1.0, 0.0, 0.0, 2.0]), (12, [0.0] * 4)]  # one key twice, one zero vector
    items = spark.createDataFrame(rows, "item_id int, embedding array<double>")
    cand = spark.createDataFrame([(i,) for i in [*vec, 12, 3, 99]], "item_id int")

    def diversity(keys):
        u = [[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for i, v in rows if i in keys]
        pairs = [1 - sum(a * b for a, b in zip(p, q)) for p, q in itertools.permutations(u, 2)]
        return max(0.0, sum(pairs) / len(pairs))

    def no_rows(*a):
        raise AssertionError("combinations became rows")

    monkeypatch.setattr(B, "candidate_subsets", no_rows)
    for k, cells in ((2, 1 << 20), (3, 1 << 20), (3, 30), (4, 20)):
        monkeypatch.setattr(B, "CELLS", cells)
        brute = [diversity(s) for s in itertools.combinations([*vec, 12], k)]
        got = B.candidate_diversity_bounds(cand, items, k, 1).first()
        assert tuple(got) == pytest.approx((min(brute), max(brute)), abs=1e-9)
    with pytest.raises(ValueError):
        B.candidate_diversity_bounds(cand, items, 13, 1)


def test_negatives_outside_taste_carry_no_ranges(spark, monkeypatch):
    """The rows that are joined and grouped hold values of the taste, not a range for every combination with them; NULL values
    exclude nothing, and picks are positions among the allowed items in catalogue order."""
    import hashlib

    rows = [(i, None if i % 13 == 0 else f"c{i % 7}", None if i % 17 == 0 else i % 5) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id bigint, category string, c int")
    hist = {1: [3, 13], 2: [17, 221], 3: [1, 2, 3, 4, 5, 6, 7], 4: [9999]}
    h = spark.createDataFrame(list(hist.items()), "user_id bigint, history array<bigint>")
    shuffled = []
    real = J._value_ranges

    def watched(ranges, codes, i):
        shuffled.append(codes[i])
        return real(ranges, codes, i)

    monkeypatch.setattr(J, "_value_ranges", watched)
    got = {r.user_id: r.neg for r in J.negatives_outside_taste(h, items, 5, attr=["category", "c"]).collect()}
    assert shuffled == ["_c0", "_c1"]
    first = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", first(r[2]), r[0]))
    draw = lambda *k: int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:8], 16)
    for u, own in hist.items():
        seen = [r for r in rows if r[0] in own]
        cats, cs = {r[1] for r in seen} - {None}, {r[2] for r in seen} - {None}
        allowed = [r[0] for r in order if r[1] not in cats and r[2] not in cs]
        want = 20 + draw(5, u, "n") % 5 + 1
        for k in range(min(want, len(allowed))):
            j = k + draw(5, u, k) % (len(allowed) - k)
            allowed[k], allowed[j] = allowed[j], allowed[k]
        assert got.get(u, []) == allowed[:want]


def test_partitions_of_orders_grow_with_the_lines(spark, monkeypatch, tmp_path):
    from recsuite.sources import fixtures as fx

    spark.range(400).selectExpr("id % 90 AS l_orderkey", "id AS l_partkey", "if(id % 3 = 0, 'R', 'N') AS l_returnflag") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(90).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "date'1998-01-01' AS o_orderdate") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    few = sorted(map(str, fx.impressions(spark, str(tmp_path)).collect()))
    li = fx.table(spark, str(tmp_path), "lineitem")
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(fx, "ORDER_ROWS", 10)
    assert fx._by_order(li).rdd.getNumPartitions() == 40 > own
    assert sorted(map(str, fx.impressions(spark, str(tmp_path)).collect())) == few and len(few) == 90
