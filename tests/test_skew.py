"""A hot key holding ~40 % of all rows: the skew-safe helpers give the exact single-window answers while the hot
group is spread over several partitions (no task holds it whole)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from recsuite.operators import common as CO
from recsuite.operators import history as HI


def _skewed(spark, n=20000):
    # user 0 owns 40 % of the rows, the rest spread over 500 users
    return spark.range(n).select(
        F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("user_id"),
        (F.col("id") * 7919 % 10007).alias("ts"), F.col("id").alias("item_id"))


def test_row_number_per_group_spreads_hot_group(spark):
    df = _skewed(spark)
    got = CO.row_number_per_group(df, ["user_id"], ["ts", "item_id"], "rn", partitions=16)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "item_id")))
    assert sorted(map(tuple, got.select("item_id", "rn").collect())) == sorted(map(tuple, ref.select("item_id", "rn").collect()))
    spread = (df.repartitionByRange(16, "user_id", "ts", "item_id").filter("user_id = 0")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert spread >= 4


def test_top_n_and_first_per_key_on_hot_group(spark):
    df = _skewed(spark)
    top = CO.top_n_per_group(df, ["user_id"], [F.col("ts").desc(), F.col("item_id")], 5, salt_buckets=16)
    ref = df.withColumn("_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "item_id"))) \
        .filter("_rank <= 5")
    cols = ["user_id", "item_id", "_rank"]
    assert sorted(map(tuple, top.select(*cols).collect())) == sorted(map(tuple, ref.select(*cols).collect()))
    first = CO.first_per_key(df, "user_id", ["ts", "item_id"], ["item_id"])
    asc = df.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "item_id"))).filter("r = 1")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, asc.select("user_id", "item_id").collect()))


def test_dynamic_history_on_hot_user_with_extra_columns(spark):
    df = _skewed(spark, 100_000).withColumn("extra", F.concat(F.lit("x"), F.col("item_id").cast("string")))
    one = df.withColumn("user_id", F.lit(1))
    for d in (df, one):
        got = HI.dynamic_history(d, 4, tiebreak=["item_id"], out="h")
        w = Window.partitionBy("user_id").orderBy("ts", "item_id").rowsBetween(-4, -1)
        want = d.withColumn("h", F.collect_list("item_id").over(w))
        assert set(got.columns) == set(want.columns) and got.count() == want.count()
        assert got.select(*want.columns).exceptAll(want).isEmpty()


def test_numbering_above_the_range_sample(spark):
    """Rows far above the sample that range bounds are drawn from, with columns that are not part of the order."""
    df = spark.range(60_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("g"),
                                    F.repeat(F.lit("pad"), 20).alias("pad"), F.col("id").alias("other"))
    df = df.withColumn("g", F.when(F.col("other") % 3 == 0, F.lit(None)).otherwise(F.col("g")))
    for aqe in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        try:
            got = CO.dense_index(df, ["k"], "i")
            want = df.withColumn("i", F.row_number().over(Window.orderBy("k")) - 1)
            assert got.agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()[:] == (60_000, 60_000, 0, 59_999)
            assert got.withColumn("i", F.col("i").cast("int")).exceptAll(want.select(*got.columns)).isEmpty()
            got = CO.row_number_per_group(df, ["g"], ["k"], "rn")
            want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("bigint"))
            assert got.count() == 60_000 and got.select(*want.columns).exceptAll(want).isEmpty()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
