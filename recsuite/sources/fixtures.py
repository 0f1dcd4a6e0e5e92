"""Recommendation-shaped views over the driver's TPC-H-ish test tables.

These only rename and reshape the given tables into the schemas the operators expect (behaviour log with
in-view / clicked lists, flat scored candidates, click log, ratings, item catalogue, item vectors); they do none
of an operator's work.  Each Spark view has a DuckDB twin in ``SQL_VIEWS`` so the oracle runs on the same rows.

| view | definition |
|---|---|
| impressions | lineitem grouped per order: in-view = sorted distinct parts, clicked = parts with return flag R |
| candidates | impressions exploded with position; label = clicked; score = ((item*7919 + imp*104729) % 11) / 10 |
| clicks | distinct (customer, part or NULL on line 7, order date) |
| ratings | distinct (customer, part, quantity % 5 + 1, order date) |
| items | part: name, brand, type, name words, size % 5 <> 0, (size % 3) / 2, line count |
| item_vectors | embeddings: vec_id as item id |
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ORDER_ROWS = 500_000  # lines of a shuffle partition


def _by_order(li: DataFrame) -> DataFrame:
    """Lines partitioned by order: into Spark's own number of partitions, or more if a partition would get more than
    ``ORDER_ROWS`` lines, so a task's share does not grow with the table (the count reads the files' footers only)."""
    own = int(li.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-li.count() // ORDER_ROWS)
    return li.repartition(wanted, "l_orderkey") if wanted > own else li.repartition("l_orderkey")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hash-partition lines by order first: collect_set gains little from map-side combining, and this way the
    # collection runs in every shuffle partition (one shuffle either way); the join then sees one row per order
    li = _by_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"))
    per_order = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_partkey")).alias("inview"),
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias("clicked"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return per_order.join(o, per_order.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("impression_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("impression_time"),
        "inview",
        "clicked",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    imp = impressions(spark, sf_dir)
    return imp.select(
        "impression_id", "user_id", "impression_time", "clicked", F.posexplode("inview").alias("pos", "item_id")
    ).select(
        "impression_id", "user_id", "impression_time",
        F.col("pos").cast("bigint").alias("pos"),
        "item_id",
        F.coalesce(F.array_contains("clicked", F.col("item_id")), F.lit(False)).cast("int").alias("label"),
        (((F.col("item_id") * 7919 + F.col("impression_id") * 104729) % 11) / 10).alias("score"),
    )


def _lines_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_orders(spark, sf_dir).select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_partkey")).alias("item_id"),
        F.col("o_orderdate").alias("ts"),
    ).distinct()


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_orders(spark, sf_dir).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("rating"),
        F.col("o_orderdate").alias("ts"),
    ).distinct()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    views = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return p.join(views, p.p_partkey == views.l_partkey, "left").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("subcategory"),
        F.split("p_name", " ").alias("topics"),
        (F.col("p_size") % 5 != 0).alias("has_image"),
        ((F.col("p_size") % 3) / 2.0).cast("double").alias("sentiment_score"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("total_pageviews"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


VIEWS = {
    "impressions": impressions,
    "candidates": candidates,
    "clicks": clicks,
    "ratings": ratings,
    "items": items,
    "item_vectors": item_vectors,
}


# --------------------------------------------------------------------------------------------------------------
# DuckDB twins.  Each entry: (dependencies, body).  ``with_views`` prepends the needed CTEs in dependency order.
# --------------------------------------------------------------------------------------------------------------
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "impressions": ((), """
        SELECT l_orderkey AS impression_id, o_custkey AS user_id, o_orderdate AS impression_time,
               list_sort(list(DISTINCT l_partkey)) AS inview,
               coalesce(list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R')), []::BIGINT[]) AS clicked
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, o_custkey, o_orderdate"""),
    "candidates": (("impressions",), """
        SELECT impression_id, user_id, impression_time, pos, item_id,
               CAST(coalesce(list_contains(clicked, item_id), false) AS INTEGER) AS label,
               ((item_id * 7919 + impression_id * 104729) % 11) / 10 AS score
        FROM (SELECT impression_id, user_id, impression_time, clicked,
                     CAST(generate_subscripts(inview, 1) - 1 AS BIGINT) AS pos, unnest(inview) AS item_id
              FROM impressions)"""),
    "clicks": ((), """
        SELECT DISTINCT o_custkey AS user_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS item_id,
               o_orderdate AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "ratings": ((), """
        SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS INTEGER) % 5 + 1 AS rating,
               o_orderdate AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "items": ((), """
        SELECT p_partkey AS item_id, p_name AS title, p_brand AS category, p_type AS subcategory,
               string_split(p_name, ' ') AS topics, p_size % 5 <> 0 AS has_image,
               CAST((p_size % 3) / 2.0 AS DOUBLE) AS sentiment_score,
               CAST(coalesce(v.n_lines, 0) AS BIGINT) AS total_pageviews
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey) v
             ON p_partkey = v.l_partkey"""),
    "item_vectors": ((), "SELECT vec_id AS item_id, embedding FROM embeddings"),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in SQL_VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views (plus ``extra`` CTEs, in given order)."""
    ctes = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in _order(names)]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v})")
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return ("WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]) if ctes else body
    if body[:5].upper() == "WITH ":
        # merge a query's own CTE list into ours
        return ("WITH " + ",\n".join(ctes) + ",\n" + body[5:]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql


@lru_cache(maxsize=None)
def view_names() -> tuple[str, ...]:
    return tuple(VIEWS)
