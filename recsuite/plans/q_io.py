"""Queries for sources/sinks (A) and scalar functions (H), plus the user-function hooks (Q-2, Q-3).

Round trips write a table derived from the test tables with one of our sinks into the shared scratch folder and
read it back with the matching source; the parsing operators then run on what was read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsuite.functions import lists as L
from recsuite.functions import text as H
from recsuite.operators import metrics as M
from recsuite.operators import sampling as S
from recsuite.plans.q_stats import _PHASE_SQL
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx
from recsuite.sources import io as IO

W = fx.with_views
sfl = L.sql_fmt_list
SEED = 42


def _scratch(spark, name):
    return IO.scratch_dir(spark, f"{name}_{uuid.uuid4().hex}")


@query("a1_scan_select", ("A1",), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def a1(spark, sf):
    """Parquet scan with column selection and a pushed-down filter."""
    return IO.scan(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus"]) \
        .filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("h1_h2_concat_join", ("H1", "H2"), W(
    """SELECT item_id, title || ' ' || category AS "title-category", array_to_string(topics, ' ') AS topics FROM items""", "items"))
def h1(spark, sf):
    """Null-propagating column concat named by the joined column names, and a list joined to text."""
    name, expr = H.concat_columns(["title", "category"])
    return fx.items(spark, sf).select("item_id", expr.alias(name), H.join_list("topics").alias("topics"))


@query("h3_j4_impression_log", ("H3", "J4", "A2", "A10"), W(
    """SELECT impression_id AS imp, 'U' || CAST(user_id AS VARCHAR) AS uid, 'N' || CAST(item_id AS VARCHAR) AS nid,
              CASE WHEN year(impression_time) >= 1998 THEN 0 ELSE label END AS click
       FROM candidates""", "candidates"))
def h3(spark, sf):
    """Behaviour log written as headerless TSV (``imp uid time history predict``; later impressions without
    flags, like a test split), read back by name, impressions parsed into interaction rows (missing flag = 0)."""
    imp = fx.impressions(spark, sf)
    flag = F.when(F.year("impression_time") >= 1998, F.lit(""))
    pred = F.transform("inview", lambda x: F.concat(F.lit("N"), x.cast("string"), F.coalesce(
        flag, F.concat(F.lit("-"), L.contains("clicked", x).cast("int").cast("string")))))
    raw = imp.select(F.col("impression_id").alias("imp"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("uid"),
                     F.date_format("impression_time", "MM/dd/yyyy").alias("time"),
                     F.transform("clicked", lambda x: F.concat(F.lit("N"), x.cast("string"))).alias("history"),
                     F.array_join(pred, " ").alias("predict"))
    path = _scratch(spark, "behaviors_tsv")
    IO.write_tsv(raw, path)
    back = IO.read_tsv(spark, path, ["imp", "uid", "time", "history", "predict"], usecols=["imp", "uid", "predict"])
    ex = back.select(F.col("imp").cast("bigint").alias("imp"), "uid", F.explode(H.parse_impressions("predict")).alias("p"))
    return ex.select("imp", "uid", F.col("p.item").alias("nid"), F.col("p.label").alias("click"))


@query("h4_a4_title_year", ("H4", "A4"), W(
    """SELECT i.item_id, i.title, CAST(year(f.first_seen) AS VARCHAR) AS year
       FROM items i JOIN (SELECT item_id, min(ts) AS first_seen FROM clicks WHERE item_id IS NOT NULL GROUP BY item_id) f
       ON i.item_id = f.item_id""", "items", "clicks"))
def h4(spark, sf):
    """Item file ``id|Name (year)|category`` written pipe-separated in Latin-1, read back, title and year split."""
    first = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("ts").alias("f"))
    it = fx.items(spark, sf).join(first, "item_id").select(
        F.col("item_id").cast("string").alias("mid"),
        F.concat("title", F.lit(" ("), F.year("f").cast("string"), F.lit(")")).alias("name"), "category")
    path = _scratch(spark, "items_latin1")
    it.write.mode("overwrite").option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    back = IO.read_tsv(spark, path, ["mid", "name", "category"], sep="|", encoding="ISO-8859-1")
    title, year = H.title_and_year("name")
    return back.select(F.col("mid").cast("bigint").alias("item_id"), title.alias("title"), year.alias("year"))


@query("a3_header_replaced", ("A3",), W("SELECT impression_id AS imp, user_id AS uid FROM impressions", "impressions"))
def a3(spark, sf):
    """TSV written with its own header, read with the header replaced by given names."""
    path = _scratch(spark, "header_tsv")
    fx.impressions(spark, sf).select(F.col("impression_id").alias("a"), F.col("user_id").alias("b")) \
        .write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    sch = T.StructType([T.StructField("imp", T.LongType()), T.StructField("uid", T.LongType())])
    return IO.read_tsv(spark, path, ["imp", "uid"], header=True, schema=sch)


@query("a5_ratings_tsv", ("A5",), W(
    "SELECT user_id, item_id, rating, CAST(epoch(ts) AS BIGINT) AS timestamp FROM ratings", "ratings"))
def a5(spark, sf):
    """Tab-separated ``uid mid rating timestamp`` file read with a typed schema."""
    r = fx.ratings(spark, sf).select("user_id", "item_id", "rating",
                                     F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"))
    path = _scratch(spark, "ratings_tsv")
    IO.write_tsv(r, path)
    sch = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()),
                        T.StructField("rating", T.IntegerType()), T.StructField("timestamp", T.LongType())])
    return IO.read_tsv(spark, path, [], schema=sch)


@query("a6_h9_jsonl_dates", ("A6", "H9"), W(
    """SELECT user_id, item_id AS book_id, CAST(epoch(ts) AS BIGINT) AS wall_clock, CAST(epoch(ts) AS BIGINT) + 8 * 3600 AS instant
       FROM ratings""", "ratings"))
def a6(spark, sf):
    """Interactions as JSON lines with ``date_added`` like ``Fri Dec 09 15:51:44 -0800 2016``, read with a schema
    and projection; dates parsed keeping the wall clock (reference) and as the true instant."""
    r = fx.ratings(spark, sf)
    ts = F.col("ts").cast("timestamp")
    date_added = F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss"), F.lit(" -0800 "), F.date_format(ts, "yyyy"))
    src = r.select("user_id", F.col("item_id").alias("book_id"), "rating", date_added.alias("date_added"))
    path = _scratch(spark, "interactions_jsonl")
    IO.write_json(src, path)
    back = IO.read_jsonl(spark, path, "user_id long, book_id long, rating int, date_added string",
                         ["user_id", "book_id", "date_added"])
    return back.select("user_id", "book_id", H.parse_web_date("date_added", True).alias("wall_clock"),
                       H.parse_web_date("date_added", False).alias("instant"))


@query("a7_reply_log_json", ("A7",), """
    SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END AS user_id, CAST(c_acctbal < 0 AS INTEGER) AS corrupt FROM customer""")
def a7(spark, sf):
    """JSON-lines reply log with malformed lines (accounts in debt write a cut-off line) read PERMISSIVE;
    malformed lines surface as ``_corrupt_record``."""
    c = fx.table(spark, sf, "customer")
    line = F.to_json(F.struct(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("interest")))
    line = F.when(F.col("c_acctbal") < 0, F.substring(line, 1, 10)).otherwise(line)
    path = _scratch(spark, "reply_jsonl")
    c.select(line.alias("value")).write.mode("overwrite").text(path)
    back = IO.read_reply_log_json(spark, path, "user_id long, interest string")
    return back.select("user_id", F.col("_corrupt_record").isNotNull().cast("int").alias("corrupt"))


@query("a9_list_literal", ("A9",), W("SELECT item_id, array_to_string(topics, '|') AS topics FROM items", "items"))
def a9(spark, sf):
    """Python list literals (``"['a', 'b']"``) parsed to arrays without eval."""
    lit = F.concat(F.lit("["), F.array_join(F.transform("topics", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    it = fx.items(spark, sf).select("item_id", lit.alias("raw"))
    return it.select("item_id", F.array_join(IO.parse_list_literal("raw"), "|").alias("topics"))


@query("a14_a15_submission_roundtrip", ("A14", "A15", "F3"), W(
    f"""SELECT impression_id, {sfl('list(rk ORDER BY pos)')} AS ranks FROM (
         SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rk FROM candidates)
       GROUP BY impression_id""", "candidates"))
def a14(spark, sf):
    """Submission file (gzip) of ranks per impression written and read back."""
    r = S.submission_ranks(fx.candidates(spark, sf), "impression_id")
    path = _scratch(spark, "submission")
    IO.write_submission(r, "impression_id", "ranks", path, compression="gzip")
    back = IO.read_submission(spark, path, "int")
    return back.select("impression_id", L.fmt_list("values").alias("ranks"))


@query("a17_phase_partitioned", ("A17", "A11", "F12"), W(
    f"SELECT c.impression_id, c.pos FROM candidates c JOIN ({_PHASE_SQL}) p ON c.impression_id = p.impression_id WHERE p.phase = 'test'",
    "candidates", "impressions"))
def a17(spark, sf):
    """Candidates written as one dataset partitioned by phase; reading the test phase prunes the partitions."""
    ph = S.weighted_split(fx.impressions(spark, sf), {"train": 8, "dev": 1, "test": 1}, SEED, "impression_id")
    c = fx.candidates(spark, sf).join(ph, "impression_id").select("impression_id", "pos", "phase")
    path = _scratch(spark, "phases")
    IO.write_parquet(c, path, partition_by="phase")
    return IO.read_phase(spark, path, "test").select("impression_id", "pos")


@query("a18_cached_filter", ("A18",), W("SELECT impression_id, pos FROM candidates WHERE label = 1 AND score >= 0.5",
                                        "candidates"))
def a18(spark, sf):
    """Filter result materialised under the key of its predicate set; the same set in another order reads it."""
    c = fx.candidates(spark, sf).select("impression_id", "pos", "label", "score")
    cache = _scratch(spark, "filter_cache")
    IO.cached_filter(c, ["label = 1", "score >= 0.5"], cache)
    again = IO.cached_filter(c, ["score >= 0.5", "label = 1"], cache)
    return again.select("impression_id", "pos")


@query("h6_concat_in_order", ("H6",), """
    SELECT conv_id, 'Conversation ' || string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def h6(spark, sf):
    """Texts of each conversation concatenated in turn order, with a fixed prefix."""
    t = H.concat_in_order(fx.table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return t.select("conv_id", H.prefix("text", "Conversation ").alias("text"))


@query("h7_id_parsing", ("H7",), "SELECT c_custkey AS user_id, 'U' || CAST(c_custkey AS VARCHAR) AS uid FROM customer")
def h7(spark, sf):
    """``FAKE{id}@{name}`` generated ids mapped back to user ids ``U{id}``."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"),
                                               F.concat(F.lit("FAKE"), F.col("c_custkey").cast("string"), F.lit("@"), "c_name").alias("fake"))
    return c.select("user_id", H.fake_to_user("fake").alias("uid"))


@query("h10_duration_text", ("H10",), W(
    """SELECT impression_id, printf('%d days %d:%d:%d', s // 86400, (s % 86400) // 3600, (s % 3600) // 60, s % 60) AS duration
       FROM (SELECT impression_id, CAST(epoch(impression_time) - epoch(TIMESTAMP '1995-01-01') + impression_id AS BIGINT) AS s FROM impressions)""",
    "impressions"))
def h10(spark, sf):
    """Elapsed time since 1995-01-01 (+ id seconds) as ``{d} days {h}:{m}:{s}``."""
    i = fx.impressions(spark, sf)
    s = F.unix_timestamp(F.col("impression_time").cast("timestamp")) - F.unix_timestamp(F.lit("1995-01-01 00:00:00").cast("timestamp")) \
        + F.col("impression_id")
    return i.select("impression_id", H.duration_text(s).alias("duration"))


@query("h13_clip_threshold", ("H13",), W(
    "SELECT impression_id, pos, least(greatest(score, 0.05), 0.95) AS clipped, CAST(score >= 0.5 AS INTEGER) AS pred FROM candidates",
    "candidates"))
def h13(spark, sf):
    """Scores clipped to [0.05, 0.95] and thresholded at 0.5."""
    return fx.candidates(spark, sf).select("impression_id", "pos", H.clip("score", 0.05, 0.95).alias("clipped"),
                                           H.threshold("score", 0.5).alias("pred"))


@query("h15_flatten_struct", ("H15", "H16"), W(
    """SELECT item_id, title, category AS "category-meta", subcategory AS "subcategory-deep-meta" FROM items""", "items"))
def h15(spark, sf):
    """A nested record (JSON round trip) flattened; leaves named child-...-parent."""
    it = fx.items(spark, sf)
    nested = it.select("item_id", "title", F.struct("category", F.struct("subcategory").alias("deep")).alias("meta"))
    js = nested.select(F.to_json(F.struct("*")).alias("j"))
    back = js.select(H.parse_json("j", "item_id long, title string, meta struct<category: string, deep: struct<subcategory: string>>").alias("r")).select("r.*")
    return H.flatten_struct(back)


@query("q2_pluggable_decay", ("Q-2",), W(
    f"SELECT impression_id, {sfl('list_transform(range(1, len(inview) + 1), lambda i: i / (len(inview) + 1))', 'double')} AS w FROM impressions",
    "impressions"))
def q2(spark, sf):
    """A user decay function i / (n + 1) evaluated per in-view list."""
    i = fx.impressions(spark, sf)
    return i.select("impression_id", L.fmt_list(L.custom_decay("inview", lambda k, n: k / (n + 1)), "double").alias("w"))


def _mean_positive_score(labels, scores):
    pos = scores[labels == 1]
    return float(np.mean(pos)) if len(pos) else float("nan")


@query("q3_pluggable_metric", ("Q-3",), W(
    "SELECT impression_id, round(avg(score) FILTER (WHERE label = 1), 6) AS mean_pos_score FROM candidates GROUP BY impression_id",
    "candidates"))
def q3(spark, sf):
    """A user metric (mean score of the positives) evaluated per list by a grouped-aggregate pandas UDF."""
    m = M.custom_list_metric(fx.candidates(spark, sf), _mean_positive_score, "mean_pos_score")
    return m.select("impression_id", F.round("mean_pos_score", 6).alias("mean_pos_score"))
