"""Queries for filters, set operations, lookups and histories (B, G, C, E, J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.operators import history as H
from recsuite.operators import lookup as LK
from recsuite.operators import prep as P
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx

W = fx.with_views
sfl = L.sql_fmt_list
DAY = "yyyy-MM-dd"


def _day(c):
    return F.date_format(c, DAY)


# ---- B ------------------------------------------------------------------------------------------------------------
@query("b1_b2_rename_keep", ("B1", "B2"), "SELECT p_partkey AS item_id, p_name AS title FROM part")
def b1_b2(spark, sf):
    """Lenient rename (missing names ignored), strict rename and strict keep of the id + one column."""
    p = P.rename_lenient(fx.table(spark, sf, "part"), {"p_partkey": "item_id", "no_such_column": "x"})
    p = P.rename_strict(p, {"p_name": "title"}, id_col="item_id")
    return P.keep_strict(p, ["title"], id_col="item_id")


@query("b6_min_value", "B6", "SELECT event_id FROM events WHERE value >= 50")
def b6(spark, sf):
    """Rows whose value passes a cutoff (read-time style) over the event log."""
    return P.min_value(fx.table(spark, sf, "events"), "value", 50).select("event_id")


@query("b7_non_empty_text", "B7", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0")
def b7(spark, sf):
    """Documents with non-empty text."""
    return P.non_empty_text(fx.table(spark, sf, "documents"), "text").select(
        "doc_id", F.length("text").cast("bigint").alias("n"))


@query("b8_null_unless_in", "B8", W(
    """SELECT impression_id, pos, CASE WHEN item_id IN (SELECT item_id FROM item_vectors) THEN item_id END AS item_id
       FROM candidates""", "candidates", "item_vectors"))
def b8(spark, sf):
    """Candidate item ids without a vector set to NULL (rows kept)."""
    c = fx.candidates(spark, sf).select("impression_id", "pos", "item_id")
    return P.null_unless_in(c, "item_id", fx.item_vectors(spark, sf), "item_id")


@query("b19_prune_unknown_ids", ("B19", "B9"), W(
    f"""SELECT i.impression_id, CASE WHEN k.kept IS NULL THEN '' ELSE {sfl('k.kept')} END AS kept
        FROM impressions i LEFT JOIN (
          SELECT impression_id, list(item_id ORDER BY pos) AS kept FROM candidates
          WHERE item_id IN (SELECT item_id FROM item_vectors) GROUP BY impression_id) k
        ON i.impression_id = k.impression_id""", "impressions", "candidates", "item_vectors"))
def b19(spark, sf):
    """Keep only catalogue-known ids in each list (any-size id table; emptied -> [])."""
    i = fx.impressions(spark, sf).select("impression_id", "inview")
    out = P.keep_list_elements_in(i, "inview", fx.item_vectors(spark, sf), "item_id", "impression_id",
                                  empty_as_null=False)
    return out.select("impression_id", L.fmt_list("inview").alias("kept"))


@query("b12_config_filter", ("B12", "Q-5"), W(
    "SELECT impression_id FROM impressions WHERE len(inview) > 0 AND len(clicked) >= 1 "
    "AND impression_time >= TIMESTAMP '1998-01-01'", "impressions"))
def b12(spark, sf):
    """Configured predicate strings: 'x' = non-empty, column predicates with x, and a whole-row predicate."""
    i = fx.impressions(spark, sf)
    return P.filter_expr(i, {"inview": ["x"], "clicked": ["size(x) >= 1"]},
                         row=["impression_time >= TIMESTAMP '1998-01-01'"]).select("impression_id")


@query("b13_allow_list", ("B13", "C13"), W(
    "SELECT impression_id, pos FROM candidates WHERE item_id IN (SELECT item_id FROM item_vectors)",
    "candidates", "item_vectors"))
def b13(spark, sf):
    """Candidates restricted to an allow-list of ids (left semi join)."""
    return P.allow_list(fx.candidates(spark, sf), fx.item_vectors(spark, sf), "item_id").select("impression_id", "pos")


@query("b14_positives_only", "B14", W("SELECT impression_id, pos FROM candidates WHERE label = 1", "candidates"))
def b14(spark, sf):
    """Positive rows only."""
    return P.positives_only(fx.candidates(spark, sf)).select("impression_id", "pos")


@query("b15_binarize_ratings", "B15", W(
    "SELECT user_id, item_id, strftime(ts, '%Y-%m-%d') AS day, CAST(rating > 3 AS INTEGER) AS label "
    "FROM ratings WHERE rating <> 3", "ratings"))
def b15(spark, sf):
    """Drop neutral ratings (3); above 3 is positive."""
    r = P.binarize_ratings(fx.ratings(spark, sf))
    return r.select("user_id", "item_id", _day("ts").alias("day"), "label")


@query("b16_users_both_classes", "B16", W(
    "SELECT user_id FROM ratings WHERE rating <> 3 GROUP BY user_id "
    "HAVING max(CAST(rating > 3 AS INTEGER)) = 1 AND min(CAST(rating > 3 AS INTEGER)) = 0", "ratings"))
def b16(spark, sf):
    """Users with both positive and negative ratings."""
    return P.users_with_both_classes(P.binarize_ratings(fx.ratings(spark, sf)))


@query("b17_known_user_flag", "B17", W(
    """SELECT impression_id, CAST(user_id IN (SELECT user_id FROM impressions WHERE impression_time < TIMESTAMP '1998-01-01') AS INTEGER) AS is_known
       FROM impressions WHERE impression_time >= TIMESTAMP '1998-01-01'""", "impressions"))
def b17(spark, sf):
    """Later impressions flagged by whether the user appears in the earlier period."""
    i = fx.impressions(spark, sf)
    early = i.filter(F.col("impression_time") < "1998-01-01")
    late = i.filter(F.col("impression_time") >= "1998-01-01").select("impression_id", "user_id")
    return P.known_flag(late, early).select("impression_id", F.col("is_known").cast("int").alias("is_known"))


@query("b18_generated_flag", "B18", W(
    """SELECT user_id, CAST(max(CASE WHEN item_id IN (SELECT item_id FROM benchmark) THEN 1 ELSE 0 END) AS INTEGER) AS has_generated
       FROM clicks GROUP BY user_id""", "clicks"))
def b18(spark, sf):
    """Per user: does the click log hold any item of the generated-item table (``benchmark`` ids)."""
    g = P.generated_flag(fx.clicks(spark, sf), fx.table(spark, sf, "benchmark"))
    return g.select("user_id", F.col("has_generated").cast("int").alias("has_generated"))


@query("b20_admissible_items", "B20", W("SELECT item_id FROM items WHERE trim(title) <> ''", "items"))
def b20(spark, sf):
    """Catalogue items with a non-blank title."""
    return P.admissible_items(fx.items(spark, sf)).select("item_id")


@query("b21_split_by_flag", "B21", W(
    "SELECT 'with' AS part, count(*) AS n FROM items WHERE has_image UNION ALL "
    "SELECT 'without' AS part, count(*) AS n FROM items WHERE NOT coalesce(has_image, false)", "items"))
def b21(spark, sf):
    """Boolean partition of the catalogue into two views, counted."""
    a, b = P.split_by_flag(fx.items(spark, sf), "has_image")
    return a.agg(F.count(F.lit(1)).alias("n")).select(F.lit("with").alias("part"), "n").unionByName(
        b.agg(F.count(F.lit(1)).alias("n")).select(F.lit("without").alias("part"), "n"))


@query("b22_fill_constants", "B22", W(
    """SELECT i.item_id, coalesce(c.n_clicks, 1) AS n_clicks, coalesce(b.text, '') AS caption
       FROM items i LEFT JOIN (SELECT item_id, count(*) AS n_clicks FROM clicks GROUP BY item_id) c ON i.item_id = c.item_id
       LEFT JOIN benchmark b ON i.item_id = b.item_id""", "items", "clicks"))
def b22(spark, sf):
    """Counters NULL -> 1 and captions NULL -> '' after left joins."""
    i = fx.items(spark, sf).select("item_id")
    c = fx.clicks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_clicks"))
    b = fx.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("caption"))
    j = i.join(c, "item_id", "left").join(b, "item_id", "left")
    return P.fill_constants(j, {"n_clicks": 1, "caption": ""})


@query("b23_fold_categories", ("B23", "I10"), W(
    "SELECT item_id, CASE WHEN category IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'other' ELSE category END AS category "
    "FROM items", "items"))
def b23(spark, sf):
    """Listed categories folded into one bucket."""
    return fx.items(spark, sf).select(
        "item_id", P.fold_categories("category", ["Brand#1", "Brand#2", "Brand#3"], "other").alias("category"))


# Fixed values of the reference: postcode class names by code.
POSTCODE_NAMES = {0: "metropolitan", 1: "rural district", 2: "municipality", 3: "provincial", 4: "big city"}


@query("b24_decode_codes", "B24", """
    SELECT c_custkey AS user_id,
           CASE c_nationkey % 6 WHEN 0 THEN 'metropolitan' WHEN 1 THEN 'rural district' WHEN 2 THEN 'municipality'
                WHEN 3 THEN 'provincial' WHEN 4 THEN 'big city' ELSE 'Unknown' END AS postcode,
           CASE WHEN c_acctbal < 0 THEN 'Male' ELSE 'Female' END AS gender
    FROM customer""")
def b24(spark, sf):
    """Integer codes decoded to text (code = nation key % 6; code 5 is unknown -> 'Unknown')."""
    c = fx.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("user_id"),
                    P.decode_codes(F.col("c_nationkey") % 6, POSTCODE_NAMES, "Unknown").alias("postcode"),
                    P.decode_codes((F.col("c_acctbal") >= 0).cast("int"), {0: "Male", 1: "Female"}).alias("gender"))


@query("b25_cold_users", "B25", W(
    """SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, item_id FROM clicks WHERE item_id IS NOT NULL)
       GROUP BY user_id HAVING count(*) BETWEEN 1 AND 5""", "clicks"))
def b25(spark, sf):
    """Users whose history (distinct clicked items) has 1..5 items."""
    h = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("user_id").agg(
        F.collect_set("item_id").alias("history"))
    return P.cold_users(h, "history", 5).select("user_id", F.size("history").cast("bigint").alias("n"))


@query("b26_rows_at_min_length", "B26", W(
    "SELECT impression_id FROM impressions WHERE len(inview) = (SELECT min(len(inview)) FROM impressions)", "impressions"))
def b26(spark, sf):
    """Impressions whose list length equals the minimum."""
    return P.rows_at_min_length(fx.impressions(spark, sf), "inview").select("impression_id")


@query("b27_checks", "B27", W(
    "SELECT impression_id, CAST(len(inview) AS BIGINT) AS n FROM impressions", "impressions"))
def b27(spark, sf):
    """Required-column check (plan time) and equal-length check of in-view vs labels (one aggregate job)."""
    i = P.check_columns(fx.impressions(spark, sf), ["impression_id", "inview", "clicked"])
    i = i.withColumn("labels", L.binary_labels())
    i = P.check_equal_lengths(i, "inview", "labels")
    return i.select("impression_id", F.size("inview").cast("bigint").alias("n"))


# ---- G --------------------------------------------------------------------------------------------------------------
@query("g1_distinct_ids", "G1", W(
    "SELECT DISTINCT x AS id FROM (SELECT unnest(inview) AS x FROM impressions UNION ALL "
    "SELECT unnest(clicked) FROM impressions) WHERE x IS NOT NULL", "impressions"))
def g1(spark, sf):
    """All distinct item ids over the in-view and clicked lists."""
    return P.distinct_ids(fx.impressions(spark, sf), None, ["inview", "clicked"])


@query("g2_concat_keep_first", "G2", W(
    """SELECT user_id, arg_min(impression_id, (split, impression_id)) AS impression_id FROM (
         SELECT 0 AS split, user_id, impression_id FROM impressions WHERE impression_time >= TIMESTAMP '1998-01-01'
         UNION ALL SELECT 1 AS split, user_id, impression_id FROM impressions) GROUP BY user_id""", "impressions"))
def g2(spark, sf):
    """Concatenate two splits and keep the first row per user (split order, then impression order)."""
    i = fx.impressions(spark, sf).select("user_id", "impression_id", "impression_time")
    parts = [i.filter(F.col("impression_time") >= "1998-01-01").drop("impression_time"), i.drop("impression_time")]
    return P.concat_keep_first(parts, "user_id", "impression_id")


@query("g3_diagonal_concat", "G3", W(
    """SELECT source, count(*) AS n, count(title) AS n_title, count(text) AS n_text FROM (
         SELECT 'items' AS source, item_id, title, NULL AS text FROM items
         UNION ALL SELECT 'benchmark', item_id, NULL, text FROM benchmark) GROUP BY source""", "items"))
def g3(spark, sf):
    """Union by name with missing columns NULL, tagged with the source."""
    u = P.diagonal_concat({"items": fx.items(spark, sf).select("item_id", "title"),
                           "benchmark": fx.table(spark, sf, "benchmark").select("item_id", "text")})
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("n_title"),
                                   F.count("text").alias("n_text"))


_WORDS_ITEMS = "SELECT DISTINCT unnest(topics) AS w FROM items"
_WORDS_BENCH = "SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark"
_WORDS_B1 = "SELECT DISTINCT unnest(topics) AS w FROM items WHERE category = 'Brand#1'"
_WORDS_B2 = "SELECT DISTINCT unnest(topics) AS w FROM items WHERE category = 'Brand#2'"


@query("g4_set_difference", "G4", W(
    f"SELECT 'a_not_b' AS side, w FROM ({_WORDS_ITEMS} EXCEPT {_WORDS_BENCH}) UNION ALL "
    f"SELECT 'b_not_a', w FROM ({_WORDS_BENCH} EXCEPT {_WORDS_ITEMS})", "items"))
def g4(spark, sf):
    """Tags (title words) of the catalogue not in the benchmark texts, and the other way round."""
    a = fx.items(spark, sf).select(F.explode("topics").alias("w")).distinct()
    b = fx.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return P.set_difference(a, b).select(F.lit("a_not_b").alias("side"), "w").unionByName(
        P.set_difference(b, a).select(F.lit("b_not_a").alias("side"), "w"))


@query("g5_intersection", "G5", W(f"{_WORDS_B1} INTERSECT {_WORDS_B2}", "items"))
def g5(spark, sf):
    """Title words used in both of two categories."""
    it = fx.items(spark, sf)
    a = it.filter(F.col("category") == "Brand#1").select(F.explode("topics").alias("w"))
    b = it.filter(F.col("category") == "Brand#2").select(F.explode("topics").alias("w"))
    return P.intersection(a, b)


@query("g6_g7_append_with_offset", ("G6", "G7"), W(
    """SELECT impression_id, user_id FROM impressions WHERE impression_time < TIMESTAMP '1998-01-01'
       UNION ALL SELECT impression_id + (SELECT max(impression_id) FROM impressions WHERE impression_time < TIMESTAMP '1998-01-01'),
                        user_id FROM impressions WHERE impression_time >= TIMESTAMP '1998-01-01'""", "impressions"))
def g6(spark, sf):
    """Append the later split with its key shifted by the max key of the earlier split."""
    i = fx.impressions(spark, sf).select("impression_id", "user_id", "impression_time")
    a = i.filter(F.col("impression_time") < "1998-01-01").drop("impression_time")
    b = i.filter(F.col("impression_time") >= "1998-01-01").drop("impression_time")
    return P.append_with_offset(a, b, "impression_id")


@query("g8_reset_index", ("G8", "G11"), W(
    "SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS idx FROM item_vectors", "item_vectors"))
def g8(spark, sf):
    """Dense 0..n-1 ids after filtering, in old-id order (range partitions + per-partition offsets)."""
    return P.reset_index(fx.item_vectors(spark, sf).select("item_id"), "item_id", "idx")


@query("g12_merge_generated_items", "G12", W(
    """WITH gen AS (SELECT item_id AS gen_order, (item_id % (SELECT count(*) FROM customer)) + 1 AS user_id,
                           text AS title, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark),
            mx AS (SELECT max(item_id) AS m FROM items),
            newid AS (SELECT gen.*, (SELECT m FROM mx) + 1 + i AS item_id FROM gen),
            hist AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS history FROM clicks WHERE item_id IS NOT NULL GROUP BY user_id),
            add AS (SELECT user_id, list(item_id ORDER BY gen_order) AS a FROM newid GROUP BY user_id)
       SELECT h.user_id, CAST(len(h.history) AS BIGINT) AS n_before,
              array_to_string(list_transform(list_concat(h.history, coalesce(a.a, [])), lambda x: CAST(x AS VARCHAR))[len(h.history) + 1:], ',') AS appended,
              (SELECT count(*) FROM items) + (SELECT count(*) FROM newid) AS n_items
       FROM hist h LEFT JOIN add a ON h.user_id = a.user_id""", "items", "clicks"))
def g12(spark, sf):
    """Generated items (benchmark rows; owner = item % customers + 1) appended with ids after max(id) and
    appended to their owner's history."""
    n_cust = fx.table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    gen = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("gen_order"), ((F.col("item_id") % n_cust) + 1).alias("user_id"),
        F.col("text").alias("title"))
    items = fx.items(spark, sf).select("item_id", "title", "subcategory")
    c = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())
    hist = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "item_id"))).alias("_h")) \
        .select("user_id", F.transform("_h", lambda e: e["item_id"]).alias("history"))
    new_items, new_hist = P.merge_generated_items(items, gen, hist.withColumn("n_before", F.size("history")))
    n_items = new_items.agg(F.count(F.lit(1))).scalar()
    return new_hist.select(
        "user_id", F.col("n_before").cast("bigint").alias("n_before"),
        F.array_join(F.transform(F.slice("history", F.col("n_before") + 1, 1 << 30), lambda x: x.cast("string")), ",")
        .alias("appended"), n_items.alias("n_items"))


@query("g13_prefixed_ids", "G13", W(
    "SELECT DISTINCT concat_ws('_', 'train', CAST(user_id AS VARCHAR)) AS uid FROM impressions", "impressions"))
def g13(spark, sf):
    """Per-split user ids."""
    return P.prefixed_user_ids(fx.impressions(spark, sf)).select("uid").distinct()


@query("g13_running_ids", "G13", W(
    """SELECT tag, user_id, row_number() OVER (ORDER BY tag, user_id) - 1 AS uid FROM (
         SELECT DISTINCT 0 AS tag, user_id FROM impressions WHERE impression_time < TIMESTAMP '1998-01-01'
         UNION ALL SELECT DISTINCT 1, user_id FROM impressions WHERE impression_time >= TIMESTAMP '1998-01-01')""", "impressions"))
def g13_running(spark, sf):
    """Users of two splits (before and from 1998 on) with the split's tag and a new running id."""
    i = fx.impressions(spark, sf)
    early, late = i.filter("impression_time < '1998-01-01'"), i.filter("impression_time >= '1998-01-01'")
    u = P.running_user_ids({"train": early.select("user_id").distinct(), "dev": late.select("user_id").distinct()})
    return u.select("tag", "user_id", "uid")


# ---- C --------------------------------------------------------------------------------------------------------------
@query("c2_attach_embeddings", "C2", W(
    """SELECT i.item_id, CAST(len(v.embedding) AS BIGINT) AS dim FROM items i LEFT JOIN item_vectors v ON i.item_id = v.item_id""",
    "items", "item_vectors"))
def c2(spark, sf):
    """Items left-joined with their vectors after semi-join reduction of the vector table."""
    j = LK.attach_embeddings(fx.items(spark, sf).select("item_id"), fx.item_vectors(spark, sf))
    return j.select("item_id", F.size("embedding").cast("bigint").alias("dim"))


_C3 = """
    SELECT i.impression_id,
           {keep} AS keep_mode, {fill} AS fill_mode, {drop} AS drop_mode
    FROM impressions i LEFT JOIN (
      SELECT impression_id, list(category ORDER BY pos) AS cats,
             list(coalesce(category, 'Unknown') ORDER BY pos) AS cats_fill,
             list(category ORDER BY pos) FILTER (WHERE category IS NOT NULL) AS cats_drop
      FROM (SELECT c.impression_id, c.pos, CASE WHEN it.has_image THEN it.category END AS category
            FROM candidates c LEFT JOIN items it ON c.item_id = it.item_id)
      GROUP BY impression_id) m ON i.impression_id = m.impression_id"""


@query("c3_map_list_values", "C3", W(_C3.format(keep=sfl("cats", "str"), fill=sfl("cats_fill", "str"),
                                                drop=sfl("cats_drop", "str")), "impressions", "candidates", "items"))
def c3(spark, sf):
    """Map in-view ids to categories with keep / fill('Unknown') / drop of unknown ids (lookup table = the items
    that have an image, so the others are unknown)."""
    i = fx.impressions(spark, sf).select("impression_id", "inview")
    lk = fx.items(spark, sf).filter("has_image").select("item_id", "category")
    keep = LK.map_list(i, "inview", lk, "item_id", "category", "impression_id", out="k", mode="keep")
    fill = LK.map_list(keep, "inview", lk, "item_id", "category", "impression_id", out="f", mode="fill", fill="Unknown")
    drop = LK.map_list(fill, "inview", lk, "item_id", "category", "impression_id", out="d", mode="drop")
    return drop.select("impression_id", L.fmt_list("k", "str").alias("keep_mode"),
                       L.fmt_list("f", "str").alias("fill_mode"), L.fmt_list("d", "str").alias("drop_mode"))


@query("c4_lookup_default", "C4", W(
    """SELECT c.impression_id, c.pos, coalesce(i.sentiment_score, 0.5) AS sentiment
       FROM candidates c LEFT JOIN (SELECT * FROM items WHERE has_image) i ON c.item_id = i.item_id""",
    "candidates", "items"))
def c4(spark, sf):
    """Scalar lookup with a default (items with an image carry a sentiment; others default 0.5)."""
    lk = fx.items(spark, sf).filter("has_image").select("item_id", "sentiment_score")
    c = fx.candidates(spark, sf).select("impression_id", "pos", "item_id")
    return LK.lookup_value(c, "item_id", lk, "item_id", "sentiment_score", 0.5, out="sentiment") \
        .select("impression_id", "pos", "sentiment")


@query("c5_c6_union_inject", ("C5", "C6"), W(
    """SELECT i.item_id, i.title, CAST(len(v.embedding) AS BIGINT) AS dim, b.text AS caption
       FROM items i LEFT JOIN item_vectors v ON i.item_id = v.item_id LEFT JOIN benchmark b ON i.item_id = b.item_id""",
    "items", "item_vectors"))
def c5(spark, sf):
    """Union-by-key of the catalogue with the vector table, then injection of the caption column."""
    it = fx.items(spark, sf).select("item_id", "title")
    v = fx.item_vectors(spark, sf).select(F.col("item_id").alias("vid"), F.size("embedding").cast("bigint").alias("dim"))
    u = LK.union_by_key(it, [(v, "vid")], "item_id")
    b = fx.table(spark, sf, "benchmark").withColumnRenamed("text", "caption")
    return LK.inject_columns(u, b, ["caption"], "item_id")


@query("c7_with_descriptions", "C7", W(
    "SELECT i.item_id, i.title, b.text FROM items i JOIN benchmark b ON i.item_id = b.item_id", "items"))
def c7(spark, sf):
    """Items inner-joined with descriptions."""
    return LK.with_descriptions(fx.items(spark, sf).select("item_id", "title"), fx.table(spark, sf, "benchmark"))


@query("c8_complete_attribute", "C8", W(
    """SELECT d.item_id, coalesce(b.text, '') AS text FROM (SELECT DISTINCT item_id FROM candidates) d
       LEFT JOIN benchmark b ON d.item_id = b.item_id""", "candidates"))
def c8(spark, sf):
    """Every distinct candidate id with its caption, missing -> ''."""
    return LK.complete_attribute(fx.candidates(spark, sf), fx.table(spark, sf, "benchmark"), "item_id", "text")


@query("c9_align_by_content", ("C9", "H8"), """
    SELECT l.doc_id AS left_id, r.right_id FROM documents l
    JOIN (SELECT md5(text) AS h, max(doc_id) AS right_id FROM documents GROUP BY md5(text)) r ON md5(l.text) = r.h""")
def c9(spark, sf):
    """Align two catalogues (documents against documents) by md5 of the text; the last duplicate id wins."""
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return LK.align_by_content(d, d, "item_id", ["text"])


@query("c10_align_vectors", "C10", W(
    """SELECT count(*) AS n_items, count(*) FILTER (WHERE v.item_id IS NULL) AS n_missing,
              round(sum(coalesce(v.embedding[1], 0)), 4) + 0.0 AS s
       FROM items i LEFT JOIN item_vectors v ON i.item_id = v.item_id""", "items", "item_vectors"))
def c10(spark, sf):
    """A vector for every catalogue item (missing -> zero vector) and the count of misses."""
    a = LK.align_vectors(fx.items(spark, sf), fx.item_vectors(spark, sf), "item_id", "embedding", 64)
    return a.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("missing").cast("bigint").alias("n_missing"),
                 F.round(F.sum(F.element_at("embedding", 1).cast("double")), 4).alias("s"))


@query("c11_first_match", "C11", W(
    "SELECT user_id, arg_min(impression_id, (impression_time, impression_id)) AS impression_id FROM impressions GROUP BY user_id",
    "impressions"))
def c11(spark, sf):
    """First impression per user by (time, impression id)."""
    return LK.first_match(fx.impressions(spark, sf), "user_id", ["impression_time", "impression_id"], ["impression_id"])


@query("c12_pending_work", ("C12", "N8"), """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND text IS NOT NULL AND text <> ''""")
def c12(spark, sf):
    """Work list: documents not yet in the done log (labels), minus empty contents."""
    return LK.pending(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), "doc_id", "text").select("doc_id")


@query("c14_label_by_membership", ("C14", "J4"), W(
    "SELECT impression_id, item_id, label FROM candidates", "candidates"))
def c14(spark, sf):
    """One row per in-view item with its click label."""
    i = fx.impressions(spark, sf).select("impression_id", "inview", "clicked")
    return LK.label_by_membership(i, "inview", "clicked").select("impression_id", "item_id", "label")


@query("c15_serve_examples", ("C15", "C1"), W(
    """WITH h AS (SELECT user_id, count(*) AS n_hist FROM clicks WHERE item_id IS NOT NULL GROUP BY user_id),
            n AS (SELECT user_id, count(*) AS n_neg FROM ratings WHERE rating < 3 GROUP BY user_id)
       SELECT i.impression_id, h.n_hist, n.n_neg FROM impressions i LEFT JOIN h ON i.user_id = h.user_id
       LEFT JOIN n ON i.user_id = n.user_id""", "impressions", "clicks", "ratings"))
def c15(spark, sf):
    """Read-time star join: impression -> user history table -> user negatives table."""
    h = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_hist"))
    n = fx.ratings(spark, sf).filter(F.col("rating") < 3).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_neg"))
    return LK.serve_examples(fx.impressions(spark, sf).select("impression_id", "user_id"), h, n) \
        .select("impression_id", "n_hist", "n_neg")


@query("j13_attach_scores", "J13", W(
    f"SELECT impression_id, {sfl('list(score ORDER BY pos)', 'double')} AS scores FROM candidates GROUP BY impression_id",
    "candidates"))
def j13(spark, sf):
    """Flat (impression, pos, score) rows back into order-aligned score lists."""
    c = fx.candidates(spark, sf)
    lists = fx.impressions(spark, sf).select("impression_id")
    return LK.attach_scores(lists, c, "impression_id").select("impression_id", L.fmt_list("scores", "double").alias("scores"))


# ---- E --------------------------------------------------------------------------------------------------------------
@query("e1_dynamic_history", "E1", W(
    f"""SELECT user_id, item_id, strftime(ts, '%Y-%m-%d') AS day,
              {sfl('coalesce(list_filter(list(item_id) OVER (PARTITION BY user_id ORDER BY ts, item_id NULLS FIRST ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), [])')} AS history
       FROM clicks""", "clicks"))
def e1(spark, sf):
    """Last 3 items before each click per user; NULL items use a slot and are dropped."""
    d = H.dynamic_history(fx.clicks(spark, sf), 3, tiebreak=[F.col("item_id").asc_nulls_first()], out="h")
    return d.select("user_id", "item_id", _day("ts").alias("day"), L.fmt_list("h").alias("history"))


@query("e2_fixed_history", ("E2", "C1"), W(
    f"""WITH h AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS hist FROM (
                     SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r
                     FROM clicks WHERE ts < TIMESTAMP '1998-01-01' AND item_id IS NOT NULL) WHERE r <= 5 GROUP BY user_id)
       SELECT i.impression_id, {sfl('h.hist')} AS history FROM impressions i LEFT JOIN h ON i.user_id = h.user_id""",
    "impressions", "clicks"))
def e2(spark, sf):
    """Per user the last 5 non-null clicks before 1998, attached to every impression (NULL if none)."""
    imp = fx.impressions(spark, sf).select("impression_id", "user_id")
    out = H.fixed_history(fx.clicks(spark, sf), "1998-01-01", 5, attach_to=imp)
    return out.select("impression_id", L.fmt_list("item_id_fixed").alias("history"))


@query("e3_fixed_history_multi", "E3", W(
    f"""WITH h AS (SELECT user_id, list(item_id ORDER BY ts, item_id, rating) AS items, list(rating ORDER BY ts, item_id, rating) AS ratings
                   FROM ratings WHERE ts < TIMESTAMP '1997-01-01' GROUP BY user_id)
       SELECT u.user_id, {sfl('h.items')} AS item_id_fixed, {sfl('h.ratings')} AS rating_fixed
       FROM (SELECT DISTINCT user_id FROM ratings) u LEFT JOIN h ON u.user_id = h.user_id""", "ratings"))
def e3(spark, sf):
    """Fixed history over several columns (item, rating) as parallel lists, all history before 1997."""
    r = fx.ratings(spark, sf)
    users = r.select("user_id").distinct()
    out = H.fixed_history(r, "1997-01-01", None, extra=["rating"], tiebreak=["item_id", "rating"], attach_to=users)
    return out.select("user_id", L.fmt_list("item_id_fixed").alias("item_id_fixed"),
                      L.fmt_list("rating_fixed").alias("rating_fixed"))


@query("e6_sessions_from_pairs", "E6", W(
    f"""SELECT user_id, {sfl('list(item_id ORDER BY ts, item_id) FILTER (WHERE rating > 3)')} AS history,
              coalesce({sfl('list(item_id ORDER BY ts, item_id) FILTER (WHERE rating < 3)')}, '') AS neg
       FROM ratings WHERE rating <> 3 GROUP BY user_id HAVING count(*) FILTER (WHERE rating > 3) > 0""", "ratings"))
def e6(spark, sf):
    """Per user: positives in time order and negatives; users without positives dropped."""
    r = P.binarize_ratings(fx.ratings(spark, sf))
    s = H.sessions_from_pairs(r)
    return s.select("user_id", L.fmt_list("history").alias("history"), L.fmt_list("neg").alias("neg"))


@query("e7_first_k_history", "E7", W(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn FROM ratings)
       SELECT user_id, {sfl('list(item_id ORDER BY rn) FILTER (WHERE rn <= 5)')} AS history,
              count(*) FILTER (WHERE rn > 5) AS n_rest
       FROM r GROUP BY user_id""", "ratings"))
def e7(spark, sf):
    """First 5 interactions per user become the history; the rest stay as labelled rows (counted)."""
    hist, rest = H.first_k_history(fx.ratings(spark, sf), 5)
    n = rest.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rest"))
    return hist.join(n, "user_id", "left").select("user_id", L.fmt_list("history").alias("history"),
                                                  F.coalesce("n_rest", F.lit(0)).cast("bigint").alias("n_rest"))


@query("e10_history_versions", ("E10", "D22"), W(
    """WITH v AS (SELECT user_id, coalesce(array_to_string(list_transform(clicked, lambda x: CAST(x AS VARCHAR)), ','), '') AS hk,
                         min(impression_id) AS f FROM impressions GROUP BY ALL),
            k AS (SELECT user_id, hk, dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1 AS k FROM v)
       SELECT i.impression_id, concat_ws('_', CAST(i.user_id AS VARCHAR), CAST(k.k AS VARCHAR)) AS uid_k
       FROM impressions i JOIN k ON i.user_id = k.user_id
        AND coalesce(array_to_string(list_transform(i.clicked, lambda x: CAST(x AS VARCHAR)), ','), '') = k.hk""",
    "impressions"))
def e10(spark, sf):
    """k-th distinct clicked-list ('history') of a user in first-seen order -> ``user_k``."""
    i = fx.impressions(spark, sf).select("impression_id", "user_id", F.col("clicked").alias("history"))
    return H.history_versions(i).select("impression_id", "uid_k")


@query("e11_position_in_group", ("E11",), W(
    "SELECT impression_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY impression_time, impression_id) AS BIGINT) AS position FROM impressions",
    "impressions"))
def e11(spark, sf):
    """1-based position of each impression within its user, by time then id."""
    return H.position_in_group(fx.impressions(spark, sf), "user_id", ["impression_time", "impression_id"]) \
        .select("impression_id", F.col("position").cast("bigint").alias("position"))


_SESSIONS_SQL = """s AS (SELECT user_id, list(item_id ORDER BY ts, item_id) FILTER (WHERE rating > 3) AS history
                       FROM ratings WHERE rating <> 3 GROUP BY user_id HAVING count(*) FILTER (WHERE rating > 3) > 0)"""


def _draw_sql(tag):
    return f"('0x' || substr(md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), '{tag}')), 1, 8))::BIGINT"


@query("e8_random_history_split", ("E8",), W(
    f"""WITH {_SESSIONS_SQL},
            k AS (SELECT user_id, history, CASE WHEN u <= 0.1 THEN c5 WHEN u <= 0.2 THEN 6 WHEN u <= 0.3 THEN 7 WHEN u <= 0.4 THEN 8 ELSE 9 END AS cut
                  FROM (SELECT user_id, history, {_draw_sql('cut')} / 4294967296.0 AS u, {_draw_sql('cut5')} % 5 + 1 AS c5 FROM s)),
            r AS (SELECT user_id, list_slice(history, 1, cut) AS hc,
                         CASE WHEN len(history) > cut THEN list_slice(history, cut + 1, len(history)) ELSE [] END AS rest FROM k),
            x AS (SELECT *, len(rest) AS m, len(rest) // 10 AS p FROM r)
       SELECT user_id, {sfl('hc')} AS history_cut,
              {sfl('CASE WHEN p > 0 THEN list_slice(rest, 1, m - 2 * p) WHEN m >= 2 THEN list_slice(rest, 1, m - 2) ELSE [] END')} AS train,
              {sfl('CASE WHEN p > 0 THEN list_slice(rest, m - 2 * p + 1, m - p) WHEN m >= 2 THEN [rest[m - 1]] ELSE [] END')} AS dev,
              {sfl('CASE WHEN p > 0 THEN list_slice(rest, m - p + 1, m) WHEN m >= 2 THEN [rest[m]] ELSE rest END')} AS test
       FROM x""", "ratings"))
def e8(spark, sf):
    """Seeded random history cut per user, remaining positives split train / dev / test in time order."""
    s = H.sessions_from_pairs(P.binarize_ratings(fx.ratings(spark, sf)))
    r = H.random_history_split(s, 42)
    return r.select("user_id", *[L.fmt_list(c).alias(c) for c in ("history_cut", "train", "dev", "test")])


_E9_KEY = "md5(concat_ws('|', '42', user_id, i - 1))"
_E9_DRAW = "('0x' || substr(md5(concat_ws('|', '42', user_id, k)), 1, 8))::BIGINT"


@query("e9_negatives_split", ("E9", "J7", "F7"), W(
    f"""WITH neg AS (SELECT user_id, coalesce(list(item_id ORDER BY ts, item_id) FILTER (WHERE rating < 3), []) AS neg
                     FROM ratings WHERE rating <> 3 GROUP BY user_id HAVING count(*) FILTER (WHERE rating > 3) > 0),
            idx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ci FROM items),
            d AS (SELECT user_id, list(idx.item_id ORDER BY k) AS rnd FROM (
                    SELECT user_id, k, {_E9_DRAW} % (SELECT count(*) FROM items) AS ci FROM neg, (SELECT unnest(range(1, 11)) AS k)
                  ) x JOIN idx ON x.ci = idx.ci GROUP BY user_id),
            a AS (SELECT user_id, list_transform(list_sort(list_transform(list_concat(neg, rnd), lambda x, i: {{'k': {_E9_KEY}, 'i': i - 1, 'x': x}})),
                                               lambda e: e.x) AS s FROM neg JOIN d USING (user_id)),
            p AS (SELECT user_id, s, len(s) AS m, len(s) // 10 AS p FROM a)
       SELECT user_id, {sfl('CASE WHEN p > 0 THEN list_slice(s, 1, m - 2 * p) ELSE [] END')} AS neg_train,
              {sfl('CASE WHEN p > 0 THEN list_slice(s, m - 2 * p + 1, m - p) ELSE [] END')} AS neg_dev,
              {sfl('CASE WHEN p > 0 THEN list_slice(s, m - p + 1, m) ELSE s END')} AS neg_test FROM p""", "ratings", "items"))
def e9(spark, sf):
    """Each user's negatives plus 10 random catalogue items, shuffled (seeded), split 80/10/10 by portions."""
    from recsuite.operators import labels as J
    s = H.sessions_from_pairs(P.binarize_ratings(fx.ratings(spark, sf)))
    s = J.random_catalogue_negatives(s, fx.items(spark, sf), 10, 42, "user_id")
    s = s.withColumn("neg", L.shuffle_list(F.concat("neg", "random_neg"), 42, "user_id"))
    r = H.split_negatives(s)
    return r.select("user_id", *[L.fmt_list(c).alias(c) for c in ("neg_train", "neg_dev", "neg_test")])


@query("e1_dynamic_history_skew_safe", "E1", W(
    f"""SELECT user_id, item_id, strftime(ts, '%Y-%m-%d') AS day,
              {sfl('coalesce(list_filter(list(item_id) OVER (PARTITION BY user_id ORDER BY ts, item_id NULLS FIRST ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), [])')} AS history
       FROM clicks""", "clicks"))
def e1_skew_safe(spark, sf):
    """Last 3 items before each click per user, every column of the clicks carried (no task holds a whole user)."""
    d = H.dynamic_history(fx.clicks(spark, sf), 3, tiebreak=[F.col("item_id").asc_nulls_first()], out="h")
    return d.select("user_id", "item_id", _day("ts").alias("day"), L.fmt_list("h").alias("history"))
