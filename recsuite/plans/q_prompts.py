"""Queries for prompt rendering and reply handling (N, H5, H6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from recsuite.operators import prep as P
from recsuite.operators import prompts as N
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx
from recsuite.sources.io import scratch_dir

W = fx.with_views
NL = "chr(10)"

# Fixed values of the reference: the news category vocabulary replies are validated against.
NEWS_CATEGORIES = ["lifestyle", "health", "news", "sports", "weather", "entertainment", "autos", "travel",
                   "foodanddrink", "tv", "finance", "movies", "video", "music", "kids", "middleeast", "northamerica",
                   "games"]


@query("n1_render_fields", ("N1",), W(
    f"SELECT item_id, concat('[title] ', coalesce(title, ''), {NL}, '[category] ', coalesce(category, ''), {NL}, "
    f"'[subcategory] ', coalesce(subcategory, ''), {NL}) AS prompt FROM items", "items"))
def n1(spark, sf):
    """Every catalogue item as ``[key] value`` lines."""
    it = fx.items(spark, sf)
    return it.select("item_id", N.render_fields({"title": "title", "category": "category", "subcategory": "subcategory"})
                     .alias("prompt"))


@query("n2_render_inline", ("N2", "C7"), W(
    f"""SELECT i.item_id, concat('[book] ', i.title, ', description: ', b.text, {NL}) AS tagged,
              concat('title: ', i.title, {NL}, 'description: ', b.text, {NL}) AS v2, concat('[book] ', i.title, {NL}) AS bare
       FROM items i JOIN benchmark b ON i.item_id = b.item_id""", "items"))
def n2(spark, sf):
    """Items with a description rendered inline, in the v2 two-line form, and without description."""
    j = fx.items(spark, sf).join(fx.table(spark, sf, "benchmark"), "item_id")
    return j.select("item_id", N.render_inline("title", "text").alias("tagged"), N.render_inline("title", "text", "v2").alias("v2"),
                    N.render_inline("title").alias("bare"))


@query("n3_short_text", ("N3", "H5"), W(
    """SELECT i.item_id, concat('(', i.category, ') ', i.title) AS with_category,
              concat(i.title, ', description: ', array_to_string(list_slice(string_split(b.text, ' '), 1, 50), ' ')) AS with_description
       FROM items i JOIN benchmark b ON i.item_id = b.item_id""", "items"))
def n3(spark, sf):
    """Item short texts: ``(category) title`` and title + first 50 words of the description."""
    j = fx.items(spark, sf).join(fx.table(spark, sf, "benchmark"), "item_id")
    return j.select("item_id", N.short_text("title", category="category").alias("with_category"),
                    N.short_text("title", description="text").alias("with_description"))


_HIST_SQL = """h AS (SELECT c.c_custkey AS user_id, k.item_id, k.p FROM customer c LEFT JOIN (
                      SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS p
                      FROM clicks WHERE item_id IS NOT NULL) k ON c.c_custkey = k.user_id)"""


def _histories(spark, sf):
    c = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())
    h = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "item_id"))).alias("_h")) \
        .select("user_id", F.transform("_h", lambda e: e["item_id"]).alias("history"))
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(h, "user_id", "left")


@query("n4_render_history", ("N4",), W(
    f"""WITH {_HIST_SQL}
       SELECT h.user_id, CASE WHEN count(h.item_id) = 0 THEN NULL ELSE
              string_agg(concat('(', CAST(h.p AS VARCHAR), ') ', i.title, {NL}), '' ORDER BY h.p) END AS prompt
       FROM h LEFT JOIN items i ON h.item_id = i.item_id GROUP BY h.user_id""", "clicks", "items"))
def n4(spark, sf):
    """Every customer's click history as numbered title lines (no history -> one NULL prompt)."""
    return N.render_history(_histories(spark, sf), fx.items(spark, sf), "user_id", "history", "item_id", "title")


@query("n5_render_user_facts", ("N5", "B24", "C11"), W(
    f"""WITH r AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rt, l_discount AS sc,
                          row_number() OVER (PARTITION BY o_custkey ORDER BY l_quantity, l_partkey, l_discount) AS n
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
            a AS (SELECT r.user_id, string_agg(concat('(', CAST(r.n AS VARCHAR), ')title: ', i.title, ', read time: ', printf('%.2f', r.rt),
                                                      ', scroll percentage: ', printf('%.2f', r.sc), {NL}), '' ORDER BY r.n) AS arts
                  FROM r JOIN (SELECT * FROM items WHERE has_image) i ON r.item_id = i.item_id WHERE r.n <= 100 GROUP BY r.user_id)
       SELECT c.c_custkey AS user_id,
              concat(CASE c.c_nationkey % 6 WHEN 0 THEN concat('[postcode] metropolitan', {NL}) WHEN 1 THEN concat('[postcode] rural district', {NL})
                       WHEN 2 THEN concat('[postcode] municipality', {NL}) WHEN 3 THEN concat('[postcode] provincial', {NL})
                       WHEN 4 THEN concat('[postcode] big city', {NL}) ELSE '' END,
                     concat('[segment] ', c.c_mktsegment, {NL}), '[articles]', coalesce(a.arts, '')) AS prompt
       FROM customer c LEFT JOIN a ON c.c_custkey = a.user_id""", "items"))
def n5(spark, sf):
    """User facts (decoded postcode class, segment) + the first 100 reads sorted by read time ascending, numbered
    by sorted position; articles missing from the (image-only) catalogue keep their number and are skipped."""
    from recsuite.plans.q_relational import POSTCODE_NAMES
    li = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    reads = li.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                      F.format_string("%.2f", "l_quantity").alias("read_time_txt"), F.col("l_quantity").alias("read_time"),
                      F.format_string("%.2f", "l_discount").alias("scroll"), "l_discount")
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey", "c_mktsegment")
    texts = fx.items(spark, sf).filter("has_image").select("item_id", "title")
    facts = {"postcode": P.decode_codes(F.col("c_nationkey") % 6, POSTCODE_NAMES), "segment": F.col("c_mktsegment")}
    r = N.render_user_facts(facts, reads, texts, "user_id", "item_id", "title", "read_time_txt", "scroll", users,
                            order=["read_time", "item_id", "l_discount"])
    return r


@query("n6_cold_users", ("N6", "B25"), W(
    f"""WITH {_HIST_SQL}, cold AS (SELECT user_id FROM h GROUP BY user_id HAVING count(item_id) BETWEEN 1 AND 10)
       SELECT h.user_id, string_agg(concat('(', CAST(h.p AS VARCHAR), ') (', i.category, ') ', i.title, {NL}), '' ORDER BY h.p) AS prompt
       FROM h JOIN cold USING (user_id) LEFT JOIN items i ON h.item_id = i.item_id GROUP BY h.user_id""", "clicks", "items"))
def n6(spark, sf):
    """Cold users only (1..10 history items), history rendered with ``(category) title``."""
    h = P.cold_users(_histories(spark, sf), "history", 10)
    texts = fx.items(spark, sf).select("item_id", N.short_text("title", category="category").alias("t"))
    return N.render_history(h, texts, "user_id", "history", "item_id", "t")


def _topic_replies(spark, sf):
    """Stand-in reply log: per user a ``[topics]`` section listing the categories of their clicked items."""
    c = fx.clicks(spark, sf).join(fx.items(spark, sf), "item_id")
    cats = c.groupBy("user_id").agg(F.sort_array(F.collect_set("category")).alias("cats"))
    return cats.select("user_id", F.concat(F.lit("[topics]\n"), F.array_join(
        F.transform("cats", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("interest"))


_REPLY_SQL = f"""rep AS (SELECT c.user_id, concat('[topics]', {NL}, array_to_string(list_transform(list_sort(list(DISTINCT i.category)),
                                 lambda x: concat('- ', x)), {NL})) AS interest
                  FROM clicks c JOIN items i ON c.item_id = i.item_id GROUP BY c.user_id),
            parsed AS (SELECT user_id, list_transform(list_filter(string_split(regexp_extract(interest, '\\[topics\\]\\n((?:- [^\\n]*(?:\\n|$))*)', 1), {NL}),
                                 lambda x: starts_with(x, '- ')), lambda x: substr(x, 3)) AS topics FROM rep)"""


@query("n9_parse_sections", ("N9", "A7"), W(
    f"WITH {_REPLY_SQL} SELECT user_id, array_to_string(topics, '|') AS topics FROM parsed", "clicks", "items"))
def n9(spark, sf):
    """``[topics]`` bullet sections of replies parsed back into lists."""
    r = _topic_replies(spark, sf)
    return r.select("user_id", F.array_join(N.parse_sections("interest", "topics"), "|").alias("topics"))


@query("n7_chain_prompt", ("N7",), W(
    f"""WITH {_REPLY_SQL}, {_HIST_SQL},
            hp AS (SELECT h.user_id, string_agg(concat('(', CAST(h.p AS VARCHAR), ') ', i.title, {NL}), '' ORDER BY h.p) AS prompt
                   FROM h JOIN items i ON h.item_id = i.item_id GROUP BY h.user_id)
       SELECT p.user_id, concat('[interests]', {NL}, array_to_string(list_transform(p.topics, lambda x: concat('- ', x)), {NL}),
                                {NL}, '[history]', {NL}, hp.prompt) AS prompt
       FROM parsed p JOIN hp ON p.user_id = hp.user_id""", "clicks", "items"))
def n7(spark, sf):
    """Parsed interests followed by the rendered history, for users having both."""
    r = _topic_replies(spark, sf).select("user_id", N.parse_sections("interest", "topics").alias("topics"))
    h = N.render_history(_histories(spark, sf), fx.items(spark, sf), "user_id", "history", "item_id", "title") \
        .filter(F.col("prompt").isNotNull())
    return N.chain_prompt(r, h, "user_id", "topics", "prompt")


@query("n10_parse_json", ("N10", "H16"), W(
    """WITH rep AS (SELECT item_id AS uid, has_image, title, category, subcategory FROM items)
       SELECT uid, CASE WHEN has_image THEN title END AS title, CASE WHEN has_image THEN category END AS topics,
              CAST(count(*) FILTER (WHERE NOT has_image) OVER () AS BIGINT) AS n_bad FROM rep""", "items"))
def n10(spark, sf):
    """Replies as JSON with the article JSON nested as a string (two parsing passes); replies of items without
    an image are cut short (malformed) and come back NULL, and are counted."""
    it = fx.items(spark, sf)
    inner = F.to_json(F.struct(F.col("title"), F.col("category").alias("topics"), F.col("subcategory").alias("body")))
    inner = F.when(F.col("has_image"), inner).otherwise(F.substring(inner, 1, 12))
    line = F.to_json(F.struct(F.col("item_id").alias("uid"), inner.alias("news")))
    log = it.select(line.alias("value"))
    outer = log.select(N.parse_json_reply("value", "uid long, news string").alias("o"))
    art = outer.select("o.uid", N.parse_json_reply("o.news", "title string, topics string, body string").alias("a"))
    from pyspark.sql import Window
    bad = F.col("a._corrupt_record").isNotNull()
    return art.select("uid", F.col("a.title").alias("title"), F.col("a.topics").alias("topics"),
                      F.count_if(bad).over(Window.partitionBy()).cast("bigint").alias("n_bad"))


@query("n11_parse_tagged", ("N11", "A8", "H6"), W(
    """SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN has_image THEN trim(replace(title, 'ring', 'band')) END AS newtitle FROM items""",
    "items"))
def n11(spark, sf):
    """``id \\t [newtitle] ...`` reply lines (written, then read back with the acceptance rule); the tag is
    stripped; replies without the tag give NULL."""
    from recsuite.sources.io import read_reply_log_tsv
    it = fx.items(spark, sf)
    reply = F.when(F.col("has_image"), F.concat(F.lit("[newtitle] "), F.replace("title", F.lit("ring"), F.lit("band")))) \
        .otherwise(F.lit("no tag here"))
    path = scratch_dir(spark, f"reply_log_{uuid.uuid4().hex}")
    it.select(F.concat(F.col("item_id").cast("string"), F.lit("\t"), reply).alias("value")).write.mode("overwrite").text(path)
    log = read_reply_log_tsv(spark, path, reject_suffix="is a book.")
    return log.select("id", N.parse_tagged("text", "newtitle").alias("newtitle"))


@query("n12_validate_topics", ("N12",), W(
    f"""WITH {_REPLY_SQL}
       SELECT CAST(sum(len(topics)) AS BIGINT) AS n_values,
              CAST(sum(len(list_filter(topics, lambda x: NOT list_contains({NEWS_CATEGORIES!r}, lower(replace(x, 'Brand#', 'c')))))) AS BIGINT) AS n_violations
       FROM parsed""".replace('"', "'"), "clicks", "items"))
def n12(spark, sf):
    """Parsed topics validated against the fixed category list (all brand topics violate it)."""
    r = _topic_replies(spark, sf).select(N.parse_sections("interest", "topics").alias("topics"))
    v = N.violation_rate(r.select(F.transform("topics", lambda x: F.lower(F.replace(x, F.lit("Brand#"), F.lit("c")))).alias("t")),
                         "t", NEWS_CATEGORIES)
    return v.select(F.col("n_values").cast("bigint").alias("n_values"), F.col("n_violations").cast("bigint").alias("n_violations"))


@query("n13_append_log", ("N13", "A16"), W("SELECT count(*) * 2 AS n FROM items WHERE has_image", "items"))
def n13(spark, sf):
    """Accepted replies appended twice to a JSON-lines log and read back."""
    it = fx.items(spark, sf).filter("has_image").select(F.col("item_id").alias("uid"), F.col("title").alias("newtitle"))
    path = scratch_dir(spark, f"append_log_{uuid.uuid4().hex}")
    N.append_replies(it, path, ["uid", "newtitle"])
    N.append_replies(it, path, ["uid", "newtitle"])
    return spark.read.schema("uid long, newtitle string").json(path).agg(F.count(F.lit(1)).alias("n"))



