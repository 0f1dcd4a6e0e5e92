"""Queries for encode jobs over several tables with growing vocabularies, and the example table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.operators import encode as E
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx

W = fx.with_views
sfl = L.sql_fmt_list


# ---- the news tables: items in two splits, users with a history string, interactions in three splits, negatives ----
def _items(spark, sf):
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("nid"), F.col("text").alias("abs"))
    it = fx.items(spark, sf).select(F.col("item_id").alias("nid"), F.col("category").alias("cat"), F.col("subcategory").alias("subcat"), "title")
    it = it.join(b, "nid", "left").withColumn("abs", F.coalesce("abs", F.lit("")))
    return {"item.first": it.filter("nid % 3 <> 0"), "item.second": it.filter("nid % 3 = 0")}


def _users(spark, sf):
    c = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())
    h = c.groupBy(F.col("user_id").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("ts", "item_id"))).alias("_h"))
    return h.select("uid", F.array_join(F.transform("_h", lambda e: e["item_id"].cast("string")), " ").alias("history"))


def _interactions(spark, sf):
    c = fx.candidates(spark, sf).select(
        (F.col("impression_id") * 100 + F.col("pos")).alias("row"), F.col("impression_id").alias("imp"), F.col("user_id").alias("uid"),
        F.col("item_id").alias("nid"), F.col("label").alias("click"), "impression_time")
    cut = lambda a, b: c.filter((F.col("impression_time") >= a) & (F.col("impression_time") < b)).drop("impression_time")
    return {"interactions.train": cut("1900-01-01", "1996-01-01"), "interactions.dev": cut("1996-01-01", "1997-01-01"),
            "interactions.test": cut("1997-01-01", "2100-01-01")}


def _negatives(spark, sf):
    c = fx.candidates(spark, sf)
    first = c.groupBy("user_id").agg(F.min("impression_id").alias("impression_id"))
    n = c.join(first, ["user_id", "impression_id"]).filter("label = 0").groupBy(F.col("user_id").alias("uid")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("_n"))
    return n.select("uid", F.array_join(F.transform("_n", lambda e: e["item_id"].cast("string")), " ").alias("neg"))


_WORDS = r"regexp_extract_all(lower({0}), '\w+|[^\w\s]')"
_SRC = """src AS (SELECT CAST(i.item_id % 3 = 0 AS INTEGER) AS s, i.item_id AS nid, i.category AS cat, i.subcategory AS subcat, i.title,
                    coalesce(b.text, '') AS abs FROM items i LEFT JOIN benchmark b ON i.item_id = b.item_id)"""
_HIST = """hx AS (SELECT user_id AS uid, unnest(h) AS nid, generate_subscripts(h, 1) AS p FROM (
             SELECT user_id, list(item_id ORDER BY ts, item_id) AS h FROM clicks WHERE item_id IS NOT NULL GROUP BY user_id))"""


def _numbered(cte: str, source: str, order: str) -> str:
    """CTE ``cte(token, idx)``: tokens of ``source(token, ...)`` numbered by their first appearance under ``order``."""
    return f"""{cte} AS (SELECT token, CAST(row_number() OVER (ORDER BY f, token) - 1 AS BIGINT) AS idx FROM (
                 SELECT token, min(row({order})) AS f FROM ({source}) GROUP BY token))"""


@query("i17_news_items", ("I17", "I11", "I13", "I14"), W(
    f"""WITH {_SRC},
          tk AS (SELECT nid, s, 0 AS c, unnest({_WORDS.format('title')}) AS token, generate_subscripts({_WORDS.format('title')}, 1) AS p FROM src
                 UNION ALL SELECT nid, s, 1, unnest({_WORDS.format('abs')}), generate_subscripts({_WORDS.format('abs')}, 1) FROM src),
          {_numbered('ev', 'SELECT * FROM tk', 's, c, nid, p')},
          {_numbered('cv', 'SELECT cat AS token, s, nid FROM src', 's, nid')},
          {_numbered('sv', 'SELECT subcat AS token, s, nid FROM src', 's, nid')},
          {_numbered('nv', 'SELECT nid AS token, s, nid FROM src', 's, nid')},
          te AS (SELECT nid, list(idx ORDER BY p) FILTER (WHERE c = 0) AS t, list(idx ORDER BY p) FILTER (WHERE c = 1) AS a
                 FROM tk JOIN ev USING (token) GROUP BY nid)
        SELECT CASE s WHEN 0 THEN 'item.first' ELSE 'item.second' END AS split, nv.idx AS nid, cv.idx AS cat, sv.idx AS subcat,
          coalesce({sfl('list_slice(te.t, 1, 20)')}, '') AS title, coalesce({sfl('list_slice(te.a, 1, 50)')}, '') AS abs
        FROM src JOIN nv ON nv.token = src.nid JOIN cv ON cv.token = cat JOIN sv ON sv.token = subcat LEFT JOIN te ON te.nid = src.nid""",
    "items"))
def i17_items(spark, sf):
    """The news item job over two splits of the catalogue: the second split keeps every id of the first and numbers
    its new items, categories and words behind them."""
    out, _ = E.encode_tables(E.dataset_jobs(E.NEWS_SMALL, _items(spark, sf)))
    res = None
    for name, t in out.items():
        part = t.select(F.lit(name).alias("split"), "nid", "cat", "subcat", L.fmt_list("title").alias("title"), L.fmt_list("abs").alias("abs"))
        res = part if res is None else res.unionByName(part)
    return res


@query("i17_news_users", ("I17", "I7", "I14"), W(
    f"""WITH {_SRC}, {_HIST},
          {_numbered('nv', 'SELECT nid AS token, 0 AS s, nid AS o, 0 AS p FROM src WHERE s = 0 UNION ALL SELECT nid, 1, uid, p FROM hx', 's, o, p')},
          {_numbered('uv', 'SELECT DISTINCT uid AS token FROM hx', 'token')},
          he AS (SELECT uid, list(idx ORDER BY p) AS h FROM hx JOIN nv ON nv.token = hx.nid GROUP BY uid)
        SELECT uv.idx AS uid, {sfl('list_slice(h, greatest(len(h) - 29, 1), len(h))')} AS history FROM he JOIN uv ON uv.token = he.uid""",
    "items", "clicks"))
def i17_users(spark, sf):
    """The news user job: histories over the item vocabulary of the first split, which grows by the items that only
    histories name; the last 30 ids are kept."""
    tables = {"item": _items(spark, sf)["item.first"], "user": _users(spark, sf)}
    out, _ = E.encode_tables(E.dataset_jobs(E.NEWS_SMALL, tables))
    return out["user"].select("uid", L.fmt_list("history").alias("history"))


@query("i17_large_news_interactions", ("I17", "I9", "I6", "G11"), W(
    f"""WITH {_HIST},
          cx AS (SELECT impression_id * 100 + pos AS row, impression_id AS imp, user_id AS uid, item_id AS nid, label,
                   CASE WHEN impression_time < TIMESTAMP '1996-01-01' THEN 0 WHEN impression_time < TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END AS s
                 FROM candidates),
          {_numbered('nv', '''SELECT item_id AS token, 0 AS s, item_id AS o, 0 AS p FROM items UNION ALL SELECT nid, 1, uid, p FROM hx
                              UNION ALL SELECT nid, 2 + s, row, 0 FROM cx''', 's, o, p')},
          {_numbered('uv', 'SELECT uid AS token, 0 AS s, uid AS o FROM hx UNION ALL SELECT uid, 1 + s, row FROM cx', 's, o')},
          {_numbered('iv', 'SELECT imp AS token, s, row FROM cx', 's, row')}
        SELECT CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split,
          CAST(row_number() OVER (PARTITION BY s ORDER BY row) - 1 AS BIGINT) AS index, iv.idx AS imp, uv.idx AS uid, nv.idx AS nid,
          CAST(label AS VARCHAR) AS click
        FROM cx JOIN iv ON iv.token = imp JOIN uv ON uv.token = uid JOIN nv ON nv.token = nid""", "items", "clicks", "candidates"))
def i17_interactions(spark, sf):
    """The large-news job: items, users, then three interaction splits; impressions, users and items share vocabularies
    that go on growing from split to split, and each split has its own running index."""
    items = _items(spark, sf)
    tables = {"item": items["item.first"].unionByName(items["item.second"]), "user": _users(spark, sf), **_interactions(spark, sf)}
    out, _ = E.encode_tables(E.dataset_jobs(E.NEWS_LARGE, tables))
    res = None
    for name in ("train", "dev", "test"):
        part = out[f"interactions.{name}"].select(F.lit(name).alias("split"), "index", "imp", "uid", "nid", L.fmt_list("click").alias("click"))
        res = part if res is None else res.unionByName(part)
    return res


@query("i17_news_negatives", ("I17", "I3", "J6"), W(
    f"""WITH {_SRC}, {_HIST},
          {_numbered('nv', 'SELECT nid AS token, 0 AS s, nid AS o, 0 AS p FROM src WHERE s = 0 UNION ALL SELECT nid, 1, uid, p FROM hx', 's, o, p')},
          {_numbered('uv', 'SELECT DISTINCT uid AS token FROM hx', 'token')},
          nx AS (SELECT c.user_id AS uid, c.pos, c.item_id AS nid FROM candidates c JOIN (
                   SELECT user_id, min(impression_id) AS impression_id FROM candidates GROUP BY user_id) f
                 ON f.user_id = c.user_id AND f.impression_id = c.impression_id WHERE label = 0)
        SELECT uv.idx AS uid, coalesce({sfl('list(nv.idx ORDER BY pos) FILTER (WHERE nv.idx IS NOT NULL)')}, '') AS neg
        FROM nx JOIN uv ON uv.token = nx.uid LEFT JOIN nv ON nv.token = nx.nid GROUP BY uv.idx""", "items", "clicks", "candidates"))
def i17_negatives(spark, sf):
    """The news negatives job against closed vocabularies: unknown users are dropped, unknown items left out."""
    tables = {"item": _items(spark, sf)["item.first"], "user": _users(spark, sf), "negatives": _negatives(spark, sf)}
    out, _ = E.encode_tables(E.dataset_jobs(E.NEWS_SMALL, tables))
    return out["negatives"].select("uid", L.fmt_list("neg").alias("neg"))


@query("i14_reserved_ids", ("I14",), W(
    """WITH n AS (SELECT greatest(max(list_max(inview)), max(list_max(clicked))) AS hi, max(user_id) AS hu FROM impressions)
       SELECT 'item' AS vocab, CAST(i AS VARCHAR) AS token, i AS idx FROM n, unnest(range(0, n.hi + 1)) t(i)
       UNION ALL SELECT 'user', CAST(i AS VARCHAR), i FROM n, unnest(range(0, n.hu + 1)) t(i)""", "impressions"))
def i14(spark, sf):
    """Columns that hold ids already: the item vocabulary is 0..max over two list columns, first of the early impressions and
    then extended by the later ones; the user vocabulary over a scalar column."""
    imp = fx.impressions(spark, sf).select("impression_id", "user_id", "inview", "clicked", "impression_time")
    spec = {"user_id": {"vocab": "user", "kind": "ids"}, "inview": {"vocab": "item", "kind": "ids"}, "clicked": {"vocab": "item", "kind": "ids"}}
    early, late = imp.filter("impression_time < '1996-01-01'"), imp.filter("impression_time >= '1996-01-01'")
    _, vocabs = E.encode_tables([E.TableJob("early", early, "impression_id", spec), E.TableJob("late", late, "impression_id", spec)])
    return vocabs["item"].unionByName(vocabs["user"]).select("vocab", "token", "idx")


# ---- J15: the full example table --------------------------------------------------------------------------------
_NESTED = "array_to_string(list_transform({0}, lambda r: array_to_string(list_transform(r, lambda x: CAST(x AS VARCHAR)), ' ')), '|')"
_PADDED = "list_concat(list_transform(range(8 - len({0})), lambda z: {1}), {0})"


@query("j15_example_table_full", ("J15", "I15", "C3"), W(
    f"""WITH wt AS (SELECT item_id, unnest(topics) AS token, generate_subscripts(topics, 1) AS p FROM items),
          {_numbered('wv', 'SELECT * FROM wt', 'item_id, p')},
          tt AS (SELECT item_id, list(idx + 1 ORDER BY p) AS t FROM wt JOIN wv USING (token) GROUP BY item_id),
          it AS (SELECT i.item_id, row_number() OVER (ORDER BY i.item_id) AS x, dense_rank() OVER (ORDER BY category) AS c,
                   list_concat(list_slice(coalesce(t, []), 1, 4), list_transform(range(greatest(4 - len(coalesce(t, [])), 0)), lambda z: 0)) AS t
                 FROM items i LEFT JOIN tt ON tt.item_id = i.item_id WHERE i.item_id % 5 <> 0),
          h AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS h FROM clicks WHERE item_id IS NOT NULL AND ts < TIMESTAMP '1996-01-01' GROUP BY user_id),
          hx AS (SELECT user_id, unnest(l) AS item_id, generate_subscripts(l, 1) AS p FROM (
                   SELECT user_id, list_slice(h, greatest(len(h) - 7, 1), len(h)) AS l FROM h)),
          hg AS (SELECT user_id, list(coalesce(x, 0) ORDER BY p) AS xs, list(coalesce(c, 0) ORDER BY p) AS cs, list(coalesce(t, [0, 0, 0, 0]) ORDER BY p) AS ts
                 FROM hx LEFT JOIN it USING (item_id) GROUP BY user_id),
          cg AS (SELECT impression_id, any_value(user_id) AS user_id, list(coalesce(x, 0) ORDER BY pos) AS xs, list(coalesce(c, 0) ORDER BY pos) AS cs,
                   list(coalesce(t, [0, 0, 0, 0]) ORDER BY pos) AS ts FROM candidates LEFT JOIN it USING (item_id) GROUP BY impression_id),
          j AS (SELECT cg.*, coalesce(hg.xs, []) AS hxs, coalesce(hg.cs, []) AS hcs, coalesce(hg.ts, []) AS hts FROM cg LEFT JOIN hg USING (user_id))
        SELECT impression_id, {sfl(_PADDED.format('hxs', '0'))} AS history_idx, {sfl(_PADDED.format('hcs', '0'))} AS history_category,
          {_NESTED.format(_PADDED.format('hts', '[0, 0, 0, 0]'))} AS history_tokens, {sfl('xs')} AS candidate_idx, {sfl('cs')} AS candidate_category,
          {_NESTED.format('ts')} AS candidate_tokens FROM j""", "items", "clicks", "candidates"))
def j15_full(spark, sf):
    """Model-ready rows: item indexes, token rows (4 wide) and category ids of the last 8 clicks before 1996 and of the
    candidates; every fifth item is unknown."""
    from recsuite.operators import history as H
    from recsuite.operators import vocab as V
    from recsuite.operators.common import dense_index
    it = fx.items(spark, sf).select("item_id", "category", "topics")
    words = V.build_vocab(it, ["topics"], "item_id", "word").withColumn("idx", F.col("idx") + 1)
    it = E.encode_lists(it, {"topics": E.ListColumn("word")}, {"word": words}, "item_id")
    cats = it.filter("item_id % 5 <> 0").select("category").distinct()  # a row per category
    cats = cats.select("category", F.dense_rank().over(Window.orderBy("category")).alias("category_id"))
    known = dense_index(it.filter("item_id % 5 <> 0"), ["item_id"], "idx", start=1).join(F.broadcast(cats), "category")
    c = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())
    hist = H.fixed_history(c, "1996-01-01", None, attach_to=c.select("user_id").distinct()).withColumnRenamed("item_id_fixed", "history")
    imp = fx.impressions(spark, sf).select("impression_id", "user_id", "inview")
    x = E.example_table(imp, hist, known, tokens="topics", history_size=8, title_size=4)
    nested = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r.cast("array<string>"), " ")), "|")
    return x.select("impression_id", *[L.fmt_list(f"{s}_{k}").alias(f"{s}_{k}") for s in ("history", "candidate") for k in ("idx", "category")],
                    *[nested(f"{s}_tokens").alias(f"{s}_tokens") for s in ("history", "candidate")])
