"""Queries for vocabularies, encoding, encoded-table storage and model-ready example tables (I, A12, A13, C17,
J15-J19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.operators import labels as J
from recsuite.operators import lookup as LK
from recsuite.operators import vocab as V
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx
from recsuite.sources.io import scratch_dir

W = fx.with_views
sfl = L.sql_fmt_list

_VOCAB_ITEMS_SQL = """
    SELECT 'item' AS vocab, token, CAST(row_number() OVER (ORDER BY f, token) - 1 AS BIGINT) AS idx, CAST(cnt AS BIGINT) AS cnt
    FROM (SELECT token, min({'c': c, 'o': o, 'p': p}) AS f, count(*) AS cnt FROM (
            SELECT CAST(unnest(inview) AS VARCHAR) AS token, 0 AS c, impression_id AS o, (generate_subscripts(inview, 1)) - 1 AS p FROM impressions
            UNION ALL
            SELECT CAST(unnest(clicked) AS VARCHAR), 1, impression_id, (generate_subscripts(clicked, 1)) - 1 FROM impressions)
          GROUP BY token)"""


def _item_vocab(spark, sf):
    return V.build_vocab(fx.impressions(spark, sf), ["inview", "clicked"], "impression_id", "item")


@query("i1_build_vocab", ("I1",), W(_VOCAB_ITEMS_SQL, "impressions"))
def i1(spark, sf):
    """Item vocabulary over two list columns, indexed by first appearance (impression order, position)."""
    return _item_vocab(spark, sf)


@query("i2_reserved_tokens", ("I2",), W(
    """SELECT * FROM (VALUES ('cat', '[UNUSED0]', 0, 0), ('cat', '[UNUSED1]', 1, 0), ('cat', '[UNUSED2]', 2, 0)) r(vocab, token, idx, cnt)
       UNION ALL
       SELECT 'cat', category, CAST(row_number() OVER (ORDER BY min(item_id), category) + 2 AS BIGINT), CAST(count(*) AS BIGINT)
       FROM items GROUP BY category""", "items"))
def i2(spark, sf):
    """Category vocabulary with 3 reserved leading tokens ([UNUSED0]..[UNUSED2])."""
    return V.build_vocab(fx.items(spark, sf), ["category"], "item_id", "cat", reserved=3)


_ITEM_TOKENS_SQL = """
    SELECT CAST(unnest(inview) AS VARCHAR) AS token, 0 AS c, impression_id AS o, (generate_subscripts(inview, 1)) - 1 AS p FROM impressions
    UNION ALL
    SELECT CAST(unnest(clicked) AS VARCHAR), 1, impression_id, (generate_subscripts(clicked, 1)) - 1 FROM impressions"""


@query("i4_i5_trim_vocab", ("I4", "I5"), W(
    f"""SELECT 'item' AS vocab, token, CAST(row_number() OVER (ORDER BY f, token) - 1 AS BIGINT) AS idx, CAST(cnt AS BIGINT) AS cnt
       FROM (SELECT token, min({{'c': c, 'o': o, 'p': p}}) AS f, count(*) AS cnt FROM ({_ITEM_TOKENS_SQL})
             GROUP BY token HAVING count(*) BETWEEN 30 AND 45)""", "impressions"))
def i4(spark, sf):
    """Item vocabulary trimmed to ids seen 30..45 times; survivors re-indexed in first-appearance order."""
    return V.build_vocab(fx.impressions(spark, sf), ["inview", "clicked"], "impression_id", "item",
                         min_count=30, max_count=45)


@query("i4_trimmed_tokens", ("I4",), W(
    f"SELECT token, CAST(count(*) AS BIGINT) AS cnt FROM ({_ITEM_TOKENS_SQL}) GROUP BY token HAVING count(*) < 30",
    "impressions"))
def i4b(spark, sf):
    """The tokens a min-count-30 trim removes."""
    i = fx.impressions(spark, sf)
    full = _item_vocab(spark, sf)
    kept = V.build_vocab(i, ["inview", "clicked"], "impression_id", "item", min_count=30)
    return V.trimmed_tokens(full, kept)


@query("i6_i3_encode_scalar", ("I6", "I3"), W(
    """WITH v AS (SELECT category AS token, row_number() OVER (ORDER BY min(item_id), category) - 1 AS idx
                  FROM items WHERE has_image GROUP BY category)
       SELECT i.item_id, CAST(coalesce(v.idx, -1) AS BIGINT) AS category FROM items i LEFT JOIN v ON i.category = v.token""",
    "items"))
def i6(spark, sf):
    """Category -> index with a vocabulary built on image items only; unknown -> OOV id -1."""
    it = fx.items(spark, sf)
    v = V.build_vocab(it.filter("has_image"), ["category"], "item_id", "cat")
    return V.encode_scalar(it.select("item_id", "category"), "category", v, oov=-1)


@query("i7_encode_split", ("I7",), W(
    f"""WITH v AS (SELECT token, row_number() OVER (ORDER BY f, token) - 1 AS idx FROM (
                     SELECT token, min({{'o': item_id, 'p': p}}) AS f FROM (
                       SELECT unnest(topics) AS token, item_id, (generate_subscripts(topics, 1)) AS p FROM items
                       WHERE category = 'Brand#1') GROUP BY token)),
            e AS (SELECT b.item_id, b.p, v.idx FROM (SELECT item_id, unnest(string_split(title, ' ')) AS t,
                  (generate_subscripts(string_split(title, ' '), 1)) AS p FROM items) b JOIN v ON b.t = v.token)
       SELECT i.item_id, coalesce({sfl('x.ids')}, '') AS title_ids FROM items i
       LEFT JOIN (SELECT item_id, list(idx ORDER BY p) AS ids FROM e GROUP BY item_id) x ON i.item_id = x.item_id""",
    "items"))
def i7(spark, sf):
    """Space-separated title encoded with the word vocabulary of one category (unknown words dropped)."""
    it = fx.items(spark, sf)
    v = V.build_vocab(it.filter(F.col("category") == "Brand#1"), ["topics"], "item_id", "word")
    e = V.encode_list(it.select("item_id", "title"), "title", v, "item_id", out="title_ids", sep=" ")
    return e.select("item_id", L.fmt_list("title_ids").alias("title_ids"))


@query("i8_encode_list", ("I8",), W(
    f"""WITH v AS ({_VOCAB_ITEMS_SQL})
       SELECT c.impression_id, {sfl('list(v.idx ORDER BY c.pos)')} AS inview_ids
       FROM candidates c JOIN v ON CAST(c.item_id AS VARCHAR) = v.token GROUP BY c.impression_id""",
    "impressions", "candidates"))
def i8(spark, sf):
    """In-view lists encoded with the item vocabulary."""
    i = fx.impressions(spark, sf).select("impression_id", "inview")
    e = V.encode_list(i, "inview", _item_vocab(spark, sf), "impression_id", out="inview_ids")
    return e.select("impression_id", L.fmt_list("inview_ids").alias("inview_ids"))


@query("i9_encode_number", ("I9",), W(
    "SELECT user_id, item_id, strftime(ts, '%Y%m%d') AS day, CAST(rating AS VARCHAR) AS rating FROM ratings", "ratings"))
def i9(spark, sf):
    """Ratings used as their own index with a domain check (< 6)."""
    r = V.encode_number(fx.ratings(spark, sf), "rating", 6)
    return r.select("user_id", "item_id", F.date_format("ts", "yyyyMMdd").alias("day"), L.fmt_list("rating").alias("rating"))


_WORDS_SQL = r"regexp_extract_all(lower(text), '\w+|[^\w\s]')"


@query("i11_encode_words", ("I11",), f"""
    WITH w AS (SELECT conv_id, turn, unnest({_WORDS_SQL}) AS token, (generate_subscripts({_WORDS_SQL}, 1)) - 1 AS p
               FROM conversations),
         v AS (SELECT token, row_number() OVER (ORDER BY f, token) - 1 AS idx FROM (
                 SELECT token, min({{'c': 0, 'o': conv_id * 1000 + turn, 'p': p}}) AS f FROM w GROUP BY token HAVING count(*) >= 3)),
         e AS (SELECT w.conv_id, w.turn, list(v.idx ORDER BY w.p) AS ids FROM w JOIN v ON w.token = v.token GROUP BY ALL)
    SELECT c.conv_id, c.turn, {sfl("list_slice(CASE WHEN len(coalesce(e.ids, [])) > 0 THEN e.ids ELSE [(SELECT idx FROM v WHERE token = ',')] END, 1, 30)")} AS ids
    FROM conversations c LEFT JOIN e ON c.conv_id = e.conv_id AND c.turn = e.turn""")
def i11(spark, sf):
    """Word-level encoding of every conversation turn (vocabulary: words seen >= 3 times), first 30 ids."""
    c = fx.table(spark, sf, "conversations").withColumn("_order", F.col("conv_id") * 1000 + F.col("turn"))
    words = c.select("_order", V.word_tokens("text").alias("w"))
    v = V.build_vocab(words, ["w"], "_order", "english", min_count=3)
    e = V.encode_words(c.select("conv_id", "turn", "text"), "text", v, ["conv_id", "turn"], out="ids", max_length=30)
    return e.select("conv_id", "turn", L.fmt_list("ids").alias("ids"))


_HASHED_SQL = f"""
    SELECT conv_id, turn, array_to_string(list_transform(
             list_concat(list_slice(list_transform({_WORDS_SQL}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 1048576), 1, 16),
                         list_transform(range(greatest(16 - len({_WORDS_SQL}), 0)), lambda x: 0)),
             lambda x: CAST(x AS VARCHAR)), ',') AS ids
    FROM conversations"""


@query("i12_tokenizer_udf", ("I12", "Q-4"), _HASHED_SQL)
def i12(spark, sf):
    """User-supplied tokenizer (md5-hashed word ids) through an Arrow pandas UDF, cut / padded to 16."""
    c = fx.table(spark, sf, "conversations")
    e = V.encode_with_tokenizer(c, "text", "hash", 16, V.default_hash_tokenizer)
    return e.select("conv_id", "turn", L.fmt_list("text_encode_hash").alias("ids"))


@query("i12_default_tokenizer", ("I12",), _HASHED_SQL)
def i12_default(spark, sf):
    """The default tokenizer, by built-in functions alone."""
    e = V.encode_with_tokenizer(fx.table(spark, sf, "conversations"), "text", "hash", 16)
    return e.select("conv_id", "turn", L.fmt_list("text_encode_hash").alias("ids"))


_SPEC = {
    "category": {"vocab": "cat", "kind": "scalar"},
    "subcategory": {"vocab": "cat", "kind": "scalar"},
    "topics": {"vocab": "word", "kind": "list", "max_length": 3, "keep": "head", "pad": -1},
}

_ENC_SQL = """
    WITH cv AS (SELECT token, row_number() OVER (ORDER BY f, token) - 1 AS idx FROM (
                  SELECT token, min({'c': c, 'o': item_id}) AS f FROM (
                    SELECT category AS token, 0 AS c, item_id FROM items UNION ALL SELECT subcategory, 1, item_id FROM items)
                  GROUP BY token)),
         wv AS (SELECT token, row_number() OVER (ORDER BY f, token) - 1 AS idx FROM (
                  SELECT token, min({'o': item_id, 'p': p}) AS f FROM (
                    SELECT unnest(topics) AS token, item_id, (generate_subscripts(topics, 1)) AS p FROM items) GROUP BY token)),
         t AS (SELECT x.item_id, list(wv.idx ORDER BY x.p) AS ids FROM (
                    SELECT item_id, unnest(topics) AS token, (generate_subscripts(topics, 1)) AS p FROM items) x
               JOIN wv ON x.token = wv.token GROUP BY x.item_id)
    SELECT i.item_id, CAST(c1.idx AS BIGINT) AS category, CAST(c2.idx AS BIGINT) AS subcategory,
           array_to_string(list_transform(list_concat(list_slice(t.ids, 1, 3), list_transform(range(greatest(3 - len(list_slice(t.ids, 1, 3)), 0)), lambda z: -1)),
                           lambda z: CAST(z AS VARCHAR)), ',') AS topics
    FROM items i JOIN cv c1 ON i.category = c1.token JOIN cv c2 ON i.subcategory = c2.token JOIN t ON i.item_id = t.item_id"""


def _encoded_items(spark, sf):
    it = fx.items(spark, sf).select("item_id", "category", "subcategory", "topics")
    return V.encode_table(it, _SPEC, "item_id")


@query("i13_encode_table", ("I13", "I17"), W(_ENC_SQL, "items"))
def i13(spark, sf):
    """Declarative encoding of the catalogue: category and sub-category share one vocabulary, topic words another,
    topics cut to 3 and padded with -1."""
    enc, _ = _encoded_items(spark, sf)
    return enc.select("item_id", "category", "subcategory", L.fmt_list("topics").alias("topics"))


@query("a12_a13_encoded_store", ("A12", "A13", "I18"), W(_ENC_SQL, "items"))
def a12(spark, sf):
    """Encoded catalogue saved (data, vocabularies by name, metadata) and loaded back; schema facts checked."""
    enc, vocabs = _encoded_items(spark, sf)
    path = scratch_dir(spark, "encoded_items")
    V.save_encoded(enc, vocabs, path, "item_id", _SPEC)
    data, vocab, meta = V.load_encoded(spark, path)
    assert meta["id_col"] == "item_id" and set(meta["vocabs"]) == {"cat", "word"}
    data = V.with_schema_facts(data, "topics", "word", meta["vocabs"]["word"]["size"], 3)
    assert V.schema_facts(data)["topics"]["is_list"]
    return data.select("item_id", "category", "subcategory", L.fmt_list("topics").alias("topics"))


@query("c17_point_lookup", ("C17",), W(
    f"""WITH v AS ({_VOCAB_ITEMS_SQL}) SELECT CAST(v.idx AS BIGINT) AS idx, i.title FROM items i JOIN v ON CAST(i.item_id AS VARCHAR) = v.token
        WHERE v.token = '7'""", "impressions", "items"))
def c17(spark, sf):
    """Row of the encoded catalogue for external id 7, found through the item vocabulary."""
    v = _item_vocab(spark, sf)
    enc = V.encode_scalar(fx.items(spark, sf).select("item_id", "title"), "item_id", v, out="idx")
    return LK.point_lookup(enc, v, 7).select("idx", "title")


@query("i15_lookup_matrix", ("I15",), W(
    """WITH m AS (SELECT row_number() OVER (ORDER BY item_id) AS idx, embedding FROM item_vectors)
       SELECT idx, round(CAST(embedding[1] AS DOUBLE), 5) + 0.0 AS e1, round(CAST(embedding[64] AS DOUBLE), 5) + 0.0 AS e64 FROM m
       UNION ALL SELECT 0, round(avg(CAST(embedding[1] AS DOUBLE)), 5) + 0.0, round(avg(CAST(embedding[64] AS DOUBLE)), 5) + 0.0
       FROM item_vectors""", "item_vectors"))
def i15(spark, sf):
    """Dense 1..n lookup index + matrix with row 0 = column mean of the vectors."""
    _, mat = V.lookup_matrix(fx.item_vectors(spark, sf), "item_id", "embedding", unknown="mean")
    return mat.select("idx", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("e1"),
                      F.round(F.element_at("embedding", 64).cast("double"), 5).alias("e64"))


@query("i16_user_index", ("I16",), W(
    """SELECT 'user' AS vocab, CAST(user_id AS VARCHAR) AS token,
              CAST(row_number() OVER (ORDER BY min(impression_id), user_id) - 1 AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS cnt
       FROM impressions GROUP BY user_id""", "impressions"))
def i16(spark, sf):
    """User id -> running integer by first appearance."""
    return V.build_vocab(fx.impressions(spark, sf), ["user_id"], "impression_id", "user")


# ---- model-ready examples ---------------------------------------------------------------------------------------
@query("j15_example_table", ("J15", "I14"), W(
    f"""WITH v AS ({_VOCAB_ITEMS_SQL}),
            h AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS hist FROM clicks
                  WHERE item_id IS NOT NULL AND ts < TIMESTAMP '1996-01-01' GROUP BY user_id),
            hx AS (SELECT user_id, unnest(hist) AS item, (generate_subscripts(hist, 1)) AS p FROM h),
            he AS (SELECT hx.user_id, list(coalesce(v.idx + 1, 0) ORDER BY hx.p) AS ids FROM hx LEFT JOIN v ON CAST(hx.item AS VARCHAR) = v.token GROUP BY hx.user_id),
            ce AS (SELECT c.impression_id, list(coalesce(v.idx + 1, 0) ORDER BY c.pos) AS ids FROM candidates c
                   LEFT JOIN v ON CAST(c.item_id AS VARCHAR) = v.token GROUP BY c.impression_id)
       SELECT i.impression_id, coalesce({sfl('he.ids')}, '') AS history_idx, {sfl('ce.ids')} AS candidate_idx
       FROM impressions i LEFT JOIN he ON i.user_id = he.user_id JOIN ce ON i.impression_id = ce.impression_id""",
    "impressions", "candidates", "clicks"))
def j15(spark, sf):
    """Example table: per impression the user's pre-1996 history and the candidates mapped to item indexes
    (index + 1; 0 = unknown), encoded against an existing vocabulary."""
    from recsuite.operators import history as H
    v = _item_vocab(spark, sf).withColumn("idx", F.col("idx") + 1)
    users = fx.impressions(spark, sf).select("impression_id", "user_id", "inview")
    c = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())
    hist = H.fixed_history(c, "1996-01-01", None, attach_to=c.select("user_id").distinct())
    he = V.encode_list(hist, "item_id_fixed", v, "user_id", out="history_idx", policy="oov", oov=0)
    ce = V.encode_list(users, "inview", v, "impression_id", out="candidate_idx", policy="oov", oov=0)
    return ce.join(he.select("user_id", "history_idx"), "user_id", "left").select(
        "impression_id", F.coalesce(L.fmt_list("history_idx"), F.lit("")).alias("history_idx"),
        L.fmt_list("candidate_idx").alias("candidate_idx"))


@query("j16_j17_token_sequence", ("J16", "J17"), W(
    """WITH s AS (SELECT item_id, list_concat([1], [900, 901], [CAST(len(title) AS INTEGER)], [2], [902], list_transform(topics, lambda t: CAST(len(t) AS INTEGER)), [2]) AS seq FROM items)
       SELECT item_id, array_to_string(list_transform(list_concat(list_slice(seq, 1, 6), list_transform(range(6 - len(list_slice(seq, 1, 6))), lambda z: 0)), lambda z: CAST(z AS VARCHAR)), ',') AS tokens,
              array_to_string(list_transform(list_concat(list_transform(range(len(list_slice(seq, 1, 6))), lambda z: 1), list_transform(range(6 - len(list_slice(seq, 1, 6))), lambda z: 0)), lambda z: CAST(z AS VARCHAR)), ',') AS mask
       FROM s""", "items"))
def j16(spark, sf):
    """CLS + per-column prompt ids + column tokens + SEP, fixed width 6 with PAD and mask (token ids here are the
    title length and the topic word lengths)."""
    it = fx.items(spark, sf).select("item_id", F.array(F.length("title")).alias("t"),
                                    F.transform("topics", lambda x: F.length(x)).alias("w"))
    s = J.token_sequence(it, ["t", "w"], 6, cls=1, sep=2, pad=0, prefixes={"t": [900, 901], "w": [902]})
    return s.select("item_id", L.fmt_list("tokens").alias("tokens"), L.fmt_list("tokens_mask").alias("mask"))


@query("j18_flatten_history", ("J18",), W(
    """WITH h AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS hist FROM clicks WHERE item_id IS NOT NULL GROUP BY user_id),
            x AS (SELECT user_id, unnest(hist) AS item_id, (generate_subscripts(hist, 1)) AS p FROM h),
            t AS (SELECT x.user_id, x.p, list_concat(coalesce(list_transform(i.topics, lambda w: CAST(length(w) AS INTEGER)), []), [3]) AS toks
                  FROM x LEFT JOIN items i ON x.item_id = i.item_id)
       SELECT user_id, array_to_string(list_transform(flatten(list(toks ORDER BY p)), lambda z: CAST(z AS VARCHAR)), ',') AS flat
       FROM t GROUP BY user_id""", "clicks", "items"))
def j18(spark, sf):
    """Each user's history flattened into one sequence of item tokens with an item separator (3)."""
    c = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())
    h = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "item_id"))).alias("_h")) \
        .select("user_id", F.transform("_h", lambda e: e["item_id"]).alias("hist"))
    items = fx.items(spark, sf).select("item_id", F.transform("topics", lambda w: F.length(w)).alias("tok"))
    f = J.flatten_history(h, items, "user_id", "hist", "item_id", "tok")
    return f.select("user_id", L.fmt_list("flat").alias("flat"))


@query("j19_history_matrix", ("J19",), W(
    """WITH h AS (SELECT user_id, list(list_transform(i.topics, lambda w: CAST(length(w) AS INTEGER)) ORDER BY c.ts, c.item_id) AS codes
                  FROM clicks c JOIN items i ON c.item_id = i.item_id GROUP BY c.user_id),
            m AS (SELECT user_id, list_transform(list_slice(codes, 1, 4), lambda r: list_concat(list_slice(r, 1, 3), list_transform(range(greatest(3 - len(r), 0)), lambda z: 0))) AS fit FROM h)
       SELECT user_id, array_to_string(list_transform(list_concat(fit, list_transform(range(4 - len(fit)), lambda z: [0, 0, 0])), lambda r: array_to_string(r, ' ')), '|') AS matrix,
              array_to_string(list_concat(list_transform(range(len(fit)), lambda z: 1), list_transform(range(4 - len(fit)), lambda z: 0)), ',') AS mask
       FROM m""", "clicks", "items"))
def j19(spark, sf):
    """History as a 4 x 3 matrix of item codes (topic word lengths), zero rows padding, row mask."""
    c = fx.clicks(spark, sf).join(fx.items(spark, sf), "item_id").withColumn("code", F.transform("topics", lambda w: F.length(w)))
    m = J.first_rows_matrix(c, "user_id", ["ts", "item_id"], "code", 4, 3)
    return m.select("user_id", F.array_join(F.transform("matrix", lambda r: F.array_join(r, " ")), "|").alias("matrix"),
                    L.fmt_list("matrix_mask").alias("mask"))


@query("g9_set_column", ("G9", "I18"), W(
    """WITH v AS (SELECT category AS token, row_number() OVER (ORDER BY min(item_id), category) - 1 AS idx FROM items GROUP BY category)
       SELECT i.item_id, i.title, CAST(v.idx AS BIGINT) AS brand FROM items i JOIN v ON i.category = v.token""", "items"))
def g9(spark, sf):
    """A new encoded column (brand index) added to the catalogue table from an (id, value) table; the value count
    must match the table's rows and the column records its vocabulary."""
    it = fx.items(spark, sf)
    v = V.build_vocab(it, ["category"], "item_id", "brand")
    vals = V.encode_scalar(it.select("item_id", "category"), "category", v).select("item_id", "category")
    out = V.set_column(it.select("item_id", "title"), "item_id", vals, "brand", "brand", v.count())
    assert V.schema_facts(out)["brand"]["vocab"] == "brand"
    return out.select("item_id", "title", "brand")


@query("g10_rename_vocab", ("G10",), W(
    """SELECT 'brand' AS vocab, category AS token, CAST(row_number() OVER (ORDER BY min(item_id), category) - 1 AS BIGINT) AS idx
       FROM items GROUP BY category""", "items"))
def g10(spark, sf):
    """Two equal-size vocabularies merged under one name (sizes checked), and a plain rename."""
    it = fx.items(spark, sf)
    a = V.build_vocab(it, ["category"], "item_id", "cat_a")
    b = V.build_vocab(it, ["category"], "item_id", "cat_b")
    merged = V.rename_vocab(a.unionByName(b), "cat_a", "cat_b")
    renamed = V.rename_vocab(merged, "cat_b", "brand")
    return renamed.select("vocab", "token", "idx")


@query("i17_dataset_config_news", ("I17", "I11", "I13"), W(
    r"""WITH src AS (SELECT i.item_id, i.category AS cat, i.subcategory AS subcat, i.title, coalesce(b.text, '') AS abs
                    FROM items i LEFT JOIN benchmark b ON i.item_id = b.item_id),
            cv AS (SELECT cat, row_number() OVER (ORDER BY min(item_id), cat) - 1 AS idx FROM src GROUP BY cat),
            sv AS (SELECT subcat, row_number() OVER (ORDER BY min(item_id), subcat) - 1 AS idx FROM src GROUP BY subcat)
       SELECT s.item_id, CAST(cv.idx AS BIGINT) AS cat, CAST(sv.idx AS BIGINT) AS subcat,
              CAST(least(len(regexp_extract_all(lower(s.title), '\w+|[^\w\s]')), 20) AS INTEGER) AS n_title,
              CAST(least(len(regexp_extract_all(lower(s.abs), '\w+|[^\w\s]')), 50) AS INTEGER) AS n_abs
       FROM src s JOIN cv ON s.cat = cv.cat JOIN sv ON s.subcat = sv.subcat""", "items"))
def i17(spark, sf):
    """The small-news dataset configuration run by the generic encode job on the catalogue (cat = brand, subcat =
    type, title = name, abs = benchmark text where present): shared word vocabulary for title and abstract, cut to
    20 / 50 tokens."""
    it = fx.items(spark, sf).join(fx.table(spark, sf, "benchmark").withColumnRenamed("text", "abs"), "item_id", "left") \
        .select("item_id", F.col("category").alias("cat"), F.col("subcategory").alias("subcat"), "title",
                F.coalesce("abs", F.lit("")).alias("abs"))
    enc, vocabs = V.encode_table(it, V.DATASET_SPECS["news_small"]["item"], "item_id")
    return enc.select("item_id", "cat", "subcat", F.size("title").alias("n_title"), F.size("abs").alias("n_abs"))
