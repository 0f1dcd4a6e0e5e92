"""Queries for embeddings, clustering and distillation (M, E13/E14, H14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.functions import rng
from recsuite.operators import prep as P
from recsuite.operators import vectors as M
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx

W = fx.with_views
sfl = L.sql_fmt_list

_UM_SQL = """hv AS (SELECT c.user_id, v.embedding FROM clicks c JOIN item_vectors v ON c.item_id = v.item_id WHERE c.ts < TIMESTAMP '1998-01-01'),
             um AS (SELECT user_id, j, avg(CAST(embedding[j] AS DOUBLE)) AS m FROM hv, (SELECT unnest(range(1, 65)) AS j) GROUP BY user_id, j)"""


def _user_vectors(spark, sf):
    h = fx.clicks(spark, sf).filter(F.col("ts") < "1998-01-01")
    return M.user_vectors(h, fx.item_vectors(spark, sf))


@query("m1_dot_scores", ("M1", "E14", "H14"), W(
    f"""WITH {_UM_SQL}
       SELECT c.impression_id, c.pos, round(sum(um.m * CAST(v.embedding[um.j] AS DOUBLE)), 5) + 0.0 AS score
       FROM candidates c JOIN item_vectors v ON c.item_id = v.item_id JOIN um ON um.user_id = c.user_id
       WHERE c.impression_time >= TIMESTAMP '1998-01-01' GROUP BY c.impression_id, c.pos""",
    "candidates", "clicks", "item_vectors"))
def m1(spark, sf):
    """Dot-product scores of later candidates against each user's mean vector of earlier clicked items."""
    c = fx.candidates(spark, sf).filter(F.col("impression_time") >= "1998-01-01").select("impression_id", "pos", "user_id", "item_id")
    s = M.dot_scores(c, _user_vectors(spark, sf), fx.item_vectors(spark, sf))
    return s.select("impression_id", "pos", F.round("score", 5).alias("score"))


@query("e13_weighted_vectors", ("E13", "E12"), W(
    """WITH x AS (SELECT c.impression_id, c.pos, n.n, v.embedding FROM candidates c
                  JOIN (SELECT impression_id, len(inview) AS n FROM impressions) n ON c.impression_id = n.impression_id
                  LEFT JOIN item_vectors v ON c.item_id = v.item_id)
       SELECT impression_id, pos, CASE WHEN embedding IS NULL THEN 'null' ELSE printf('%.5f', round(CAST(embedding[1] AS DOUBLE) * pow(0.5, n - pos - 1), 5) + 0.0) END AS w1
       FROM x""", "candidates", "impressions", "item_vectors"))
def e13(spark, sf):
    """Exponential decay weights (0.5) applied to each in-view item's vector; unknown vector -> [NULL]."""
    from recsuite.operators import lookup as LK
    i = fx.impressions(spark, sf).select("impression_id", "inview")
    v = LK.map_list(i, "inview", fx.item_vectors(spark, sf), "item_id", "embedding", "impression_id", out="vecs")
    w = v.withColumn("w", L.exponential_decay("inview", 0.5)).withColumn("wv", L.weight_vectors("vecs", "w"))
    e = w.select("impression_id", F.posexplode("wv").alias("pos", "v"))
    first = F.element_at("v", 1)
    return e.select("impression_id", F.col("pos").cast("bigint").alias("pos"),
                    F.when(first.isNull(), F.lit("null")).otherwise(F.format_string("%.5f", F.round(first, 5))).alias("w1"))


# ---- K-means: Lloyd's rounds written out -----------------------------------------------------------------------
def _dist_sql(kind: str, a: str, b: str) -> str:
    over = "list_transform(range(1, 65), lambda j: {})"
    if kind == "cosine":
        dot = lambda x, y: f"list_sum({over.format(f'{x}[j] * {y}[j]')})"
        return f"1 - {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})"
    return f"list_sum({over.format(f'pow({a}[j] - {b}[j], 2)')})"


def _lloyd_sql(start: str, rounds: int, kind: str) -> str:
    """CTEs pts(item_id, v) and, after ``rounds`` rounds from the CTE body ``start`` (c, q), last(item_id, c, d)."""
    steps = [f"""pts AS MATERIALIZED (SELECT item_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM item_vectors),
                 q0 AS MATERIALIZED ({start})"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT item_id, c, {_dist_sql(kind, 'p.v', 'q.q')} AS d FROM pts p, q{i} q),
                 a{i} AS MATERIALIZED (SELECT item_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY item_id)""")
        if i < rounds:
            steps.append(f"""q{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM q{i} o LEFT JOIN (
                   SELECT c, list(m ORDER BY j) AS q FROM (SELECT a.c, j, avg(p.v[j]) AS m FROM a{i} a JOIN pts p USING (item_id),
                     range(1, 65) r(j) GROUP BY a.c, j) GROUP BY c) n ON n.c = o.c)""")
    return ", ".join(steps) + f", last AS (SELECT * FROM a{rounds})"


_SEEDED_SQL = f"""SELECT row_number() OVER (ORDER BY o) - 1 AS c, v AS q FROM (
                    SELECT {rng.sql_md5_key(42, 'CAST(item_id AS VARCHAR)')} AS o, v FROM pts ORDER BY o LIMIT 8)"""


@query("m2_kmeans", ("M2",), W(
    f"WITH {_lloyd_sql(_SEEDED_SQL, 5, 'euclidean')} SELECT item_id, CAST(c AS INTEGER) AS cluster, round(d, 5) + 0.0 AS dist FROM last",
    "item_vectors"))
def m2(spark, sf):
    """K-means (k = 8, seeded rows, euclidean, 5 rounds) over the item vectors: every item's cluster and distance."""
    rows, _ = M.kmeans(fx.item_vectors(spark, sf), "embedding", 8, seed=42, key="item_id", tol=0, max_iter=5)
    return rows.select("item_id", "cluster", F.round("dist", 5).alias("dist"))


def _centres(spark, sf):
    """Given centres: the mean vector of every label."""
    v = fx.table(spark, sf, "embeddings").filter(F.col("label").isNotNull())
    return M.mean_vectors(v, "label", "embedding", "centre").withColumnRenamed("label", "cluster")


_MEANS_SQL = """SELECT label AS cluster, list(m ORDER BY j) AS centre FROM (
                  SELECT label, j, avg(CAST(embedding[j] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS j)
                  WHERE label IS NOT NULL GROUP BY label, j) GROUP BY label"""
_CENTRES_SQL = f"""ce AS MATERIALIZED (SELECT *, sqrt(list_sum(list_transform(centre, lambda x: x * x))) AS cn FROM ({_MEANS_SQL})),
                  vv AS (SELECT item_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS vn
                         FROM item_vectors),
                  pd AS (SELECT v.item_id, ce.cluster,
                            list_sum(list_transform(range(1, 65), lambda j: pow(CAST(v.embedding[j] AS DOUBLE) - ce.centre[j], 2))) AS sq,
                            1 - CASE WHEN v.vn * ce.cn > 0 THEN
                                 list_sum(list_transform(range(1, 65), lambda j: CAST(v.embedding[j] AS DOUBLE) * ce.centre[j]))
                                 / (v.vn * ce.cn) ELSE 0 END AS cos
                         FROM vv v, ce)"""
_SNAPPED_SQL = f"""SELECT cluster AS c, arg_min(v, (d, v)) AS q FROM (
                     SELECT m.cluster, p.v, {_dist_sql('cosine', 'p.v', 'm.centre')} AS d FROM pts p, ({_MEANS_SQL}) m) GROUP BY cluster"""


@query("m2_kmeans_warm_start", ("M2",), W(
    f"WITH {_lloyd_sql(_SNAPPED_SQL, 3, 'cosine')} SELECT item_id, CAST(c AS INTEGER) AS cluster, round(d, 5) + 0.0 AS dist FROM last",
    "item_vectors"))
def m2_warm(spark, sf):
    """K-means by cosine distance, started from the labels' mean vectors moved to their nearest items, 3 rounds."""
    rows, _ = M.kmeans(fx.item_vectors(spark, sf), "embedding", 10, distance="cosine", start=_centres(spark, sf), tol=0, max_iter=3)
    return rows.select("item_id", "cluster", F.round("dist", 5).alias("dist"))


@query("m3_assign_nearest", ("M3", "C16"), W(
    f"""WITH {_CENTRES_SQL}
       SELECT item_id, CAST(arg_min(cluster, (sq, cluster)) AS INTEGER) AS cluster, round(min(sq), 5) + 0.0 AS dist FROM pd GROUP BY item_id""",
    "item_vectors"))
def m3(spark, sf):
    """Nearest of the given centres (mean vector of each label) for every item vector."""
    a = M.assign_nearest(fx.item_vectors(spark, sf), "embedding", _centres(spark, sf))
    return a.select("item_id", "cluster", F.round("dist", 5).alias("dist"))


@query("m4_medoids", ("M4",), W(
    f"""WITH {_CENTRES_SQL}, a AS (SELECT item_id, arg_min(cluster, (sq, cluster)) AS cluster, min(sq) AS dist FROM pd GROUP BY item_id)
       SELECT CAST(cluster AS INTEGER) AS cluster, arg_min(item_id, (dist, item_id)) AS item_id FROM a GROUP BY cluster""",
    "item_vectors"))
def m4(spark, sf):
    """The member nearest to each given centre."""
    a = M.assign_nearest(fx.item_vectors(spark, sf), "embedding", _centres(spark, sf))
    return M.medoids(a, "item_id").select("cluster", "item_id")


@query("m10_distance_matrix", ("M10", "H14"), W(
    f"WITH {_CENTRES_SQL} SELECT item_id, CAST(cluster AS INTEGER) AS cluster, round(sq, 5) + 0.0 AS sq_euclidean, round(cos, 5) + 0.0 AS cosine FROM pd",
    "item_vectors"))
def m10(spark, sf):
    """Squared-euclidean and cosine distance matrix of every item vector against the given centres."""
    d = M.distance_matrix(fx.item_vectors(spark, sf), "item_id", "embedding", _centres(spark, sf))
    return d.select("item_id", "cluster", F.round("sq_euclidean", 5).alias("sq_euclidean"), F.round("cosine", 5).alias("cosine"))


# ---- distillation: users by their mean clicked vector and mean topic, items by their vector --------------------
_USERS_SQL = f"""ck AS (SELECT * FROM clicks WHERE item_id IS NOT NULL),
    uv AS (SELECT user_id, list(m ORDER BY j) AS v FROM (
             SELECT c.user_id, j, avg(CAST(e.embedding[j] AS DOUBLE)) AS m FROM ck c JOIN item_vectors e ON c.item_id = e.item_id,
               (SELECT unnest(range(1, 65)) AS j) GROUP BY c.user_id, j) GROUP BY user_id),
    tp AS (SELECT c.user_id, avg(i.sentiment_score) AS t1, avg(CAST(i.has_image AS DOUBLE)) AS t2
           FROM ck c JOIN items i ON c.item_id = i.item_id GROUP BY c.user_id),
    ce AS MATERIALIZED ({_MEANS_SQL}),
    ud AS (SELECT u.user_id, ce.cluster, {_dist_sql('euclidean', 'u.v', 'ce.centre')} AS d FROM uv u JOIN tp USING (user_id), ce),
    ua AS (SELECT user_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM ud GROUP BY user_id),
    us AS (SELECT ua.*, sqrt(d) + 0.5 * sqrt(pow(t1 - avg(t1) OVER (PARTITION BY cluster), 2)
                                             + pow(t2 - avg(t2) OVER (PARTITION BY cluster), 2)) AS score FROM ua JOIN tp USING (user_id)),
    sel AS MATERIALIZED (SELECT cluster, user_id, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score, user_id) AS rank FROM us) WHERE rank <= 3),
    hist AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS h FROM ck GROUP BY user_id),
    mg AS (SELECT cluster, flatten(list(h ORDER BY rank)) AS merged FROM sel JOIN hist USING (user_id) GROUP BY cluster),
    rt AS (SELECT *, CAST(rating > 3 AS INTEGER) AS label FROM ratings WHERE rating <> 3)"""


def _clicked(spark, sf):
    return fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())


def _selected(spark, sf):
    c = _clicked(spark, sf)
    uv = M.user_vectors(c, fx.item_vectors(spark, sf))
    it = fx.items(spark, sf).select("item_id", F.array(F.col("sentiment_score"), F.col("has_image").cast("double")).alias("t"))
    topic = M.mean_vectors(c.join(it, "item_id"), "user_id", "t", "topic", size=2)
    a = M.assign_nearest(uv.join(topic, "user_id"), "user_vector", _centres(spark, sf)).drop("user_vector")
    return M.select_per_cluster(a, "user_id", "topic", 3, 0.5)


def _merged(spark, sf, sel):
    hist = _clicked(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "item_id"))).alias("_h")) \
        .select("user_id", F.transform("_h", lambda e: e["item_id"]).alias("history"))
    return M.merge_histories(sel, hist, "user_id", "history")


def _labelled(spark, sf):
    r = P.binarize_ratings(fx.ratings(spark, sf))
    return r.filter("ts < '1997-01-01'"), r.filter("ts >= '1997-01-01'")


_ORDER = ("user_id", "ts", "item_id", "rating")
_SPLIT_SQL = """SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY user_id, ts, item_id, rating) - 1 AS BIGINT) AS idx,
                       user_id, item_id, label FROM (
                  SELECT 'train' AS split, * FROM rt WHERE ts < TIMESTAMP '1997-01-01' AND label = 1
                  UNION ALL SELECT 'dev' AS split, * FROM rt WHERE ts >= TIMESTAMP '1997-01-01')"""


def _both(train, dev):
    cols = ["idx", "user_id", "item_id", "label"]
    return train.select(F.lit("train").alias("split"), *cols).unionByName(dev.select(F.lit("dev").alias("split"), *cols))


@query("m5_m6_m7_distillation", ("M5", "M6", "M7"), W(
    f"""WITH {_USERS_SQL} SELECT sel.cluster, sel.user_id, CAST(len(mg.merged) AS INTEGER) AS merged_len,
          (SELECT count(*) FROM rt WHERE label = 1 AND ts < TIMESTAMP '1997-01-01' AND user_id IN (SELECT user_id FROM sel)) AS n_distilled
        FROM sel JOIN mg USING (cluster)""", "clicks", "item_vectors", "items", "ratings"))
def m5(spark, sf):
    """Distillation: users (mean vector of clicked items) assigned to the given centres, 3 users per cluster chosen by
    distance + 0.5 * topic distance (topic = mean [sentiment, has_image] of the user's items), their histories
    merged and written back, and the size of the distilled training set."""
    sel = _selected(spark, sf)
    train, _ = M.distilled_sets(*_labelled(spark, sf), sel, "user_id", order=_ORDER, index="idx")
    n_rows = train.agg(F.count(F.lit(1))).scalar()
    return _merged(spark, sf, sel).select("cluster", "user_id", F.size("merged_history").alias("merged_len"), n_rows.alias("n_distilled"))


@query("m6_merged_histories", ("M5", "M6"), W(
    f"WITH {_USERS_SQL} SELECT sel.cluster, sel.user_id, {sfl('mg.merged')} AS merged FROM sel JOIN mg USING (cluster)",
    "clicks", "item_vectors", "items", "ratings"))
def m6(spark, sf):
    """The merged history of each cluster's selected users, written back to each of them."""
    m = _merged(spark, sf, _selected(spark, sf))
    return m.select("cluster", "user_id", L.fmt_list("merged_history").alias("merged"))


@query("m7_distilled_by_users", ("M7", "G8"), W(
    f"WITH {_USERS_SQL}, rt2 AS (SELECT * FROM rt WHERE user_id IN (SELECT user_id FROM sel)) {_SPLIT_SQL.replace('FROM rt ', 'FROM rt2 ')}",
    "clicks", "item_vectors", "items", "ratings"))
def m7_users(spark, sf):
    """Distilled sets of the selected users: their positives before 1997 and all their labelled rows from 1997 on,
    each re-indexed under a total order."""
    return _both(*M.distilled_sets(*_labelled(spark, sf), _selected(spark, sf), "user_id", order=_ORDER, index="idx"))


@query("m7_distilled_by_medoids", ("M7", "M4", "G8"), W(
    f"""WITH {_CENTRES_SQL}, a AS (SELECT item_id, arg_min(cluster, (sq, cluster)) AS cluster, min(sq) AS dist FROM pd GROUP BY item_id),
          me AS (SELECT arg_min(item_id, (dist, item_id)) AS item_id FROM a GROUP BY cluster),
          rt AS (SELECT *, CAST(rating > 3 AS INTEGER) AS label FROM ratings WHERE rating <> 3 AND item_id IN (SELECT item_id FROM me))
        {_SPLIT_SQL}""", "item_vectors", "ratings"))
def m7_items(spark, sf):
    """Distilled sets of the medoid items: positives on them before 1997, all labelled rows on them from 1997 on."""
    a = M.assign_nearest(fx.item_vectors(spark, sf), "embedding", _centres(spark, sf))
    return _both(*M.distilled_sets(*_labelled(spark, sf), M.medoids(a, "item_id"), "item_id", order=_ORDER, index="idx"))


@query("m8_taste_sets", ("M8",), W(
    f"""SELECT c.user_id, {sfl('list_sort(list(DISTINCT i.category))', 'str')} AS taste FROM clicks c JOIN items i ON c.item_id = i.item_id
       GROUP BY c.user_id""", "clicks", "items"))
def m8(spark, sf):
    """Each user's taste set: categories of their clicked items."""
    h = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("user_id").agg(F.collect_list("item_id").alias("h"))
    t = M.taste_sets(h, fx.items(spark, sf), "user_id", "h", "item_id", "category")
    return t.select("user_id", L.fmt_list("taste", "str").alias("taste"))


@query("m8_restrict_histories", ("M8", "B19"), W(
    f"""WITH h AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS hist FROM clicks WHERE item_id IS NOT NULL GROUP BY user_id),
            x AS (SELECT user_id, unnest(hist) AS item_id, generate_subscripts(hist, 1) AS p FROM h)
       SELECT h.user_id, coalesce({sfl('k.kept')}, '') AS kept FROM h LEFT JOIN (
         SELECT user_id, list(item_id ORDER BY p) AS kept FROM x WHERE item_id IN (SELECT item_id FROM item_vectors) GROUP BY user_id) k
       ON h.user_id = k.user_id""", "clicks", "item_vectors"))
def m8b(spark, sf):
    """Histories restricted to the kept items (those with vectors)."""
    c = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull())
    h = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "item_id"))).alias("_h")) \
        .select("user_id", F.transform("_h", lambda e: e["item_id"]).alias("hist"))
    r = M.keep_items_in_histories(h, fx.item_vectors(spark, sf), "user_id", "hist", "item_id")
    return r.select("user_id", L.fmt_list("hist").alias("kept"))


@query("m9_pca", ("M9",))
def m9(spark, sf):
    """Item vectors centred and projected on 4 principal components (absolute values: signs are arbitrary)."""
    p = M.pca(fx.item_vectors(spark, sf), "embedding", 4)
    return p.select("item_id", *[F.round(F.abs(F.element_at("pca", i + 1)), 4).alias(f"pc{i + 1}") for i in range(4)])


@query("m11_embed_texts", ("M11",))
def m11(spark, sf):
    """Batch text embedding of every document (hashing vectors, 64 dims); vector norms reported."""
    e = M.embed_texts(fx.table(spark, sf, "documents").select("doc_id", "text"), "text", 64)
    return e.select("doc_id", F.round(L.norm("text_vector"), 4).alias("norm"))


class CharacterModel:
    """A model of our own for the test tables: numbers of characters by code point modulo 8."""

    def __call__(self, texts):
        out = []
        for t in texts:
            n = [0] * 8
            for c in t:
                n[ord(c) % 8] += 1
            out.append(n)
        return out


@query("m11_model_vectors", ("M11",), """
    WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text IS NOT NULL AND text <> ''),
         n AS (SELECT doc_id, unicode(ch) % 8 AS j, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT d.doc_id, array_to_string(list(CAST(coalesce(n.n, 0) AS VARCHAR) ORDER BY r.j), ',') AS vector
    FROM documents d CROSS JOIN range(8) r(j) LEFT JOIN n ON n.doc_id = d.doc_id AND n.j = r.j WHERE d.text IS NOT NULL GROUP BY d.doc_id
    UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def m11_model(spark, sf):
    """A user's model over every document through the vector table: vectors written once, then read."""
    from recsuite.sources.io import scratch_dir
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    t = M.embedding_table(docs, "doc_id", "text", scratch_dir(spark, "m11_vectors"), model_factory=CharacterModel)
    return t.select("doc_id", L.fmt_list(F.col("text_vector").cast("array<bigint>")).alias("vector"))
