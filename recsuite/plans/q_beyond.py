"""Queries for beyond-accuracy metrics (L) over in-view lists (R), clicked lists (H) and item vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.functions import rng
from recsuite.operators import beyond as B
from recsuite.operators import sampling as S
from recsuite.operators import stats as D
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx

W = fx.with_views
SEED = 42

_U = """u AS (SELECT c.impression_id, c.pos, list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) AS e,
                     sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm
              FROM candidates c JOIN item_vectors v ON c.item_id = v.item_id)"""
_COS = "CASE WHEN a.nrm > 0 AND b.nrm > 0 THEN list_dot_product(a.e, b.e) / (a.nrm * b.nrm) ELSE 0 END"


def _R(spark, sf):
    return fx.impressions(spark, sf).select(F.col("impression_id").alias("list_id"), F.col("inview").alias("items"))


def _H(spark, sf):
    return fx.impressions(spark, sf).filter(F.size("clicked") > 0).select(
        F.col("impression_id").alias("list_id"), F.col("clicked").alias("items"))


@query("l1_intra_list_diversity", ("L1",), W(
    f"""WITH {_U},
            p AS (SELECT a.impression_id, sum(1 - {_COS}) AS s FROM u a JOIN u b ON a.impression_id = b.impression_id AND a.pos <> b.pos
                  GROUP BY a.impression_id),
            n AS (SELECT impression_id, count(*) AS n FROM u GROUP BY impression_id)
       SELECT i.impression_id AS list_id, round(CASE WHEN n.n > 1 THEN greatest(0, coalesce(p.s, 0) / (n.n * (n.n - 1))) END, 6) AS diversity
       FROM impressions i LEFT JOIN n ON i.impression_id = n.impression_id LEFT JOIN p ON i.impression_id = p.impression_id""",
    "impressions", "candidates", "item_vectors"))
def l1(spark, sf):
    """Intra-list cosine diversity of every in-view list over its items with vectors (closed form, no pairs)."""
    d = B.intra_list_diversity(_R(spark, sf), fx.item_vectors(spark, sf))
    return d.select("list_id", F.round("diversity", 6).alias("diversity"))


@query("l2_serendipity", ("L2",), W(
    f"""WITH {_U},
            h AS (SELECT x.impression_id, u.e, u.nrm FROM (SELECT impression_id, unnest(clicked) AS item_id FROM impressions) x
                  JOIN item_vectors v ON x.item_id = v.item_id
                  JOIN u ON u.impression_id = x.impression_id AND u.pos = (SELECT min(pos) FROM candidates c WHERE c.impression_id = x.impression_id AND c.item_id = x.item_id))
       SELECT a.impression_id AS list_id, round(avg(1 - {_COS}), 6) + 0.0 AS serendipity
       FROM u a JOIN h b ON a.impression_id = b.impression_id GROUP BY a.impression_id
       UNION ALL
       SELECT impression_id, NULL FROM impressions WHERE len(clicked) > 0 AND impression_id NOT IN (
         SELECT a.impression_id FROM u a JOIN h b ON a.impression_id = b.impression_id)""",
    "impressions", "candidates", "item_vectors"))
def l2(spark, sf):
    """Serendipity: mean cosine distance between in-view items and clicked items of each impression."""
    s = B.serendipity(_H(spark, sf), _R(spark, sf), fx.item_vectors(spark, sf))
    return s.select("list_id", F.round("serendipity", 6).alias("serendipity"))


_POP_SQL = """pop AS (SELECT item_id, count(*) / (SELECT count(*) FROM impressions) AS popularity
                      FROM (SELECT DISTINCT impression_id, unnest(inview) AS item_id FROM impressions) GROUP BY item_id)"""


@query("l3_l4_novelty_sentiment", ("L3", "L4", "H11"), W(
    f"""WITH {_POP_SQL}
       SELECT c.impression_id AS list_id, round(avg(-log2(p.popularity)), 6) AS novelty, round(avg(i.sentiment_score), 6) AS sentiment
       FROM candidates c JOIN pop p ON c.item_id = p.item_id JOIN items i ON c.item_id = i.item_id GROUP BY c.impression_id""",
    "impressions", "candidates", "items"))
def l3(spark, sf):
    """Novelty (mean -log2 popularity) and mean sentiment of every in-view list."""
    R = _R(spark, sf)
    pop = D.popularity(fx.impressions(spark, sf), "inview")
    n = B.novelty(R, pop)
    s = B.mean_attribute(R, fx.items(spark, sf), "sentiment_score", out="sentiment")
    return n.join(s, "list_id").select("list_id", F.round("novelty", 6).alias("novelty"),
                                        F.round("sentiment", 6).alias("sentiment"))


@query("l5_coverage", ("L5",), W(
    """SELECT count(DISTINCT item_id) AS coverage_count, round(count(DISTINCT item_id) / (SELECT count(*) FROM items), 6) AS coverage_fraction
       FROM (SELECT item_id FROM (SELECT impression_id, item_id, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos DESC) AS r
             FROM candidates) WHERE r <= 3)""", "candidates", "items"))
def l5(spark, sf):
    """Coverage of the top-3-by-score lists over the catalogue."""
    imp = fx.impressions(spark, sf).select(
        "impression_id", "inview", F.expr("transform(inview, x -> ((x * 7919 + impression_id * 104729) % 11) / 10)").alias("s"))
    ranks = imp.withColumn("r", L.rank_in_list("s"))
    lists = ranks.select(F.filter(F.arrays_zip("inview", "r"), lambda z: z["r"] <= 3).alias("z")) \
        .select(F.transform("z", lambda z: z["inview"]).alias("items"))
    cov = B.coverage(lists, fx.items(spark, sf))
    return cov.select("coverage_count", F.round("coverage_fraction", 6).alias("coverage_fraction"))


_CANDS_SQL = "cand AS (SELECT i.item_id FROM items i JOIN item_vectors v ON i.item_id = v.item_id WHERE i.category = 'Brand#1')"


def _cands(spark, sf):
    it = fx.items(spark, sf).filter(F.col("category") == "Brand#1")
    return it.join(fx.item_vectors(spark, sf), "item_id", "left_semi").select("item_id")


@query("l6_candidate_diversity_bounds", ("L6",), W(
    f"""WITH {_CANDS_SQL},
            u AS (SELECT c.item_id, list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) AS e,
                         sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm
                  FROM cand c JOIN item_vectors v ON c.item_id = v.item_id),
            d AS (SELECT x.item_id AS i1, y.item_id AS i2, 1 - CASE WHEN x.nrm > 0 AND y.nrm > 0 THEN list_dot_product(x.e, y.e) / (x.nrm * y.nrm) ELSE 0 END AS dist
                  FROM u x JOIN u y ON x.item_id <> y.item_id),
            t AS (SELECT a.item_id AS a, b.item_id AS b, c.item_id AS c FROM cand a JOIN cand b ON a.item_id < b.item_id JOIN cand c ON b.item_id < c.item_id),
            s AS (SELECT (d1.dist + d2.dist + d3.dist) / 3 AS div FROM t JOIN d d1 ON d1.i1 = t.a AND d1.i2 = t.b
                  JOIN d d2 ON d2.i1 = t.a AND d2.i2 = t.c JOIN d d3 ON d3.i1 = t.b AND d3.i2 = t.c)
       SELECT round(min(div), 6) AS min_diversity, round(max(div), 6) AS max_diversity FROM s""",
    "items", "item_vectors"))
def l6(spark, sf):
    """Min / max diversity over 3-item subsets of one category's candidates, all combinations (the
    feature is bounded by its candidate list)."""
    b = B.candidate_diversity_bounds(_cands(spark, sf), fx.item_vectors(spark, sf), 3, SEED, mode="all")
    return b.select(F.round("min_diversity", 6).alias("min_diversity"), F.round("max_diversity", 6).alias("max_diversity"))


@query("l7_l8_candidate_bounds", ("L7", "L8"), W(
    f"""WITH {_POP_SQL}, c AS (SELECT i.item_id, -log2(p.popularity) AS nov, i.sentiment_score AS sen
                           FROM items i JOIN pop p ON i.item_id = p.item_id)
       SELECT 'novelty' AS attr, round((SELECT avg(nov) FROM (SELECT nov FROM c ORDER BY nov DESC, item_id LIMIT 5)), 6) AS from_highest,
              round((SELECT avg(nov) FROM (SELECT nov FROM c ORDER BY nov, item_id LIMIT 5)), 6) AS from_lowest
       UNION ALL
       SELECT 'sentiment', round((SELECT avg(sen) FROM (SELECT sen FROM c ORDER BY sen DESC, item_id LIMIT 5)), 6),
              round((SELECT avg(sen) FROM (SELECT sen FROM c ORDER BY sen, item_id LIMIT 5)), 6)""", "impressions", "items"))
def l7(spark, sf):
    """Mean of the 5 highest / 5 lowest novelty and sentiment values among all items that were shown."""
    pop = D.popularity(fx.impressions(spark, sf), "inview")
    cands = pop.select("item_id")
    a = B.candidate_bounds(cands, pop, "popularity", 5, transform=lambda c: -F.log2(c)).withColumn("attr", F.lit("novelty"))
    b = B.candidate_bounds(cands, fx.items(spark, sf), "sentiment_score", 5).withColumn("attr", F.lit("sentiment"))
    u = a.unionByName(b)
    return u.select("attr", F.round("from_highest", 6).alias("from_highest"), F.round("from_lowest", 6).alias("from_lowest"))


@query("l9_attribute_distribution", ("L9",), W(
    """SELECT 'category' AS attr, value, round(n / sum(n) OVER (), 6) AS share FROM (
         SELECT i.category AS value, count(*) AS n FROM candidates c JOIN items i ON c.item_id = i.item_id GROUP BY 1)
       UNION ALL
       SELECT 'topics', value, round(n / sum(n) OVER (), 6) FROM (
         SELECT unnest(i.topics) AS value, count(*) AS n FROM candidates c JOIN items i ON c.item_id = i.item_id GROUP BY 1)""",
    "candidates", "items"))
def l9(spark, sf):
    """Distribution of a scalar (category) and a list attribute (topics) over all in-view items."""
    R, it = _R(spark, sf), fx.items(spark, sf)
    a = B.attribute_distribution(R, it, "category").withColumn("attr", F.lit("category"))
    b = B.attribute_distribution(R, it, "topics").withColumn("attr", F.lit("topics"))
    return a.unionByName(b).select("attr", "value", F.round("share", 6).alias("share"))


_BASELINES_SQL = f"""
    WITH inv AS (SELECT item_id, count(*) AS n FROM candidates GROUP BY item_id),
         editorial AS (SELECT 'editorial' AS list, item_id, row_number() OVER (ORDER BY n DESC, item_id) AS r FROM inv),
         popular AS (SELECT 'popular' AS list, item_id, row_number() OVER (ORDER BY total_pageviews DESC, item_id) AS r FROM items),
         newest AS (SELECT 'newest' AS list, item_id, row_number() OVER (ORDER BY first_seen DESC, item_id) AS r FROM (
                      SELECT item_id, min(ts) AS first_seen FROM clicks WHERE item_id IS NOT NULL GROUP BY item_id)),
         random AS (SELECT 'random' AS list, item_id, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', item_id)), item_id) AS r FROM items)
    SELECT list, array_to_string(list(CAST(item_id AS VARCHAR) ORDER BY r), ',') AS items FROM (
      SELECT * FROM editorial WHERE r <= 10 UNION ALL SELECT * FROM popular WHERE r <= 10 UNION ALL SELECT * FROM newest WHERE r <= 10
      UNION ALL SELECT * FROM random WHERE r <= 10)
    GROUP BY list"""


def baseline_lists(spark, sf, n=10):
    """Editorial (most in-view), popular (page views), newest (first seen) and random (seeded) top-n lists, one row
    each."""
    c = fx.candidates(spark, sf)
    inv = c.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    first = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("ts").alias("first_seen"))
    items = fx.items(spark, sf).select("item_id", rng.md5_key(SEED, F.col("item_id")).alias("key"))
    out = None
    for name, df, col in (("editorial", inv, "n"), ("popular", fx.items(spark, sf), "total_pageviews"),
                          ("newest", first, "first_seen"), ("random", items, "key")):
        order = [F.col(col).asc() if name == "random" else F.col(col).desc(), F.col("item_id")]
        top = S.top_n(df.select("item_id", col), order, n) \
            .withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # n rows after the limit
        row = top.agg(F.array_sort(F.collect_list(F.struct("_r", "item_id"))).alias("_l")) \
            .select(F.lit(name).alias("list"), F.transform("_l", lambda e: e["item_id"]).alias("items"))
        out = row if out is None else out.unionByName(row)
    return out


@query("l10_baseline_lists", ("L10", "F4", "F20"), W(_BASELINES_SQL, "candidates", "items", "clicks"))
def l10(spark, sf):
    """Baseline recommendation lists: editorial, popular, newest, random (top 10 each)."""
    return baseline_lists(spark, sf).select("list", L.fmt_list("items").alias("items"))


_LISTS_SQL = _BASELINES_SQL.split("    SELECT list, array_to_string")[0].replace("WITH inv", "inv", 1)


@query("l11_baseline_report", ("L11", "L13", "L14", "D18"), W(
    f"""WITH {_LISTS_SQL},
            lists AS (SELECT * FROM editorial WHERE r <= 10 UNION ALL SELECT * FROM popular WHERE r <= 10
                      UNION ALL SELECT * FROM newest WHERE r <= 10 UNION ALL SELECT * FROM random WHERE r <= 10),
            v AS (SELECT item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
                         sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm FROM item_vectors),
            lu AS (SELECT l.list, l.item_id, v.e, v.nrm FROM lists l JOIN v ON l.item_id = v.item_id),
            hu AS (SELECT x.impression_id, v.e, v.nrm FROM (SELECT impression_id, unnest(clicked) AS item_id FROM impressions) x
                   JOIN v ON x.item_id = v.item_id),
            s AS (SELECT a.list, b.impression_id, avg(1 - {_COS}) AS v FROM lu a, hu b GROUP BY ALL),
            {_POP_SQL},
            m AS (SELECT list, 'serendipity' AS metric, avg(v) AS mean, stddev_pop(v) AS std FROM s GROUP BY list
                  UNION ALL SELECT a.list, 'diversity', avg(1 - {_COS}), 0 FROM lu a JOIN lu b ON a.list = b.list AND a.item_id <> b.item_id GROUP BY a.list
                  UNION ALL SELECT l.list, 'novelty', avg(-log2(p.popularity)), 0 FROM lists l JOIN pop p ON l.item_id = p.item_id GROUP BY l.list
                  UNION ALL SELECT l.list, 'sentiment_score', avg(i.sentiment_score), 0 FROM lists l JOIN items i ON l.item_id = i.item_id GROUP BY l.list)
       SELECT n.list, k.metric, round(m.mean, 6) AS mean, round(CAST(m.std AS DOUBLE), 6) AS std
       FROM (SELECT DISTINCT list FROM lists) n CROSS JOIN (SELECT unnest(['serendipity', 'diversity', 'novelty', 'sentiment_score']) AS metric) k
       LEFT JOIN m ON m.list = n.list AND m.metric = k.metric""", "impressions", "candidates", "items", "clicks", "item_vectors"))
def l11(spark, sf):
    """Every baseline list (editorial, popular, newest, random) given to every user with clicks: mean / population std
    over users of serendipity against the user's clicks, and the list's diversity, novelty and sentiment.  The
    four-row list table is materialised once (checkpoint in the shared folder) since checks and the report all
    read it."""
    from recsuite.session import cut_lineage
    lists = cut_lineage(baseline_lists(spark, sf))
    users = _H(spark, sf)
    items = fx.items(spark, sf)
    B.check_attribute(items, "sentiment_score")
    # the candidate-list consistency check (L13) on one list as every user receives it
    B.check_consistent_lists(B.broadcast_list(users.select("list_id"), lists.filter(F.col("list") == "popular"),
                                              "list_id", "items"), "items")
    pop = D.popularity(fx.impressions(spark, sf), "inview")
    rep = B.baseline_report(lists, users, fx.item_vectors(spark, sf), pop, items)
    return rep.select("list", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("l12_item_lookup_table", ("L12", "B22", "D16", "C2"), W(
    """WITH ids AS (SELECT DISTINCT item_id FROM (SELECT item_id FROM candidates UNION ALL SELECT unnest(clicked) FROM impressions)),
            f AS (SELECT item_id, strftime(min(ts), '%Y-%m-%d') AS first_seen FROM clicks WHERE item_id IS NOT NULL GROUP BY item_id),
            t AS (SELECT d.item_id, f.first_seen, coalesce(NULLIF(i.total_pageviews, 0), 1) AS pageviews, v.embedding IS NOT NULL AS has_vector
                  FROM ids d JOIN items i ON d.item_id = i.item_id LEFT JOIN f ON d.item_id = f.item_id LEFT JOIN item_vectors v ON d.item_id = v.item_id)
       SELECT item_id, first_seen, pageviews, round(pageviews / max(pageviews) OVER (), 6) AS popularity, has_vector FROM t""",
    "candidates", "impressions", "clicks", "items", "item_vectors"))
def l12(spark, sf):
    """Item lookup table for the report: candidate and history ids, first-seen date as text, page views (0 -> 1),
    popularity = page views / max, vector presence."""
    from recsuite.operators import lookup as LK
    from recsuite.operators import prep as P
    i = fx.impressions(spark, sf)
    ids = P.distinct_ids(i, None, ["inview", "clicked"], out="item_id")
    first = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_seen"))
    it = fx.items(spark, sf).select("item_id", F.when(F.col("total_pageviews") != 0, F.col("total_pageviews")).alias("pageviews"))
    t = ids.join(it, "item_id").join(first, "item_id", "left")
    t = P.fill_constants(t, {"pageviews": 1})
    t = D.normalize(t, "pageviews", "max", out="popularity")
    t = LK.attach_embeddings(t, fx.item_vectors(spark, sf))
    return t.select("item_id", "first_seen", F.col("pageviews").cast("bigint").alias("pageviews"),
                    F.round("popularity", 6).alias("popularity"), F.col("embedding").isNotNull().alias("has_vector"))


@query("q1_pluggable_distance", ("Q-1",), W(
    f"""WITH {_U},
            p AS (SELECT a.impression_id, sum(list_distance(a.e, b.e) * list_distance(a.e, b.e)) AS s
                  FROM u a JOIN u b ON a.impression_id = b.impression_id AND a.pos <> b.pos GROUP BY a.impression_id),
            n AS (SELECT impression_id, count(*) AS n FROM u GROUP BY impression_id)
       SELECT n.impression_id AS list_id, CASE WHEN n.n > 1 THEN round(p.s / (n.n * (n.n - 1)), 4) END AS diversity
       FROM n LEFT JOIN p ON n.impression_id = p.impression_id""", "impressions", "candidates", "item_vectors"))
def q1(spark, sf):
    """Intra-list diversity with a pluggable distance (squared euclidean) through the explicit pair path."""
    d = B.pairwise_mean_distance(_R(spark, sf), fx.item_vectors(spark, sf), L.sq_euclidean)
    return d.select("list_id", F.round("diversity", 4).alias("diversity"))


@query("q1_pluggable_serendipity", ("Q-1", "L2"), W(
    f"""WITH {_U},
            h AS (SELECT x.impression_id, list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) AS e
                  FROM (SELECT impression_id, unnest(clicked) AS item_id FROM impressions) x
                  JOIN item_vectors v ON x.item_id = v.item_id),
            s AS (SELECT a.impression_id, avg(list_distance(a.e, b.e) * list_distance(a.e, b.e)) AS v
                  FROM u a JOIN h b ON a.impression_id = b.impression_id GROUP BY a.impression_id)
       SELECT i.impression_id AS list_id, round(s.v, 4) AS serendipity
       FROM impressions i LEFT JOIN s ON i.impression_id = s.impression_id WHERE len(i.clicked) > 0""",
    "impressions", "candidates", "item_vectors"))
def q1_serendipity(spark, sf):
    """Serendipity with a pluggable distance (squared euclidean) between in-view and clicked items."""
    s = B.pairwise_serendipity(_H(spark, sf), _R(spark, sf), fx.item_vectors(spark, sf), L.sq_euclidean)
    return s.select("list_id", F.round("serendipity", 4).alias("serendipity"))


_SAMPLES = 5000


@query("l6_sampled_diversity_bounds", ("L6",), W(
    f"""WITH RECURSIVE cand AS (SELECT i.item_id, row_number() OVER (ORDER BY i.item_id) - 1 AS idx,
                                     list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) AS e
                              FROM items i JOIN item_vectors v ON i.item_id = v.item_id),
            nn AS (SELECT count(*) AS n FROM cand),
            st AS (SELECT range AS subset_id, 0 AS k, []::INTEGER[] AS si, []::INTEGER[] AS sv, []::INTEGER[] AS out FROM range({_SAMPLES})
                   UNION ALL
                   SELECT subset_id, k + 1, list_concat(si, [k, j]), list_concat(sv, [vb, va]), list_concat(out, [vb]) FROM (
                     SELECT *, coalesce(list_reverse(sv)[list_position(list_reverse(si), k)], k) AS va,
                               coalesce(list_reverse(sv)[list_position(list_reverse(si), j)], j) AS vb FROM (
                       SELECT st.*, CAST(k + ('0x' || substr(md5(concat_ws('|', '{SEED}', subset_id, k)), 1, 8))::BIGINT % (nn.n - k) AS INTEGER) AS j
                       FROM st, nn WHERE k < 3))),
            m AS (SELECT subset_id, c.item_id, c.e, sqrt(list_dot_product(c.e, c.e)) AS nrm
                  FROM (SELECT subset_id, unnest(out) AS idx FROM st WHERE k = 3) x JOIN cand c ON x.idx = c.idx),
            d AS (SELECT a.subset_id, avg(1 - {_COS}) AS div FROM m a JOIN m b ON a.subset_id = b.subset_id AND a.item_id <> b.item_id
                  GROUP BY a.subset_id)
       SELECT round(min(div), 6) AS min_diversity, round(max(div), 6) AS max_diversity FROM d""", "items", "item_vectors"))
def l6_sampled(spark, sf):
    """Min / max diversity over seeded random 3-item subsets of the whole catalogue."""
    cands = fx.items(spark, sf).join(fx.item_vectors(spark, sf), "item_id", "left_semi").select("item_id")
    b = B.candidate_diversity_bounds(cands, fx.item_vectors(spark, sf), 3, SEED, mode="sample", n_samples=_SAMPLES)
    return b.select(F.round("min_diversity", 6).alias("min_diversity"), F.round("max_diversity", 6).alias("max_diversity"))
