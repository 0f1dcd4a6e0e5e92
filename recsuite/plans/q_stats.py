"""Queries for descriptive analytics (D), ranking/sampling/splitting (F) and labels/negatives (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.functions import rng
from recsuite.operators import history as H
from recsuite.operators import labels as J
from recsuite.operators import prep as P
from recsuite.operators import sampling as S
from recsuite.operators import stats as D
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx

W = fx.with_views
sfl = L.sql_fmt_list
SEED = 42


def _key(*parts):
    return f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"


def _draw(*parts):
    return f"('0x' || substr({_key(*parts)}, 1, 8))::BIGINT"


# ---- D ------------------------------------------------------------------------------------------------------------
@query("d1_d2_time_spans", ("D1", "D2"), W(
    """SELECT (SELECT strftime(min(ts), '%Y-%m-%d') FROM clicks) AS hist_min, (SELECT strftime(max(ts), '%Y-%m-%d') FROM clicks) AS hist_max,
              strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS log_min, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS log_max FROM events""",
    "clicks"))
def d1_d2(spark, sf):
    """Span of per-user timestamp lists (nested) and of the event log (flat)."""
    lists = fx.clicks(spark, sf).groupBy("user_id").agg(F.collect_list("ts").alias("times"))
    a = D.nested_time_span(lists, "times").select(F.date_format("min", "yyyy-MM-dd").alias("hist_min"),
                                                  F.date_format("max", "yyyy-MM-dd").alias("hist_max"))
    b = D.time_span(fx.table(spark, sf, "events"), "ts")
    return a.select("*", F.date_format(b.select("min").scalar(), "yyyy-MM-dd HH:mm:ss").alias("log_min"),
                    F.date_format(b.select("max").scalar(), "yyyy-MM-dd HH:mm:ss").alias("log_max"))


@query("d3_max_length_attached", "D3", W(
    "SELECT impression_id, CAST((SELECT max(len(inview)) FROM impressions) AS INTEGER) AS max_length FROM impressions",
    "impressions"))
def d3(spark, sf):
    """The maximum in-view length attached to every impression."""
    return D.with_max_length(fx.impressions(spark, sf), "inview").select("impression_id", "max_length")


_TOKENS_SQL = "SELECT token, count(*) AS count FROM (SELECT unnest(inview) AS token FROM impressions UNION ALL SELECT unnest(clicked) FROM impressions) GROUP BY token"


@query("d4_token_counts", "D4", W(_TOKENS_SQL, "impressions"))
def d4(spark, sf):
    """Occurrence counts of item ids over two list columns sharing one vocabulary."""
    return D.token_counts(fx.impressions(spark, sf), ["inview", "clicked"])


@query("d5_log_decade_histogram", "D5", W(
    f"""SELECT CAST(floor(count / pow(10, length(CAST(count AS VARCHAR)) - 1)) * pow(10, length(CAST(count AS VARCHAR)) - 1) AS BIGINT) AS lo,
              CAST(floor(count / pow(10, length(CAST(count AS VARCHAR)) - 1)) * pow(10, length(CAST(count AS VARCHAR)) - 1) + pow(10, length(CAST(count AS VARCHAR)) - 1) AS BIGINT) AS hi,
              count(*) AS n
       FROM ({_TOKENS_SQL}) GROUP BY ALL""", "impressions"))
def d5(spark, sf):
    """Vocabulary frequency summary in log-decade bins [k*10^d, (k+1)*10^d)."""
    return D.log_decade_histogram(D.token_counts(fx.impressions(spark, sf), ["inview", "clicked"]))


@query("d6_length_summary", "D6", W(
    "SELECT CAST(min(len(inview)) AS INTEGER) AS min_len, CAST(max(len(inview)) AS INTEGER) AS max_len, round(avg(len(inview)), 6) AS mean_len FROM impressions",
    "impressions"))
def d6(spark, sf):
    """min / max / mean of the in-view list length."""
    return D.length_summary(fx.impressions(spark, sf), "inview").select(
        "min_len", "max_len", F.round("mean_len", 6).alias("mean_len"))


@query("d7_equal_width_histogram", "D7", W(
    """WITH s AS (SELECT min(total_pageviews) AS mn, max(total_pageviews) AS mx FROM items),
            p AS (SELECT mn, CAST(ceil((mx - mn + 1) / least(10, mx - mn + 1)) AS BIGINT) AS w, mx FROM s),
            b AS (SELECT unnest(range(0, CAST(ceil((mx - mn + 1) / w) AS BIGINT))) AS bin, mn, w FROM p),
            c AS (SELECT CAST((total_pageviews - mn) // w AS BIGINT) AS bin, count(*) AS n FROM items, p GROUP BY 1)
       SELECT b.bin, b.mn + b.bin * b.w AS lo, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM b LEFT JOIN c ON b.bin = c.bin""",
    "items"))
def d7(spark, sf):
    """Equal-width histogram of item page views, at most 10 groups, empty bins included."""
    return D.equal_width_histogram(fx.items(spark, sf), "total_pageviews", 10)


_EXP_SQL = """exp AS (SELECT e.impression_id, e.item_id, e.is_click, it.has_image AS attr FROM (
                SELECT impression_id, unnest(inview) AS item_id, NULL AS is_click, clicked FROM impressions) x0
              , LATERAL (SELECT x0.impression_id, x0.item_id, CAST(coalesce(list_contains(x0.clicked, x0.item_id), false) AS INTEGER) AS is_click) e
              LEFT JOIN items it ON e.item_id = it.item_id)"""


def _exp_sql(body):
    return W("WITH " + _EXP_SQL + "\n" + body, "impressions", "items")


def _exp(spark, sf):
    return D.exposures(fx.impressions(spark, sf), fx.items(spark, sf), "has_image")


@query("d8_ctr_by_attribute", "D8", _exp_sql(
    """SELECT attr, count(*) AS shown, CAST(sum(is_click) AS BIGINT) AS clicked, round(sum(is_click) / count(*), 6) AS ctr
       FROM exp GROUP BY attr
       UNION ALL SELECT NULL, count(*), CAST(sum(is_click) AS BIGINT), round(sum(is_click) / count(*), 6) FROM exp"""))
def d8(spark, sf):
    """Shown / clicked / CTR by has-image, plus the overall row (attr NULL)."""
    return D.ctr_by_attribute(_exp(spark, sf)).withColumn("ctr", F.round("ctr", 6))


@query("d9_exposure_shares", "D9", _exp_sql(
    """SELECT round(sum(n_without) / sum(n), 6) AS share_exposures_without,
              round(avg(CAST(n_without > 0 AS DOUBLE)), 6) AS share_impressions_with_any
       FROM (SELECT impression_id, count(*) FILTER (WHERE NOT coalesce(attr, false)) AS n_without, count(*) AS n
             FROM exp GROUP BY impression_id)"""))
def d9(spark, sf):
    """Share of exposures without an image; share of impressions showing at least one such item."""
    r = D.exposure_shares(_exp(spark, sf))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("d10_ctr_by_segment", "D10", _exp_sql(
    """SELECT CASE WHEN a = 1 THEN 'only_attr' ELSE 'mixed' END AS segment, count(*) AS impressions,
              CAST(sum(shown) AS BIGINT) AS shown, CAST(sum(clicked) AS BIGINT) AS clicked,
              round(sum(clicked) / sum(shown), 6) AS ctr
       FROM (SELECT impression_id, min(coalesce(CAST(attr AS INTEGER), 0)) AS a, count(*) AS shown, sum(is_click) AS clicked
             FROM exp GROUP BY impression_id) GROUP BY 1"""))
def d10(spark, sf):
    """CTR of impressions showing only image items vs mixed ones."""
    return D.ctr_by_segment(_exp(spark, sf)).withColumn("ctr", F.round("ctr", 6))


@query("d11_distinct_item_counts", "D11", _exp_sql(
    """SELECT count(DISTINCT item_id) AS n_items, count(DISTINCT item_id) FILTER (WHERE coalesce(attr, false)) AS n_with_attr,
              count(DISTINCT item_id) FILTER (WHERE coalesce(attr, false) AND is_click = 1) AS n_clicked_with_attr FROM exp"""))
def d11(spark, sf):
    """Distinct items shown / shown with an image / clicked with an image."""
    return D.distinct_item_counts(_exp(spark, sf))


@query("d12_popularity", "D12", W(
    """SELECT item_id, round(count(*) / (SELECT count(*) FROM impressions), 6) AS popularity
       FROM (SELECT DISTINCT impression_id, unnest(inview) AS item_id FROM impressions) GROUP BY item_id""", "impressions"))
def d12(spark, sf):
    """Share of in-view lists containing each item."""
    return D.popularity(fx.impressions(spark, sf), "inview").withColumn("popularity", F.round("popularity", 6))


@query("d13_distribution", ("D13", "L9"), W(
    """SELECT value, round(mass / sum(mass) OVER (), 6) AS share FROM (
         SELECT it.category AS value, sum(it.sentiment_score + 1) AS mass FROM candidates c JOIN items it ON c.item_id = it.item_id
         WHERE c.label = 1 GROUP BY it.category)""", "candidates", "items"))
def d13(spark, sf):
    """Weighted category distribution of clicked items (weight = sentiment + 1)."""
    c = fx.candidates(spark, sf).filter("label = 1").join(fx.items(spark, sf), "item_id") \
        .withColumn("w", F.col("sentiment_score") + 1)
    return D.distribution(c, "category", "w").withColumn("share", F.round("share", 6))


@query("d14_index_of_dispersion", "D14", W(
    """SELECT user_id, CASE WHEN k = 1 THEN (CASE WHEN N = 1 THEN NULL ELSE 0.0 END)
                            ELSE round(k * (N * N - sf2) / (N * N * (k - 1)), 6) END AS index_of_dispersion
       FROM (SELECT user_id, count(*) AS k, sum(f) AS N, sum(f * f) AS sf2 FROM (
               SELECT c.user_id, it.category, count(*) AS f FROM clicks c JOIN items it ON c.item_id = it.item_id
               GROUP BY ALL) GROUP BY user_id)""", "clicks", "items"))
def d14(spark, sf):
    """Index of dispersion of each user's clicked categories."""
    c = fx.clicks(spark, sf).join(fx.items(spark, sf), "item_id")
    return D.index_of_dispersion(c, "category", by="user_id").withColumn(
        "index_of_dispersion", F.round("index_of_dispersion", 6))


@query("d15_neg_pos_ratio", "D15", W("SELECT round(sum(1 - label) / sum(label), 6) AS neg_pos_ratio FROM candidates",
                                     "candidates"))
def d15(spark, sf):
    """Negatives per positive over all candidates."""
    return D.neg_pos_ratio(fx.candidates(spark, sf)).select(F.round("neg_pos_ratio", 6).alias("neg_pos_ratio"))


@query("d16_normalize", "D16", W(
    """SELECT item_id, round(total_pageviews / max(total_pageviews) OVER (), 6) AS by_max,
              round(((total_pageviews - min(total_pageviews) OVER ()) / (max(total_pageviews) OVER () - min(total_pageviews) OVER ())) * 2 - 1, 6) AS minmax
       FROM items""", "items"))
def d16(spark, sf):
    """Page views normalised by the maximum, and min-max scaled to [-1, 1]."""
    it = fx.items(spark, sf).select("item_id", "total_pageviews")
    a = D.normalize(it, "total_pageviews", "max", out="by_max")
    b = D.normalize(a, "total_pageviews", "minmax", lo=-1.0, hi=1.0, out="minmax")
    return b.select("item_id", F.round("by_max", 6).alias("by_max"), F.round("minmax", 6).alias("minmax"))


def _summary_sql(col: str) -> list[str]:
    stats = {"count": f"count({col})", "mean": f"avg({col})", "stddev": f"stddev_samp({col})", "min": f"min({col})",
             "25%": f"quantile_disc({col}, 0.25)", "50%": f"quantile_disc({col}, 0.5)", "75%": f"quantile_disc({col}, 0.75)", "max": f"max({col})"}
    return [f"SELECT '{n}' AS summary, round(CAST({x} AS DOUBLE), 6) AS v FROM items" for n, x in stats.items()]


@query("d17_summary", "D17", W(
    f"""WITH a AS ({' UNION ALL '.join(_summary_sql('total_pageviews'))}), b AS ({' UNION ALL '.join(_summary_sql('sentiment_score'))})
       SELECT a.summary, a.v AS total_pageviews, b.v AS sentiment_score FROM a JOIN b USING (summary)""", "items"))
def d17(spark, sf):
    """Column summary of the catalogue counters (Spark ``summary``; its texts as numbers)."""
    s = D.summary(fx.items(spark, sf).select("total_pageviews", "sentiment_score"))
    return s.select("summary", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("total_pageviews", "sentiment_score")])


@query("d18_mean_std_by", "D18", W(
    """SELECT CAST(year(impression_time) AS INTEGER) AS year, round(avg(len(inview)), 6) AS mean, round(stddev_pop(len(inview)), 6) AS std
       FROM impressions GROUP BY 1""", "impressions"))
def d18(spark, sf):
    """Mean and population std of list length by year."""
    i = fx.impressions(spark, sf).select(F.year("impression_time").alias("year"), F.size("inview").alias("n"))
    return D.mean_std_by(i, "year", "n").select("year", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("d19_items_per_user", "D19", W(
    f"""SELECT c.c_custkey AS user_id, coalesce({sfl('r.items')}, '') AS items FROM customer c LEFT JOIN (
         SELECT user_id, list(item_id ORDER BY item_id) AS items FROM ratings WHERE rating = 1 GROUP BY user_id) r
       ON c.c_custkey = r.user_id""", "ratings"))
def d19(spark, sf):
    """Items rated 1 per customer; customers without any get []."""
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    r = fx.ratings(spark, sf).filter("rating = 1")
    return D.items_per_user(users, r).select("user_id", L.fmt_list("items").alias("items"))


@query("d20_union_of_lists", "D20", W(
    f"SELECT user_id, {sfl('list_sort(list(DISTINCT x))')} AS items FROM (SELECT user_id, unnest(clicked) AS x FROM impressions) GROUP BY user_id",
    "impressions"))
def d20(spark, sf):
    """Set-union of the clicked lists of all impressions per user."""
    return D.union_of_lists(fx.impressions(spark, sf), "user_id", "clicked").select(
        "user_id", L.fmt_list("items").alias("items"))


@query("d21_interactions_per_user", "D21", W(
    """SELECT coalesce(h.user_id, r.user_id) AS user_id, CAST(coalesce(h.n, 0) + coalesce(r.n, 0) AS BIGINT) AS n_interactions
       FROM (SELECT user_id, count(DISTINCT item_id) AS n FROM clicks WHERE item_id IS NOT NULL GROUP BY user_id) h
       FULL JOIN (SELECT user_id, count(*) AS n FROM impressions GROUP BY user_id) r ON h.user_id = r.user_id""",
    "clicks", "impressions"))
def d21(spark, sf):
    """History length (distinct clicked items) + impression rows per user."""
    h = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("user_id").agg(
        F.collect_set("item_id").alias("history"))
    return D.interactions_per_user(h, fx.impressions(spark, sf))


@query("d22_users_multi_version", "D22", W(
    """SELECT CAST(count(*) FILTER (WHERE v > 1) AS BIGINT) AS n_users_multi_version FROM (
         SELECT user_id, count(DISTINCT coalesce(array_to_string(list_transform(clicked, lambda x: CAST(x AS VARCHAR)), ','), '')) AS v
         FROM impressions GROUP BY user_id)""", "impressions"))
def d22(spark, sf):
    """Users with more than one distinct clicked-list version."""
    i = fx.impressions(spark, sf).select("impression_id", "user_id", F.col("clicked").alias("history"))
    return D.users_with_versions(H.history_versions(i))


@query("d24_attribute_inventory", "D24", W("SELECT DISTINCT unnest(topics) AS value FROM items", "items"))
def d24(spark, sf):
    """Distinct topic tags of the catalogue."""
    return D.attribute_inventory(fx.items(spark, sf), "topics")


# ---- F ------------------------------------------------------------------------------------------------------------
@query("f1_rank_score", "F1", W(
    "SELECT item_id, total_pageviews, round(1 / row_number() OVER (ORDER BY total_pageviews DESC, item_id), 6) AS score FROM items",
    "items"))
def f1(spark, sf):
    """Popularity baseline: 1/rank by page views."""
    return S.rank_score(fx.items(spark, sf), "total_pageviews", "item_id").withColumn("score", F.round("score", 6))


@query("f20_newest_first", "F20", W(
    """SELECT item_id, strftime(first_seen, '%Y-%m-%d') AS first_seen,
              round(1 / row_number() OVER (ORDER BY first_seen DESC, item_id), 6) AS score
       FROM (SELECT item_id, min(ts) AS first_seen FROM clicks WHERE item_id IS NOT NULL GROUP BY item_id)""", "clicks"))
def f20(spark, sf):
    """Newest-first baseline: 1/rank by first appearance time."""
    t = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("ts").alias("first_seen"))
    r = S.rank_score(t, "first_seen", "item_id")
    return r.select("item_id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.round("score", 6).alias("score"))


@query("f3_submission_ranks", ("F3", "A14"), W(
    f"""SELECT impression_id, concat(CAST(impression_id AS VARCHAR), ' [', {sfl('list(rk ORDER BY pos)')}, ']') AS line FROM (
         SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rk FROM candidates)
       GROUP BY impression_id""", "candidates"))
def f3(spark, sf):
    """Submission lines ``id [r1,r2,...]``: ranks at original positions (earlier position wins ties)."""
    from recsuite.sources.io import submission_lines
    r = S.submission_ranks(fx.candidates(spark, sf), "impression_id")
    return submission_lines(r, "impression_id", "ranks").select("impression_id", "line")


@query("f4_top_n", ("F4", "L10"), W(
    "SELECT item_id, total_pageviews FROM items ORDER BY total_pageviews DESC, item_id LIMIT 10", "items"))
def f4(spark, sf):
    """Top-10 most viewed items (a top-N report)."""
    return S.top_n(fx.items(spark, sf).select("item_id", "total_pageviews"),
                   [F.col("total_pageviews").desc(), F.col("item_id")], 10)


@query("f5_top_users", "F5", W(
    """SELECT user_id, n FROM (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r
       FROM clicks GROUP BY user_id) WHERE r <= (SELECT count(DISTINCT user_id) FROM clicks) // 100""", "clicks"))
def f5(spark, sf):
    """The most active users; k = -100 means n_users // 100 of them."""
    return S.top_users_by_activity(fx.clicks(spark, sf), -100)


@query("f6_random_users", "F6", W(
    f"SELECT user_id FROM (SELECT DISTINCT user_id FROM clicks) ORDER BY {_key('user_id')} LIMIT 20", "clicks"))
def f6(spark, sf):
    """20 users chosen at random (md5 order)."""
    return S.random_users(fx.clicks(spark, sf), 20, SEED)


@query("f8_shuffle_rows", "F8", W(
    f"SELECT item_id, CAST(row_number() OVER (ORDER BY {_key('item_id')}) - 1 AS BIGINT) AS position FROM items", "items"))
def f8(spark, sf):
    """Rows in seeded random order, reported as (item, position)."""
    return S.shuffle_rows(fx.items(spark, sf), SEED, "item_id", "position").select("item_id", "position")


@query("f10_sample_fraction", "F10", W(
    f"SELECT impression_id, pos FROM candidates WHERE {_draw('impression_id', 'pos')} / 4294967296.0 < 0.1", "candidates"))
def f10(spark, sf):
    """Portable 10 % row sample of the candidates."""
    return S.sample_fraction(fx.candidates(spark, sf), 0.1, SEED, ["impression_id", "pos"]).select("impression_id", "pos")


@query("f11_equal_parts", "F11", W(
    "SELECT item_id, CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / ceil((SELECT count(*) FROM items) / 7)) AS INTEGER) AS part FROM items",
    "items"))
def f11(spark, sf):
    """Catalogue in 7 contiguous equal parts by id."""
    return S.equal_parts(fx.items(spark, sf).select("item_id"), 7, ["item_id"])


_PHASE_SQL = f"""
    SELECT impression_id, CASE WHEN i < floor(n * 0.8) THEN 'train'
                               WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS phase
    FROM (SELECT impression_id, row_number() OVER (ORDER BY {_key('impression_id')}, impression_id) - 1 AS i,
                 count(*) OVER () AS n FROM impressions)"""


@query("f12_weighted_split", "F12", W(_PHASE_SQL, "impressions"))
def f12(spark, sf):
    """8:1:1 split of impression ids in md5 order (floor sizes, remainder to the last part)."""
    return S.weighted_split(fx.impressions(spark, sf), {"train": 8, "dev": 1, "test": 1}, SEED, "impression_id")


_RKEY_SQL = "concat_ws('|', user_id, item_id, rating, strftime(ts, '%Y%m%d'))"


@query("f14_split_interactions", "F14", W(
    f"""SELECT rk, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS phase FROM (
          SELECT rk, row_number() OVER (ORDER BY {_key('rk')}, rk) - 1 AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT {_RKEY_SQL} AS rk FROM ratings))""", "ratings"))
def f14(spark, sf):
    """80/20 split of rating rows by their row key."""
    r = fx.ratings(spark, sf).select(F.concat_ws("|", F.col("user_id").cast("string"), F.col("item_id").cast("string"),
                                                 F.col("rating").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("rk"))
    return S.weighted_split(r, {"train": 8, "test": 2}, SEED, "rk")


@query("f15_random_lists", "F15", W(
    f"""WITH RECURSIVE pool AS (SELECT list_sort(list(DISTINCT item_id)) AS p FROM benchmark),
            st AS (SELECT impression_id, 0 AS k, []::INTEGER[] AS si, []::INTEGER[] AS sv, []::INTEGER[] AS out FROM impressions
                   UNION ALL
                   SELECT impression_id, k + 1, list_concat(si, [k, j]), list_concat(sv, [vb, va]), list_concat(out, [vb]) FROM (
                     SELECT *, coalesce(list_reverse(sv)[list_position(list_reverse(si), k)], k) AS va,
                               coalesce(list_reverse(sv)[list_position(list_reverse(si), j)], j) AS vb FROM (
                       SELECT st.*, CAST(k + {_draw('impression_id', 'k')} % (len(pool.p) - k) AS INTEGER) AS j
                       FROM st, pool WHERE k < least(5, len(pool.p)))))
       SELECT impression_id, {sfl('list_transform(out, lambda x: pool.p[x + 1])')} AS ranked
       FROM st, pool WHERE k = least(5, len(pool.p))""", "impressions"))
def f15(spark, sf):
    """Random 5-item list per impression from the candidate pool (benchmark item ids)."""
    r = S.random_lists(fx.impressions(spark, sf).select("impression_id"), fx.table(spark, sf, "benchmark"), 5, SEED,
                       "impression_id")
    return r.select("impression_id", L.fmt_list("ranked").alias("ranked"))


@query("f16_random_permutation_ranks", "F16", W(
    f"""SELECT impression_id, {sfl(f"list_transform(list_sort(list_transform(range(1, len(inview) + 1), lambda x, i: {{'k': {_key('impression_id', 'i - 1')}, 'i': i - 1, 'x': x}})), lambda e: e.x)")} AS ranks
        FROM impressions""", "impressions"))
def f16(spark, sf):
    """Random permutation ranks 1..len per impression (random submission)."""
    return fx.impressions(spark, sf).select(
        "impression_id", L.fmt_list(S.random_permutation_ranks("inview", SEED, "impression_id")).alias("ranks"))


@query("f18_remove_random", "F18", f"""
    SELECT c_custkey AS user_id FROM (SELECT c_custkey, row_number() OVER (ORDER BY {_key('c_custkey')}, c_custkey) - 1 AS i FROM customer)
    WHERE i >= 100""")
def f18(spark, sf):
    """Remove 100 random users."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return S.remove_random(c, 100, SEED, "user_id")


# ---- J ------------------------------------------------------------------------------------------------------------
_J3_ROWS = f"""
    SELECT impression_id, user_id, neg, cpos, pos, CAST(impression_id AS VARCHAR) || ':' || CAST(coalesce(cpos, 0) AS VARCHAR) AS rk FROM (
      SELECT impression_id, user_id, list_filter(inview, lambda x: NOT coalesce(list_contains(clicked, x), false)) AS neg,
             CAST(generate_subscripts(clicked, 1) - 1 AS INTEGER) AS cpos, unnest(clicked) AS pos FROM impressions WHERE len(clicked) > 0)
    UNION ALL
    SELECT impression_id, user_id, inview AS neg, NULL AS cpos, NULL AS pos, CAST(impression_id AS VARCHAR) || ':0' FROM impressions WHERE len(clicked) = 0"""


@query("j3_npratio_sampling", "J3", W(
    f"""SELECT impression_id, {sfl(f"list_concat(list_transform(range(1, 3), lambda k: CASE WHEN len(neg) > 0 THEN neg[({_draw('rk', 'k')} % len(neg)) + 1] END), [pos])")} AS inview,
              {sfl('[pos]')} AS clicked
       FROM ({_J3_ROWS})""", "impressions"))
def j3(spark, sf):
    """npratio = 2 negative sampling with replacement: one row per click, negatives ++ [positive]."""
    i = fx.impressions(spark, sf).select("impression_id", "user_id", "inview", "clicked")
    s = J.sample_negatives_npratio(i, 2, SEED)
    return s.select("impression_id", L.fmt_list("inview").alias("inview"), L.fmt_list("clicked").alias("clicked"))


@query("j5_pos_neg_rows", ("J5", "J12"), W(
    """SELECT user_id, item_id, CASE WHEN rating > 3 THEN 1 ELSE 0 END AS label FROM ratings
       WHERE rating <> 3 AND user_id IN (SELECT user_id FROM ratings WHERE rating > 3)""", "ratings"))
def j5(spark, sf):
    """Sessions (positives / negatives per user) back to labelled interaction rows; users without positives dropped."""
    s = H.sessions_from_pairs(P.binarize_ratings(fx.ratings(spark, sf)))
    return J.pos_neg_rows(s)


@query("j6_first_impression_negatives", "J6", W(
    f"""SELECT c.c_custkey AS user_id, {sfl('f.neg')} AS neg FROM customer c LEFT JOIN (
          SELECT user_id, list_filter(arg_min(inview, impression_id), lambda x: NOT coalesce(list_contains(arg_min(clicked, impression_id), x), false)) AS neg
          FROM impressions GROUP BY user_id) f ON c.c_custkey = f.user_id""", "impressions"))
def j6(spark, sf):
    """Negatives of each customer's first impression; customers without impressions get NULL."""
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    r = J.first_impression_negatives(fx.impressions(spark, sf), users)
    return r.select("user_id", L.fmt_list("neg").alias("neg"))


@query("j7_random_catalogue_negatives", "J7", W(
    f"""WITH idx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ci FROM items),
            n AS (SELECT count(*) AS n FROM items),
            d AS (SELECT c_custkey AS user_id, k, {_draw('c_custkey', 'k')} % (SELECT n FROM n) AS ci
                  FROM customer, (SELECT unnest(range(1, 11)) AS k))
       SELECT user_id, {sfl('list(idx.item_id ORDER BY k)')} AS random_neg FROM d JOIN idx ON d.ci = idx.ci GROUP BY user_id""",
    "items"))
def j7(spark, sf):
    """10 random catalogue items per customer (md5 draws into the dense catalogue index)."""
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    r = J.random_catalogue_negatives(users, fx.items(spark, sf), 10, SEED, "user_id")
    return r.select("user_id", L.fmt_list("random_neg").alias("random_neg"))


def _outside_sql(order: str, same: str) -> str:
    """Users' allowed items in catalogue order, and up to 25 distinct positions drawn by a partial Fisher-Yates."""
    return f"""WITH RECURSIVE it AS (SELECT item_id, category, item_id % 101 AS cluster FROM items),
            taste AS (SELECT DISTINCT c.user_id, it.category, it.cluster FROM clicks c JOIN it ON c.item_id = it.item_id),
            users AS (SELECT DISTINCT user_id FROM clicks WHERE item_id IS NOT NULL),
            allowed AS (SELECT u.user_id, it.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY {order}, it.item_id) - 1 AS p
                        FROM users u, it WHERE NOT EXISTS (SELECT 1 FROM taste t WHERE t.user_id = u.user_id AND ({same}))),
            st AS (SELECT user_id, count(*) AS n, 0 AS k, []::INTEGER[] AS si, []::INTEGER[] AS sv, []::INTEGER[] AS out
                   FROM allowed GROUP BY user_id
                   UNION ALL
                   SELECT user_id, n, k + 1, list_concat(si, [k, j]), list_concat(sv, [vb, va]), list_concat(out, [vb]) FROM (
                     SELECT *, coalesce(list_reverse(sv)[list_position(list_reverse(si), k)], k) AS va,
                               coalesce(list_reverse(sv)[list_position(list_reverse(si), j)], j) AS vb FROM (
                       SELECT st.*, CAST(k + {_draw('user_id', 'k')} % (n - k) AS INTEGER) AS j FROM st WHERE k < least(25, n)))),
            picks AS (SELECT user_id, unnest(list_slice(out, 1, 20 + {_draw('user_id', "'n'")} % 5 + 1)) AS p,
                             generate_subscripts(list_slice(out, 1, 20 + {_draw('user_id', "'n'")} % 5 + 1), 1) AS k
                      FROM st WHERE k = least(25, n))
       SELECT picks.user_id, CAST(count(*) AS BIGINT) AS n_neg, {sfl('list(a.item_id ORDER BY picks.k)')} AS neg
       FROM picks JOIN allowed a ON a.user_id = picks.user_id AND a.p = picks.p GROUP BY picks.user_id"""


def _outside(spark, sf, attr):
    h = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("user_id").agg(
        F.collect_set("item_id").alias("history"))
    items = fx.items(spark, sf).withColumn("cluster", F.col("item_id") % 101)
    r = J.negatives_outside_taste(h, items, SEED, attr=attr)
    return r.select("user_id", F.size("neg").cast("bigint").alias("n_neg"), L.fmt_list("neg").alias("neg"))


@query("j8_negatives_outside_taste", "J8", W(_outside_sql("it.category", "t.category = it.category"), "items", "clicks"))
def j8(spark, sf):
    """20 + U{1..5} random items per user outside the categories of the user's clicks."""
    return _outside(spark, sf, "category")


@query("j9_negatives_outside_taste_and_cluster", "J9", W(
    _outside_sql("it.category, it.cluster", "t.category = it.category OR t.cluster = it.cluster"), "items", "clicks"))
def j9(spark, sf):
    """20 + U{1..5} random items per user outside both the categories and the item clusters of the user's clicks."""
    return _outside(spark, sf, ["category", "cluster"])


@query("j21_training_set", "J21", W(
    f"""WITH h AS (SELECT user_id, list(item_id ORDER BY ts, item_id) AS hist FROM (
                     SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r
                     FROM clicks WHERE ts < TIMESTAMP '1998-01-01' AND item_id IS NOT NULL) WHERE r <= 10 GROUP BY user_id),
            s AS (SELECT impression_id, user_id, cpos, list_concat(list_transform(range(1, 5), lambda k: CASE WHEN len(neg) > 0
                           THEN neg[({_draw('rk', 'k')} % len(neg)) + 1] END), [pos]) AS inview, pos FROM ({_J3_ROWS}) WHERE pos IS NOT NULL)
       SELECT s.impression_id, s.cpos AS click, {sfl('h.hist')} AS history, {sfl('s.inview')} AS inview,
              {sfl('list_transform(s.inview, lambda x: CAST(coalesce(x = s.pos, false) AS INTEGER))')} AS labels
       FROM s LEFT JOIN h ON s.user_id = h.user_id WHERE {_draw('s.impression_id', 's.cpos', "'row'")} / 4294967296.0 < 0.5
         AND s.impression_id IN (SELECT impression_id FROM impressions WHERE impression_time >= TIMESTAMP '1998-01-01')""",
    "impressions", "clicks"))
def j21(spark, sf):
    """Training set from raw logs: last 10 clicks before 1998 as history of the impressions from then on, 4 sampled negatives per
    click, labels, half the rows."""
    t = J.training_set(fx.impressions(spark, sf), fx.clicks(spark, sf), "1998-01-01", 10, 4, SEED, fraction=0.5)
    return t.select("impression_id", F.col("_cpos").alias("click"), L.fmt_list("history").alias("history"),
                    L.fmt_list("inview").alias("inview"), L.fmt_list("labels").alias("labels"))


_NEGS_SQL = f"""neg AS (SELECT user_id, coalesce(list(item_id ORDER BY ts, item_id) FILTER (WHERE rating < 3), []) AS neg
                       FROM ratings WHERE rating <> 3 GROUP BY user_id HAVING count(*) FILTER (WHERE rating > 3) > 0),
            idx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ci FROM items)"""


def _sql_shuffled(col: str, key: str) -> str:
    return (f"list_transform(list_sort(list_transform({col}, lambda x, i: {{'k': {_key(key, 'i - 1')}, 'i': i - 1, 'x': x}})), "
            "lambda e: e.x)")


@query("j10_training_candidates", "J10", W(
    f"""WITH {_NEGS_SQL},
            pos AS (SELECT user_id, item_id, user_id || ':' || item_id AS rk FROM ratings WHERE rating > 3),
            d AS (SELECT rk, list(idx.item_id ORDER BY k) AS rnd FROM (
                    SELECT rk, k, {_draw('rk', 'k')} % (SELECT count(*) FROM items) AS ci FROM (SELECT DISTINCT rk FROM pos), (SELECT unnest(range(1, 5)) AS k)
                  ) x JOIN idx ON x.ci = idx.ci GROUP BY rk),
            o AS (SELECT p.user_id, p.item_id, p.rk, d.rnd, list_slice({_sql_shuffled('n.neg', 'p.rk')}, 1, 4) AS own
                  FROM pos p JOIN neg n ON p.user_id = n.user_id JOIN d ON p.rk = d.rk)
       SELECT user_id, item_id, {sfl('list_concat([item_id], own, list_slice(rnd, 1, 4 - len(own)))')} AS candidates FROM o""",
    "ratings", "items"))
def j10(spark, sf):
    """[positive] + up to 4 own negatives + random catalogue negatives for the rest, per positive rating."""
    r = P.binarize_ratings(fx.ratings(spark, sf))
    s = H.sessions_from_pairs(r)
    pos = s.select("user_id", "neg", F.explode("history").alias("item_id"))
    pos = pos.withColumn("rk", F.concat_ws(":", F.col("user_id").cast("string"), F.col("item_id").cast("string")))
    pos = J.random_catalogue_negatives(pos, fx.items(spark, sf), 4, SEED, "rk")
    out = J.training_candidates(pos, 4, SEED, "rk")
    return out.select("user_id", "item_id", L.fmt_list("candidates").alias("candidates"))


@query("j14_unfold_for_scoring", "J14", W(
    "SELECT impression_id, pos, item_id, CAST(len(clicked) AS INTEGER) AS n_hist FROM candidates JOIN impressions USING (impression_id)",
    "candidates", "impressions"))
def j14(spark, sf):
    """One row per (impression, candidate) keeping the history column."""
    i = fx.impressions(spark, sf).select("impression_id", "inview", F.col("clicked").alias("hist"))
    u = J.unfold_for_scoring(i)
    return u.select("impression_id", F.col("pos").cast("bigint").alias("pos"), "item_id",
                    F.size("hist").alias("n_hist"))


@query("j20_all_user_rows", "J20", W(
    f"""SELECT c.c_custkey AS user_id, {sfl('h.items')} AS history, 0 AS candidate FROM customer c
       LEFT JOIN (SELECT user_id, list_sort(list(DISTINCT item_id)) AS items FROM clicks WHERE item_id IS NOT NULL GROUP BY user_id) h
       ON c.c_custkey = h.user_id""", "clicks"))
def j20(spark, sf):
    """One scoring row per customer with a dummy candidate."""
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    h = fx.clicks(spark, sf).filter(F.col("item_id").isNotNull()).groupBy("user_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    return J.all_user_rows(users, h).select("user_id", L.fmt_list("items").alias("history"), "candidate")
