"""Queries for the in-row list operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx

W = fx.with_views
sfl = L.sql_fmt_list
SEED = 42


def _imp(spark, sf):
    return fx.impressions(spark, sf)


@query("b3_min_list_length", "B3", W("SELECT impression_id, CAST(len(inview) AS BIGINT) AS n_inview "
                                     "FROM impressions WHERE len(inview) >= 5", "impressions"))
def b3(spark, sf):
    """Impressions with at least 5 in-view items."""
    return L.min_list_length(_imp(spark, sf), "inview", 5).select(
        "impression_id", F.size("inview").cast("bigint").alias("n_inview"))


@query("b4_max_list_length", "B4", W("SELECT impression_id, CAST(len(inview) AS BIGINT) AS n_inview "
                                     "FROM impressions WHERE len(inview) <= 3", "impressions"))
def b4(spark, sf):
    """Impressions with at most 3 in-view items."""
    return L.max_list_length(_imp(spark, sf), "inview", 3).select(
        "impression_id", F.size("inview").cast("bigint").alias("n_inview"))


@query("b5_min_negatives", "B5", W("SELECT impression_id FROM impressions "
                                   "WHERE len(inview) - len(clicked) >= 4", "impressions"))
def b5(spark, sf):
    """Impressions with at least 4 non-clicked in-view items."""
    return L.min_negatives(_imp(spark, sf), 4).select("impression_id")


@query("b9_keep_listed_elements", ("B9",), W(
    f"SELECT impression_id, CASE WHEN len(k) > 0 THEN {sfl('k')} END AS kept "
    "FROM (SELECT impression_id, list_filter(inview, lambda x: list_contains([1, 3, 5, 7, 11, 13, 17, 19, 23], x)) AS k "
    "FROM impressions)", "impressions"))
def b9(spark, sf):
    """Keep in-view elements from a small literal id set; an emptied list becomes NULL."""
    return _imp(spark, sf).select(
        "impression_id", L.fmt_list(L.keep_elements_in("inview", [1, 3, 5, 7, 11, 13, 17, 19, 23])).alias("kept"))


@query("b10_drop_null_elements", "B10", W(
    f"""SELECT user_id, {sfl('list_filter(items, lambda x: x IS NOT NULL)')} AS compact
        FROM (SELECT user_id, list(item_id ORDER BY ts, item_id NULLS FIRST) AS items FROM clicks GROUP BY user_id)""",
    "clicks"))
def b10(spark, sf):
    """Drop NULL elements inside per-user click lists (the click log holds NULL items)."""
    c = fx.clicks(spark, sf)
    lists = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(
        "ts", F.col("item_id").isNotNull().alias("nn"), "item_id"))).alias("s")) \
        .select("user_id", F.transform("s", lambda e: e["item_id"]).alias("items"))
    return lists.select("user_id", L.fmt_list(L.drop_null_elements("items")).alias("compact"))


@query("b11_distinct_elements", "B11", W(
    f"SELECT impression_id, {sfl('list_filter(list_concat(clicked, inview), lambda x, i: list_position(list_concat(clicked, inview), x) = i)')} AS uniq "
    "FROM impressions", "impressions"))
def b11(spark, sf):
    """De-duplicate elements of clicked ++ in-view, first occurrence kept."""
    return _imp(spark, sf).select(
        "impression_id", L.fmt_list(L.distinct_elements(F.concat("clicked", "inview"))).alias("uniq"))


@query("e4_tail_and_pad", "E4", W(
    f"""SELECT impression_id,
              {sfl('list_slice(inview, greatest(len(inview) - 3 + 1, 1), len(inview))')} AS last3,
              {sfl('list_slice(list_concat([0, 0, 0], inview), len(inview) + 1, len(inview) + 3)')} AS last3_padded
       FROM impressions""", "impressions"))
def e4(spark, sf):
    """Last 3 in-view items, unpadded and front-padded with 0."""
    i = _imp(spark, sf)
    return i.select("impression_id", L.fmt_list(L.tail("inview", 3)).alias("last3"),
                    L.fmt_list(L.tail("inview", 3, pad=0)).alias("last3_padded"))


@query("e5_fit_length", ("E5", "J11"), W(
    f"""SELECT impression_id,
              {sfl('list_concat(list_slice(inview, 1, 4), list_transform(range(greatest(4 - len(list_slice(inview, 1, 4)), 0)), lambda x: -1))')} AS head4_backpad,
              {sfl('list_concat(list_transform(range(greatest(4 - len(list_slice(inview, greatest(len(inview) - 3, 1), len(inview))), 0)), lambda x: -1), list_slice(inview, greatest(len(inview) - 3, 1), len(inview)))')} AS tail4_frontpad,
              {sfl('list_concat(list_transform(range(least(len(inview), 4)), lambda x: 1), list_transform(range(4 - least(len(inview), 4)), lambda x: 0))')} AS mask4
       FROM impressions""", "impressions"))
def e5(spark, sf):
    """Head/tail cut to 4 with back/front padding by -1, and the padding mask."""
    i = _imp(spark, sf)
    return i.select("impression_id",
                    L.fmt_list(L.fit_length("inview", 4, keep="head", pad=-1, pad_side="back")).alias("head4_backpad"),
                    L.fmt_list(L.fit_length("inview", 4, keep="tail", pad=-1, pad_side="front")).alias("tail4_frontpad"),
                    L.fmt_list(L.pad_mask("inview", 4)).alias("mask4"))


_SCORES = "transform(inview, x -> ((x * 7919 + impression_id * 104729) % 11) / 10)"


@query("f2_rank_in_list", ("F2", "Q-6"), W(
    f"""SELECT impression_id, {sfl('list(rk ORDER BY pos)')} AS ranks FROM (
          SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos DESC) AS rk
          FROM candidates) GROUP BY impression_id""", "candidates"))
def f2(spark, sf):
    """Rank of each candidate's score inside its in-view list (1 = best, later position wins ties)."""
    return _imp(spark, sf).select("impression_id", L.fmt_list(L.rank_in_list(F.expr(_SCORES))).alias("ranks"))


@query("j1_binary_labels", "J1", W(
    f"SELECT impression_id, {sfl('list_transform(inview, lambda x: CAST(coalesce(list_contains(clicked, x), false) AS INTEGER))')} AS labels FROM impressions",
    "impressions"))
def j1(spark, sf):
    """0/1 label per in-view item."""
    return _imp(spark, sf).select("impression_id", L.fmt_list(L.binary_labels()).alias("labels"))


@query("j2_remove_positives", "J2", W(
    f"SELECT impression_id, {sfl('list_filter(inview, lambda x: NOT coalesce(list_contains(clicked, x), false))')} AS negatives FROM impressions",
    "impressions"))
def j2(spark, sf):
    """In-view items minus clicked ones (duplicates kept)."""
    return _imp(spark, sf).select("impression_id", L.fmt_list(L.remove_positives()).alias("negatives"))


def _sql_key(seed, *parts):
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


def _sql_shuffled(col: str, seed=SEED) -> str:
    return (f"list_transform(list_sort(list_transform({col}, lambda x, i: {{'k': {_sql_key(seed, 'impression_id', 'i - 1')}, "
            f"'i': i - 1, 'x': x}})), lambda e: e.x)")


@query("f7_shuffle_list", "F7", W(f"SELECT impression_id, {sfl(_sql_shuffled('inview'))} AS shuffled FROM impressions",
                                  "impressions"))
def f7(spark, sf):
    """Seeded in-row permutation of the in-view list (md5 keys: partitioning-independent)."""
    return _imp(spark, sf).select("impression_id",
                                  L.fmt_list(L.shuffle_list("inview", SEED, "impression_id")).alias("shuffled"))


def _sql_draw(seed, *parts):
    return f"('0x' || substr({_sql_key(seed, *parts)}, 1, 8))::BIGINT"


@query("f9_sample_list", "F9", W(
    f"""SELECT impression_id,
              {sfl(f"list_slice({_sql_shuffled('inview')}, 1, 3)")} AS without_replacement,
              {sfl(f"list_transform(range(1, 5), lambda k: CASE WHEN len(clicked) > 0 THEN clicked[({_sql_draw(SEED, 'impression_id', 'k')} % greatest(len(clicked), 1)) + 1] END)")} AS with_replacement
       FROM impressions""", "impressions"))
def f9(spark, sf):
    """3 in-view items without replacement; 4 clicked items with replacement (empty -> NULLs)."""
    i = _imp(spark, sf)
    return i.select("impression_id",
                    L.fmt_list(L.sample_list("inview", 3, SEED, "impression_id")).alias("without_replacement"),
                    L.fmt_list(L.sample_list("clicked", 4, SEED, "impression_id", replace=True)).alias("with_replacement"))


@query("f17_ordered_subset", "F17", W(
    f"""SELECT impression_id, {sfl("list_transform(list_sort(list_transform(list_slice(list_sort(list_transform(inview, lambda x, i: {'k': " + _sql_key(SEED, 'impression_id', 'i - 1') + ", 'i': i - 1, 'x': x})), 1, least(len(clicked) + 1, len(inview))), lambda e: {'i': e.i, 'x': e.x})), lambda e: e.x)")} AS subset
       FROM impressions""", "impressions"))
def f17(spark, sf):
    """Order-preserving random subset of the in-view list, target length = clicked count + 1."""
    i = _imp(spark, sf)
    return i.select("impression_id", L.fmt_list(L.ordered_subset("inview", F.size("clicked") + 1, SEED,
                                                                 "impression_id")).alias("subset"))


@query("f19_chunk_list", "F19", W(
    """SELECT impression_id,
              array_to_string(list_transform(range(0, CAST(ceil(len(inview) / 3) AS BIGINT)),
                  lambda c: array_to_string(list_slice(inview, c * 3 + 1, c * 3 + 3), ' ')), '|') AS chunks
       FROM impressions""", "impressions"))
def f19(spark, sf):
    """In-view list cut into chunks of 3."""
    ch = L.chunk_list("inview", 3)
    return _imp(spark, sf).select("impression_id", F.array_join(F.transform(
        ch, lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")), "|").alias("chunks"))


@query("e12_decay_weights", "E12", W(
    f"""SELECT impression_id,
              {sfl('list_transform(range(1, len(inview) + 1), lambda i: i / len(inview))', 'double')} AS linear,
              {sfl('list_reverse(list_transform(range(1, len(inview) + 1), lambda i: pow(0.5, len(inview) - i)))', 'double')} AS exp_desc
       FROM impressions""", "impressions"))
def e12(spark, sf):
    """Linear (ascending) and exponential (lambda 0.5, descending) decay weights per in-view list."""
    i = _imp(spark, sf)
    return i.select("impression_id", L.fmt_list(L.linear_decay("inview"), "double").alias("linear"),
                    L.fmt_list(L.exponential_decay("inview", 0.5, ascending=False), "double").alias("exp_desc"))
