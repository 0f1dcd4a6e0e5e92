"""Labels, negative sampling and training-example tables.

Per-impression work stays inside the row; catalogue draws are md5-keyed integer draws joined to a dense catalogue
index (no cross join of rows x catalogue).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.functions import rng
from recsuite.operators.common import as_list, cut_lineage, dense_index, first_per_key, top_n_per_group


def sample_negatives_npratio(df: DataFrame, npratio: int, seed, key="impression_id", inview="inview",
                             clicked="clicked", with_replacement: bool = True, shuffle: bool = False,
                             on_short: str = "take_all") -> DataFrame:
    """J3 (Wu et al. 2019): remove positives from the in-view list, one row per click (an impression without
    clicks keeps one row whose positive is NULL, as the reference's explode does), sample ``npratio`` negatives
    per row (seeded by impression and click position), in-view = negatives ++ [positive], clicked = [positive],
    optional seeded shuffle."""
    neg = df.withColumn("_neg", L.remove_positives(inview, clicked))
    ex = neg.select(*[c for c in df.columns if c not in (inview, clicked)], "_neg",
                    F.posexplode_outer(clicked).alias("_cpos", "_pos"))
    row_key = F.concat_ws(":", F.col(key).cast("string"), F.coalesce(F.col("_cpos"), F.lit(0)).cast("string"))
    s = ex.withColumn("_rk", row_key).withColumn(
        "_s", L.sample_list("_neg", npratio, seed, "_rk", replace=with_replacement, on_short=on_short))
    out = s.withColumn(inview, F.concat("_s", F.array(F.col("_pos")))).withColumn(clicked, F.array(F.col("_pos")))
    if shuffle:
        out = out.withColumn(inview, L.shuffle_list(inview, seed, "_rk"))
    return out.drop("_neg", "_pos", "_s", "_rk")


def training_set(behaviors: DataFrame, clicks: DataFrame, cutoff, history_size: int, npratio: int, seed,
                 fraction: float = 1.0, key="impression_id", user="user_id", inview="inview", clicked="clicked",
                 item="item_id", time="ts", behavior_time="impression_time") -> DataFrame:
    """The end-to-end training set from raw logs: every user's click log before ``cutoff`` cut to its last
    ``history_size`` items, attached to the behaviours from the cutoff on (an earlier one must not know later clicks), one row per click with ``npratio`` sampled negatives (J3), 0/1
    labels over the in-view list, and a seeded row sample of ``fraction``.  Columns: key, user, click position
    ``_cpos``, ``history`` (NULL without one), in-view list, clicked list, ``labels``."""
    from recsuite.operators.history import fixed_history
    rows = fixed_history(clicks, cutoff, history_size, user, item, time,
                         attach_to=behaviors.filter(F.col(behavior_time) >= F.lit(cutoff)).select(key, user, inview, clicked)) \
        .withColumnRenamed(f"{item}_fixed", "history")
    rows = sample_negatives_npratio(rows, npratio, seed, key, inview, clicked)
    rows = rows.filter(F.element_at(clicked, 1).isNotNull()).withColumn("labels", L.binary_labels(inview, clicked))
    if fraction < 1.0:
        rows = rows.filter(rng.uniform(seed, F.col(key), F.col("_cpos"), F.lit("row")) < fraction)
    return rows


def pos_neg_rows(df: DataFrame, user="user_id", pos="history", neg="neg", item="item_id", label="label") -> DataFrame:
    """Positive and negative list columns -> labelled interaction rows (users without positives have
    already been dropped by E6, so their negatives go too)."""
    p = df.filter(F.size(pos) > 0)
    a = p.select(user, F.explode(pos).alias(item), F.lit(1).alias(label))
    b = p.select(user, F.explode(neg).alias(item), F.lit(0).alias(label))
    return a.unionByName(b)


def first_impression_negatives(behaviors: DataFrame, users: DataFrame, user="user_id", order="impression_id",
                               inview="inview", clicked="clicked") -> DataFrame:
    """The negatives of each user's first impression; users without an impression get NULL."""
    first = first_per_key(behaviors, user, [order], [inview, clicked])
    negs = first.select(user, L.remove_positives(inview, clicked).alias("neg"))
    return users.select(user).distinct().join(negs, user, "left")


def catalogue_index(items: DataFrame, item="item_id") -> tuple[DataFrame, DataFrame]:
    """Dense 0..n-1 index of the catalogue and its size as a scalar subquery (for md5 draws into it)."""
    idx = dense_index(items.select(item).distinct(), [item], "_ci")
    n = items.select(item).distinct().agg(F.count(F.lit(1))).scalar()
    return idx, n


def random_catalogue_negatives(df: DataFrame, items: DataFrame, m: int, seed, key: str, item="item_id",
                               out="random_neg") -> DataFrame:
    """M random catalogue items per row (drawn with replacement from the whole catalogue; they may be
    positives, Q11): draw indices pmod(md5, n), explode, join the dense catalogue index, re-collect by draw."""
    idx, n = catalogue_index(items, item)
    d = df.select(key).distinct().select(key, F.posexplode(F.sequence(F.lit(1), F.lit(m))).alias("_d", "_k"))
    d = d.withColumn("_ci", F.pmod(rng.draw32(seed, F.col(key), F.col("_k")), n))
    j = d.join(idx.select("_ci", F.col(item).alias("_item")), "_ci")
    back = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_d", "_item"))).alias("_l")) \
        .select(key, F.transform("_l", lambda e: e["_item"]).alias(out))
    return df.join(back, key, "left")


def negatives_outside_taste(history: DataFrame, items: DataFrame, seed, user="user_id", hist="history",
                            item="item_id", attr="category", base: int = 20, extra_max: int = 5) -> DataFrame:
    """Per user, 20 + U{1..5} distinct random catalogue items that share none of the attributes ``attr`` (one
    name, or several: an item is out as soon as one of them is among those of the user's history); a user with fewer
    allowed items gets all of them (the reference would loop forever).  Exact and in one pass, no rejection rounds:

    * the catalogue is densely indexed in (attributes, item) order, so every combination of attribute values is a
      range [start, start + count) of it, and so are all combinations with the same first values;
    * a user carries only the codes of the taste's values, never their ranges; the ranges of every value are one array
      (``_value_ranges``: as many entries as the catalogue has combinations), looked up inside the row.  Distinct
      positions in [0, allowed count) are drawn with the unrolled partial Fisher-Yates (md5 draws); a position moves
      past every excluded range at or before it, and the result is joined to the dense index (an equi-join)."""
    from recsuite.operators.sampling import unrolled_sample_indices
    attrs = as_list(attr)
    codes = [f"_c{i}" for i in range(len(attrs))]
    cat = items.select(item, *attrs)
    idx = dense_index(cat, [*attrs, item], "_g")
    total = idx.agg(F.count(F.lit(1))).scalar()
    ranges = idx.groupBy(*attrs).agg(F.min("_g").alias("s"), F.count(F.lit(1)).alias("n"))
    for a, c in zip(attrs, codes):
        values = ranges.select(a).filter(F.col(a).isNotNull()).distinct()
        code = dense_index(values, [a], c).select(a, F.col(c).cast("int").alias(c))
        ranges, cat = ranges.join(code, a, "left"), cat.join(code, a, "left")
    ranges = cut_lineage(ranges.select(*codes, "s", "n"))
    seen = history.select(user, F.explode(hist).alias(item)).join(cat.select(item, *codes), item)
    taste = seen.groupBy(F.col(user).alias("_u")).agg(*[F.collect_set(c).alias(c) for c in codes])
    u = history.select(user).distinct().join(taste, F.col(user) == F.col("_u"), "left").drop("_u")
    out = None
    for i, c in enumerate(codes):
        own = F.flatten(F.transform(c, lambda x: F.get(F.col(f"_r{i}"), x)))  # noqa: B023
        for j in range(i):  # those inside a range that is out already
            own = F.filter(own, lambda e: ~F.coalesce(F.array_contains(codes[j], e[codes[j]]), F.lit(False)))  # noqa: B023
        own = F.coalesce(F.transform(own, lambda e: F.struct(e["s"].alias("s"), e["n"].alias("n"))),
                         F.array().cast("array<struct<s:bigint,n:bigint>>"))
        u = u.withColumn(f"_r{i}", _value_ranges(ranges, codes, i))
        out = own if out is None else F.concat(out, own)
    u = u.withColumn("_out", F.array_sort(out)).drop(*codes, *[f"_r{i}" for i in range(len(codes))])
    gone = F.aggregate("_out", F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])
    u = u.withColumn("_A", (total - gone).cast("int"))
    u = u.withColumn("_want", F.lit(base) + F.pmod(rng.draw32(seed, F.col(user), F.lit("n")), F.lit(extra_max)) + 1)
    n_max = base + extra_max
    u = unrolled_sample_indices(u, "_A", n_max, seed, user, "_o")
    picks = F.slice(F.array(*[F.col(f"_o{k}") for k in range(n_max)]), 1, F.col("_want").cast("int"))
    u = u.select(user, "_out", F.posexplode(F.filter(picks, lambda x: x.isNotNull())).alias("_k", "_p"))
    place = F.aggregate("_out", F.col("_p").cast("bigint"), lambda g, e: F.when(g >= e["s"], g + e["n"]).otherwise(g))
    j = u.select(user, "_k", place.alias("_g")).join(idx.select("_g", item), "_g")
    return j.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_k", item))).alias("_l")) \
        .select(user, F.transform("_l", lambda e: e[item]).alias("neg"))


def _value_ranges(ranges: DataFrame, codes: list[str], i: int):
    """Array by the code of attribute ``i``: the catalogue's ranges of that value, one for each combination of the attributes
    before it (their codes beside it).  As a scalar it reaches every task once."""
    own = ranges.groupBy(*codes[:i + 1]).agg(F.min("s").alias("s"), F.sum("n").alias("n")).filter(F.col(codes[i]).isNotNull())
    by = own.groupBy(codes[i]).agg(F.collect_list(F.struct("s", "n", *codes[:i])).alias("_l"))
    rows = by.agg(F.array_sort(F.collect_list(F.struct(codes[i], "_l"))).alias("_a"))
    return rows.select(F.transform("_a", lambda e: e["_l"]).alias("_a")).scalar()


def training_candidates(df: DataFrame, k: int, seed, key: str, pos="item_id", own_neg="neg",
                        random_neg="random_neg", out="candidates") -> DataFrame:
    """[positive] + min(k, #own negatives) own negatives (seeded sample) + the rest from random negatives."""
    own = L.sample_list(own_neg, k, seed, key)
    rest = F.slice(F.coalesce(F.col(random_neg), F.array()), 1,
                   F.greatest(F.lit(k) - L.size0(own), F.lit(0)))
    return df.withColumn(out, F.concat(F.array(F.col(pos)), F.coalesce(own, F.array()), rest))


def unfold_for_scoring(df: DataFrame, inview="inview", item="item_id") -> DataFrame:
    """One row per (impression, candidate) keeping the history columns."""
    keep = [c for c in df.columns if c != inview]
    return df.select(*keep, F.posexplode(inview).alias("pos", item))


def token_sequence(df: DataFrame, cols, width: int, cls: int | None = 1, sep: int = 2, pad: int = 0,
                   prefixes: dict | None = None, out="tokens") -> DataFrame:
    """Concatenate token-id list columns into one fixed-width sequence: optional CLS, each column's
    optional prompt prefix ids, its tokens and a SEP; back-padded with PAD; plus the 1/0 attention mask."""
    parts = [F.array(F.lit(cls))] if cls is not None else []
    for c in as_list(cols):
        if prefixes and c in prefixes:
            parts.append(F.array(*[F.lit(x) for x in prefixes[c]]))
        parts.append(F.coalesce(F.col(c), F.array().cast("array<int>")).cast("array<int>"))
        parts.append(F.array(F.lit(sep)))
    seq = F.slice(F.concat(*parts), 1, width)
    n = F.size(seq)
    return df.withColumn(out, F.concat(seq, F.array_repeat(F.lit(pad), F.lit(width) - n))) \
        .withColumn(f"{out}_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(width) - n)))


def flatten_history(histories: DataFrame, items: DataFrame, user: str, hist: str, item: str, tokens: str,
                    item_sep: int = 3, out="flat") -> DataFrame:
    """One sequence per user: each history item's tokens followed by an item separator, in history order
    (explode with position, join item tokens, ordered flatten)."""
    ex = histories.select(user, F.posexplode(hist).alias("_p", item))
    j = ex.join(items.select(item, tokens), item, "left")
    seq = j.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_p", F.concat(
        F.coalesce(F.col(tokens), F.array().cast("array<int>")), F.array(F.lit(item_sep))).alias("t")))).alias("_l"))
    return seq.select(user, F.flatten(F.transform("_l", lambda e: e["t"])).alias(out))


def history_matrix(df: DataFrame, hist_codes: str, rows: int, width: int, out="matrix") -> DataFrame:
    """History as a rows x width matrix of item codes (each row fit to width), zero rows as padding, mask."""
    fit = F.transform(F.slice(L.C(hist_codes), 1, rows),
                      lambda r: F.concat(F.slice(r, 1, width),
                                         F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.size(r), F.lit(0)))))
    n = F.size(fit)
    zero_row = F.array_repeat(F.lit(0), width)
    return df.withColumn(out, F.concat(fit, F.array_repeat(zero_row, F.lit(rows) - n))) \
        .withColumn(f"{out}_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(rows) - n)))


def first_rows_matrix(events: DataFrame, user: str, order, code: str, rows: int, width: int, out="matrix") -> DataFrame:
    """J19 from an event table ``(user, order columns, code list)``: the matrix of each user's first ``rows`` events.  Only those are
    ever collected, however long a user's history is."""
    order = as_list(order)
    first = top_n_per_group(events.select(user, *order, code), [user], order, rows, salt_on=order)
    hist = first.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(F.col("_rank"), F.col(code).alias("c")))).alias("_h")) \
        .select(user, F.transform("_h", lambda e: e["c"]).alias("_codes"))
    return history_matrix(hist, "_codes", rows, width, out).drop("_codes")


def all_user_rows(users: DataFrame, history: DataFrame, user="user_id", dummy_candidate: int = 0) -> DataFrame:
    """One scoring row per user with a dummy candidate."""
    return users.select(user).distinct().join(history, user, "left") \
        .withColumn("candidate", F.lit(dummy_candidate))
