"""Descriptive analytics.  Every statistic is one or two aggregations; scalars that feed a
second pass (maxima, ranges, totals) are scalar subqueries (``DataFrame.scalar()``): one value, no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsuite.functions.lists import size0
from recsuite.operators.common import as_list


def nested_time_span(df: DataFrame, col: str) -> DataFrame:
    """Min / max over a column of lists (e.g. history timestamps)."""
    return df.agg(F.min(F.array_min(col)).alias("min"), F.max(F.array_max(col)).alias("max"))


def time_span(df: DataFrame, col: str) -> DataFrame:
    """Min / max of a scalar column."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def with_max_length(df: DataFrame, col: str, out="max_length") -> DataFrame:
    """D3: the maximum list length attached to every row (one-row aggregate, broadcast)."""
    return df.withColumn(out, df.agg(F.max(size0(col))).scalar())


def token_counts(df: DataFrame, cols, out="token") -> DataFrame:
    """Occurrence counts of tokens over one or several list/scalar columns sharing a vocabulary."""
    parts = []
    for c in as_list(cols):
        dt = df.schema[c].dataType.typeName()
        parts.append(df.select((F.explode(c) if dt == "array" else F.col(c)).alias(out)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.filter(F.col(out).isNotNull()).groupBy(out).agg(F.count(F.lit(1)).alias("count"))


def log_decade_histogram(counts: DataFrame, col="count") -> DataFrame:
    """How many tokens fall in each bin [k*10^d, (k+1)*10^d); empty bins are absent.  The decade comes from
    the digit count of the integer (no floating-point log)."""
    d = F.length(F.col(col).cast("bigint").cast("string")) - 1
    p = F.pow(F.lit(10), d).cast("bigint")
    lo = (F.floor(F.col(col) / p) * p).cast("bigint")
    return counts.filter(F.col(col) > 0).groupBy(lo.alias("lo"), (lo + p).alias("hi")) \
        .agg(F.count(F.lit(1)).alias("n"))


def length_summary(df: DataFrame, col: str) -> DataFrame:
    """Min / max / mean of a list column's length."""
    n = size0(col)
    return df.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"))


def equal_width_histogram(df: DataFrame, col: str, groups: int = 50) -> DataFrame:
    """Equal-width integer histogram with a cap on the number of groups; every bin reported (zeros too).
    range = max-min+1, groups = min(groups, range), width = ceil(range/groups), bins = ceil(range/width)."""
    stats = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    rng = F.col("_mx") - F.col("_mn") + 1
    g = F.least(F.lit(groups), rng)
    width = F.ceil(rng / g).cast("bigint")
    s = stats.select("_mn", width.alias("_w"), F.ceil(rng / width).cast("bigint").alias("_bins"))
    mn, w = s.select("_mn").scalar(), s.select("_w").scalar()
    counts = df.select(((F.col(col) - mn) / w).cast("bigint").alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    all_bins = s.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_bins") - 1)).alias("bin"),
                        "_mn", "_w")
    return all_bins.join(counts, "bin", "left").select(
        "bin", (F.col("_mn") + F.col("bin") * F.col("_w")).alias("lo"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def exposures(impressions: DataFrame, items: DataFrame, attr: str, inview="inview", clicked="clicked",
              item="item_id", key="impression_id") -> DataFrame:
    """Flat exposure rows (impression, item, clicked flag, attribute) used by D8-D10."""
    e = impressions.select(key, F.explode(inview).alias(item), F.col(clicked))
    e = e.withColumn("is_click", F.coalesce(F.array_contains(clicked, F.col(item)), F.lit(False)).cast("int")).drop(clicked)
    return e.join(items.select(item, F.col(attr).alias("attr")), item, "left")


def ctr_by_attribute(exp: DataFrame) -> DataFrame:
    """Shown / clicked / CTR per attribute value, plus the overall row (attr NULL)."""
    per = exp.groupBy("attr").agg(F.count(F.lit(1)).alias("shown"), F.sum("is_click").cast("bigint").alias("clicked"))
    tot = exp.agg(F.count(F.lit(1)).alias("shown"), F.sum("is_click").cast("bigint").alias("clicked")) \
        .select(F.lit(None).cast(per.schema["attr"].dataType).alias("attr"), "shown", "clicked")
    out = per.unionByName(tot)
    return out.withColumn("ctr", F.try_divide(F.col("clicked").cast("double"), F.col("shown")))


def exposure_shares(exp: DataFrame, key="impression_id") -> DataFrame:
    """Share of exposures lacking the attribute, and share of impressions showing at least one such item."""
    per_imp = exp.groupBy(key).agg(F.count_if(~F.coalesce(F.col("attr"), F.lit(False))).alias("n_without"),
                                   F.count(F.lit(1)).alias("n"))
    return per_imp.agg(
        F.try_divide(F.sum("n_without").cast("double"), F.sum("n")).alias("share_exposures_without"),
        F.avg((F.col("n_without") > 0).cast("double")).alias("share_impressions_with_any"))


def ctr_by_segment(exp: DataFrame, key="impression_id") -> DataFrame:
    """CTR of impressions showing only attribute items vs mixed impressions (two-level aggregation)."""
    per_imp = exp.groupBy(key).agg(
        F.min(F.coalesce(F.col("attr").cast("int"), F.lit(0))).alias("_all"),
        F.count(F.lit(1)).alias("shown"), F.sum("is_click").alias("clicked"))
    seg = F.when(F.col("_all") == 1, F.lit("only_attr")).otherwise(F.lit("mixed"))
    return per_imp.groupBy(seg.alias("segment")).agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("shown").cast("bigint").alias("shown"),
        F.sum("clicked").cast("bigint").alias("clicked")) \
        .withColumn("ctr", F.try_divide(F.col("clicked").cast("double"), F.col("shown")))


def distinct_item_counts(exp: DataFrame, item="item_id") -> DataFrame:
    """Distinct items shown, shown with the attribute, clicked with the attribute."""
    a = F.coalesce(F.col("attr"), F.lit(False))
    return exp.agg(F.countDistinct(item).alias("n_items"),
                   F.countDistinct(F.when(a, F.col(item))).alias("n_with_attr"),
                   F.countDistinct(F.when(a & (F.col("is_click") == 1), F.col(item))).alias("n_clicked_with_attr"))


def popularity(lists: DataFrame, col: str, out_item="item_id") -> DataFrame:
    """Share of lists containing each item (an item counts once per list)."""
    n = lists.agg(F.count(F.lit(1))).scalar()
    c = lists.select(F.explode(F.array_distinct(col)).alias(out_item)).groupBy(out_item).agg(F.count(F.lit(1)).alias("_c"))
    return c.select(out_item, (F.col("_c") / n).alias("popularity"))


def distribution(df: DataFrame, col: str, weight: str | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Normalised (optionally weighted) distribution of a column's values; a prior distribution
    ``(value, share)`` can be added before normalising."""
    w = F.col(weight) if weight else F.lit(1.0)
    d = df.groupBy(F.col(col).alias("value")).agg(F.sum(w).alias("mass"))
    if prior is not None:
        d = d.unionByName(prior.select("value", F.col("share").alias("mass"))).groupBy("value").agg(
            F.sum("mass").alias("mass"))
    tot = d.agg(F.sum("mass")).scalar()
    return d.select("value", (F.col("mass") / tot).alias("share"))


def index_of_dispersion(df: DataFrame, col: str, by=()) -> DataFrame:
    """k(N^2 - sum f^2) / (N^2 (k-1)) over the category frequencies; one category: NULL if N = 1, else 0."""
    g = as_list(by)
    f = df.groupBy(*g, col).agg(F.count(F.lit(1)).alias("f"))
    agg = f.groupBy(*g).agg(F.count(F.lit(1)).alias("k"), F.sum("f").alias("N"), F.sum(F.col("f") * F.col("f")).alias("sf2"))
    N2 = (F.col("N") * F.col("N")).cast("double")
    iod = F.when(F.col("k") == 1, F.when(F.col("N") == 1, F.lit(None)).otherwise(F.lit(0.0))) \
        .otherwise(F.col("k") * (N2 - F.col("sf2")) / (N2 * (F.col("k") - 1)))
    return agg.select(*g, iod.alias("index_of_dispersion"))


def neg_pos_ratio(df: DataFrame, label="label") -> DataFrame:
    """Number of negatives per positive."""
    return df.agg(F.try_divide(F.sum(1 - F.col(label)).cast("double"), F.sum(F.col(label))).alias("neg_pos_ratio"))


def normalize(df: DataFrame, col: str, method="minmax", lo: float | None = None, hi: float | None = None,
              out: str | None = None) -> DataFrame:
    """D16: 'max' (x / max) or 'minmax' ((x-min)/(max-min)) normalisation, optionally rescaled to [lo, hi]; a bound
    of 0 counts as given (``is None`` semantics, Q18)."""
    bounds = df.agg(F.struct(F.min(col).alias("mn"), F.max(col).alias("mx")).alias("b")).scalar()  # one pass
    mn, mx = bounds["mn"], bounds["mx"]
    x = F.col(col)
    if method == "max":
        v = x / mx
    else:
        v = F.try_divide(x - mn, mx - mn)
    if lo is not None and hi is not None:
        v = v * (hi - lo) + lo
    return df.withColumn(out or f"{col}_norm", v.cast("double"))


def summary(df: DataFrame) -> DataFrame:
    """Column summary (count, mean, stddev, min, quartiles, max) via Spark's own ``summary``."""
    return df.summary()


def mean_std_by(df: DataFrame, by, col: str) -> DataFrame:
    """Mean and population standard deviation (numpy ddof=0) of a per-row metric by group."""
    return df.groupBy(*as_list(by)).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))


def items_per_user(users: DataFrame, rows: DataFrame, user="user_id", item="item_id", order=None) -> DataFrame:
    """The items of each user (ordered by ``order`` or item), users without rows get []."""
    o = as_list(order) or [item]
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(o)]
    coll = rows.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(*keys, F.col(item).alias("_v")))).alias("_l")) \
        .select(user, F.transform("_l", lambda e: e["_v"]).alias("items"))
    return users.select(user).distinct().join(coll, user, "left") \
        .withColumn("items", F.coalesce("items", F.array().cast(coll.schema["items"].dataType)))


def union_of_lists(df: DataFrame, user: str, col: str, out="items") -> DataFrame:
    """Set-union of per-row lists per user (sorted)."""
    return df.select(user, F.explode(col).alias("_x")).groupBy(user).agg(F.sort_array(F.collect_set("_x")).alias(out))


def interactions_per_user(history: DataFrame, rows: DataFrame, user="user_id", hist_col="history") -> DataFrame:
    """History length + number of interaction rows per user."""
    n = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    return history.select(user, size0(hist_col).alias("_h")).join(n, user, "full") \
        .select(user, (F.coalesce("_h", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint").alias("n_interactions"))


def users_with_versions(versions: DataFrame, user="user_id", version="uid_k") -> DataFrame:
    """Number of users with more than one history version."""
    return versions.groupBy(user).agg(F.countDistinct(version).alias("_v")).agg(
        F.count_if(F.col("_v") > 1).cast("bigint").alias("n_users_multi_version"))


def attribute_inventory(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a (possibly list) attribute."""
    dt = df.schema[col].dataType.typeName()
    return df.select((F.explode(col) if dt == "array" else F.col(col)).alias("value")).distinct()
