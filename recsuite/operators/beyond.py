"""Beyond-accuracy metrics.

Inputs: lists ``R(list_id, items array)``, histories ``H(list_id, items array)`` and an item table with vectors /
attributes.  Items missing from the item table are ignored.  Vectors are joined per (list, position) and
aggregated per list with Spark ML's ``Summarizer`` (JVM-side vector sums), so pair metrics use closed forms:

* intra-list diversity (cosine): with unit vectors u (a zero vector stays zero, similarity 0) and m non-zero ones,
  sum_{i != j} (1 - u_i.u_j) = n(n-1) - (|sum u|^2 - m)  ->  divided by n(n-1); undefined for n <= 1;
* serendipity (cosine): mean over R x H of (1 - u_r.u_h) = 1 - mean(u_R) . mean(u_H).

Other distance functions (Q-1) go through the explicit pairwise path ``pairwise_mean_distance``, which is bounded
by the list length squared per list (lists are recommendation lists, not unbounded groups).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.operators.common import as_list, dense_index

MAX_COMBINATIONS = 20000
CELLS = 1 << 21  # combinations that a task looks at together


def _known(lists: DataFrame, list_id: str, col: str, items: DataFrame, key: str, cols) -> DataFrame:
    ex = lists.select(list_id, F.posexplode(col).alias("_pos", key))
    return ex.join(items.select(key, *as_list(cols)), key)


def _with_unit(df: DataFrame, vec: str, out: str = "_u") -> DataFrame:
    """Unit vector as an ML vector (norm computed once per row; a zero vector stays zero)."""
    d = df.withColumn("_nrm", L.norm(vec))
    u = F.transform(vec, lambda x: F.when(F.col("_nrm") > 0, x.cast("double") / F.col("_nrm")).otherwise(F.lit(0.0)))
    return d.withColumn(out, array_to_vector(u))


def _unit_items(items: DataFrame, key: str, vec: str) -> DataFrame:
    """Unit vectors computed once per item (not per listed occurrence), ready to join."""
    return _with_unit(items.select(key, vec), vec).select(key, "_u", (F.col("_nrm") > 0).cast("int").alias("_nz"))


def intra_list_diversity(lists: DataFrame, items: DataFrame, list_id="list_id", col="items", key="item_id",
                         vec="embedding") -> DataFrame:
    """L1: mean pairwise cosine distance inside each list over its known items; NULL when fewer than 2."""
    k = _known(lists, list_id, col, _unit_items(items, key, vec), key, ["_u", "_nz"])
    g = k.groupBy(list_id).agg(Summarizer.sum(F.col("_u")).alias("_s"), F.count(F.lit(1)).alias("_n"),
                               F.sum("_nz").alias("_m"))
    s = vector_to_array("_s")
    sq = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)
    nn = (F.col("_n") * (F.col("_n") - 1)).cast("double")
    div = F.when(F.col("_n") > 1, F.greatest(F.lit(0.0), (nn - (sq - F.col("_m"))) / nn))
    return lists.select(list_id).join(g.select(list_id, div.alias("diversity")), list_id, "left")


def serendipity(R: DataFrame, H: DataFrame, items: DataFrame, list_id="list_id", col="items", key="item_id",
                vec="embedding") -> DataFrame:
    """L2: mean cosine distance between every recommended and every history item (known items only)."""
    units = _unit_items(items, key, vec)

    def mean_unit(df):
        k = _known(df, list_id, col, units, key, ["_u"]).select(list_id, "_u")
        return k.groupBy(list_id).agg(Summarizer.mean(F.col("_u")).alias("_mu")) \
            .select(list_id, vector_to_array("_mu").alias("_mu"))
    r = mean_unit(R).withColumnRenamed("_mu", "_r")
    h = mean_unit(H).withColumnRenamed("_mu", "_h")
    j = r.join(h, list_id)
    return R.select(list_id).join(j.select(list_id, (1.0 - L.dot("_r", "_h")).alias("serendipity")), list_id, "left")


def pairwise_mean_distance(lists: DataFrame, items: DataFrame, distance, list_id="list_id", col="items",
                           key="item_id", vec="embedding") -> DataFrame:
    """Q-1: intra-list diversity with any distance ``distance(Column a, Column b) -> Column`` (e.g.
    ``recsuite.functions.lists.sq_euclidean``): known vectors collected per list (a list is bounded), pair sum
    inside the row with nested ``aggregate``."""
    k = _known(lists, list_id, col, items, key, [vec])
    g = k.groupBy(list_id).agg(F.collect_list(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    n = F.size("_v")
    tot = F.aggregate(F.col("_v"), F.lit(0.0), lambda a, x: a + F.aggregate(
        F.col("_v"), F.lit(0.0), lambda b, y: b + distance(x, y)))
    return g.select(list_id, F.when(n > 1, tot / (n * (n - 1))).alias("diversity"))


def pairwise_serendipity(R: DataFrame, H: DataFrame, items: DataFrame, distance, list_id="list_id", col="items",
                         key="item_id", vec="embedding") -> DataFrame:
    """Q-1 for L2: mean of any ``distance(Column a, Column b)`` between recommended and history items (known items
    only): a recommended list is collected (a list is bounded) and every history item, one row each, is compared with
    it, so a long history is never gathered."""
    r = _known(R, list_id, col, items, key, [vec]).groupBy(list_id) \
        .agg(F.collect_list(F.transform(vec, lambda x: x.cast("double"))).alias("_r"))
    h = _known(H, list_id, col, items, key, [vec]).select(list_id, F.transform(vec, lambda x: x.cast("double")).alias("_h"))
    total = F.aggregate("_r", F.lit(0.0), lambda a, x: a + distance(x, F.col("_h")))
    g = h.join(r, list_id).groupBy(list_id).agg((F.sum(total) / F.sum(F.size("_r"))).alias("serendipity"))
    return R.select(list_id).join(g, list_id, "left")


def mean_attribute(lists: DataFrame, items: DataFrame, attr: str, list_id="list_id", col="items", key="item_id",
                   transform=None, out: str | None = None) -> DataFrame:
    """L3 / L4: mean of an item attribute (``transform`` applied first, e.g. -log2 for novelty) over the known
    items of each list; NULL when none is known."""
    k = _known(lists, list_id, col, items, key, [attr])
    v = transform(F.col(attr)) if transform else F.col(attr)
    g = k.groupBy(list_id).agg(F.avg(v).alias(out or attr))
    return lists.select(list_id).join(g, list_id, "left")


def novelty(lists: DataFrame, items: DataFrame, popularity="popularity", **kw) -> DataFrame:
    """L3: mean self-information -log2(popularity) of the listed items."""
    return mean_attribute(lists, items, popularity, transform=lambda c: -F.log2(c), out="novelty", **kw)


def coverage(lists: DataFrame, candidates: DataFrame | None, col="items", key="item_id") -> DataFrame:
    """Distinct recommended items (counted whether known or not) and their share of the candidate set
    (NULL without a candidate set, Q17)."""
    d = lists.select(F.explode(col).alias(key)).agg(F.countDistinct(key).alias("coverage_count"))
    if candidates is None:
        return d.withColumn("coverage_fraction", F.lit(None).cast("double"))
    c = candidates.select(key).distinct().agg(F.count(F.lit(1))).scalar()
    return d.select("coverage_count", (F.col("coverage_count") / c).alias("coverage_fraction"))


def candidate_subsets(spark, n_items: int, k: int, seed, mode: str, n_samples: int = MAX_COMBINATIONS) -> DataFrame:
    """L6 helper: ``(subset_id, idx)`` rows.  ``mode='all'``: every k-combination of n candidate positions;
    ``mode='sample'``: ``n_samples`` seeded random k-subsets, k draws each (partial Fisher-Yates).  The caller chooses; nothing switches
    by size."""
    if mode not in ("all", "sample"):
        raise ValueError(f"mode {mode!r} is neither all nor sample")
    if k > n_items:
        raise ValueError(f"subsets of {k} items cannot be formed from {n_items} candidates")
    if mode == "all":
        # k-combinations grown position by position from a range: the executors build them
        subs = spark.range(n_items).select(F.array("id").alias("_c"))
        for _ in range(k - 1):
            rest = F.col("_c")[F.size("_c") - 1] + 1
            subs = subs.filter(rest < n_items).select(
                "_c", F.explode(F.sequence(rest, F.lit(n_items - 1).cast("bigint"))).alias("_n")) \
                .select(F.concat("_c", F.array("_n")).alias("_c"))
        return subs.select(F.xxhash64("_c").alias("subset_id"), F.explode("_c").alias("idx"))
    from recsuite.operators.sampling import unrolled_sample_indices
    ids = spark.range(n_samples).withColumnRenamed("id", "subset_id").withColumn("_n", F.lit(n_items))
    d = unrolled_sample_indices(ids, "_n", k, seed, "subset_id", "_o")
    return d.select("subset_id", F.explode(F.array(*[F.col(f"_o{i}").cast("bigint") for i in range(k)])).alias("idx"))


def candidate_diversity_bounds(candidates: DataFrame, items: DataFrame, k: int, seed, key="item_id",
                               vec="embedding", mode: str = "all", n_samples: int = MAX_COMBINATIONS) -> DataFrame:
    """Min / max intra-list diversity over k-subsets of the (known) candidate list: all of them, or a seeded sample.
    Samples become lists; all combinations are never rows: see ``_all_subset_bounds``."""
    if mode not in ("all", "sample"):
        raise ValueError(f"mode {mode!r} is neither all nor sample")
    known = candidates.select(key).distinct().join(items.select(key), key, "left_semi")
    idx = dense_index(known, [key], "idx")
    n = idx.count()
    if mode == "all":
        if k > n:
            raise ValueError(f"subsets of {k} items cannot be formed from {n} candidates")
        return _all_subset_bounds(idx, n, items, k, key, vec)
    subs = candidate_subsets(candidates.sparkSession, n, k, seed, mode, n_samples)
    lists = subs.join(idx, "idx").groupBy("subset_id").agg(F.collect_list(key).alias("items"))
    d = intra_list_diversity(lists, items, "subset_id", "items", key, vec)
    return d.agg(F.min("diversity").alias("min_diversity"), F.max("diversity").alias("max_diversity"))


def _all_subset_bounds(idx: DataFrame, n: int, items: DataFrame, k: int, key: str, vec: str) -> DataFrame:
    """Bounds over all k-combinations of the ``n`` indexed candidates.  They are cut into blocks so small that the
    combinations across k blocks fit ``CELLS``; a row is one combination of blocks with their vectors, and gives the
    smallest and largest diversity inside it.  A task holds one row at a time, whatever the number of candidates, and
    no combination is ever a row.  Sums over a list's items are sums over its pairs: |sum u|^2 = sum |u|^2 + 2 sum u_i.u_j."""
    side = max(1, int(CELLS ** (1 / k)))
    units = _unit_items(items, key, vec).join(idx, key)
    per = units.groupBy("idx").agg(Summarizer.sum(F.col("_u")).alias("_s"), F.count(F.lit(1)).alias("_n"),
                                   F.sum("_nz").alias("_m"))
    block = per.groupBy(F.floor(F.col("idx") / side).alias("_b")).agg(F.array_sort(F.collect_list(F.struct(
        "idx", vector_to_array("_s").alias("s"), "_n", "_m"))).alias("_rows"))  # ``side`` rows
    block = block.select("_b", F.flatten(F.transform("_rows", lambda r: r["s"])).alias("s"),
                         F.transform("_rows", lambda r: r["_n"]).alias("n"), F.transform("_rows", lambda r: r["_m"]).alias("m"))
    # ascending block numbers, a block as often as it has items; the executors build them
    n_blocks = -(-n // side)
    t = idx.sparkSession.range(n_blocks).select(F.array("id").alias("_c"))
    for _ in range(k - 1):
        last = F.element_at("_c", -1)
        t = t.select("_c", F.explode(F.sequence(last, F.lit(n_blocks - 1).cast("bigint"))).alias("_n")) \
            .select(F.concat("_c", F.array("_n")).alias("_c"))
    t = t.select(*[F.col("_c")[i].alias(f"_b{i}") for i in range(k)])
    for i in range(k):
        own = block.select(F.col("_b").alias(f"_b{i}"), F.struct("s", "n", "m").alias(f"_v{i}"))
        t = t.hint("merge").join(own, f"_b{i}")  # how many combinations there are, only the run shows

    names = [f"_b{i}" for i in range(k)]

    def run(row: pa.Table) -> pa.Table:
        low, high = _bounds_of([row[c][0].as_py() for c in names], [row[f"_v{i}"][0] for i in range(k)])
        return pa.table({"low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    d = t.groupBy(*names).applyInArrow(run, "low double, high double")  # a group is one row
    return d.agg(F.min("low").alias("min_diversity"), F.max("high").alias("max_diversity"))


def _bounds_of(blocks: list[int], values: list) -> tuple[float | None, float | None]:
    """(min, max) diversity of the lists that take one item of each block, ascending inside a block."""
    k = len(blocks)
    part = []
    for v in values:
        n, m = (np.asarray(v[c].as_py(), np.float64) for c in ("n", "m"))
        part.append((np.asarray(v["s"].values).reshape(len(n), -1), n, m))
    axis = lambda a, i: a.reshape([-1 if j == i else 1 for j in range(k)])
    shape = [len(p[1]) for p in part]
    size, excess = np.zeros([1] * k), np.zeros(shape)  # items of a list; |sum u|^2 less the non-zero ones
    valid = np.ones([1] * k, bool)
    for i, (s, n, m) in enumerate(part):
        size = size + axis(n, i)
        excess += axis(np.einsum("ij,ij->i", s, s) - m, i)
        for j in range(i):
            dots = 2.0 * (part[j][0] @ s.T)
            excess += dots.reshape([shape[x] if x in (i, j) else 1 for x in range(k)])
            if blocks[i] == blocks[j] and i == j + 1:
                valid = valid & (axis(np.arange(shape[j]), j) < axis(np.arange(shape[i]), i))
    pairs = size * (size - 1)
    valid = np.broadcast_to(valid & (size > 1), shape)
    if not valid.any():
        return None, None
    div = np.maximum(0.0, (pairs - excess) / np.where(pairs > 0, pairs, 1.0))
    return float(np.min(div, where=valid, initial=np.inf)), float(np.max(div, where=valid, initial=-np.inf))


def candidate_bounds(candidates: DataFrame, items: DataFrame, attr: str, n: int, key="item_id",
                     transform=None) -> DataFrame:
    """Mean of the n highest and of the n lowest attribute values among the candidates (returned as
    ``from_highest``, ``from_lowest``; the reference returns them as (min, max) in that order, Q16)."""
    v = transform(F.col(attr)) if transform else F.col(attr)
    vals = candidates.select(key).distinct().join(items.select(key, attr), key).select(key, v.alias("_v"))
    hi = vals.orderBy(F.col("_v").desc(), F.col(key)).limit(n).agg(F.avg("_v")).scalar()
    lo = vals.orderBy(F.col("_v").asc(), F.col(key)).limit(n).agg(F.avg("_v")).scalar()
    return vals.sparkSession.range(1).select(hi.alias("from_highest"), lo.alias("from_lowest"))


def attribute_distribution(lists: DataFrame, items: DataFrame, attr: str, list_id="list_id", col="items",
                           key="item_id") -> DataFrame:
    """Distribution of a scalar or list attribute over all listed known items (shares sum to 1)."""
    k = _known(lists, list_id, col, items, key, [attr])
    dt = items.schema[attr].dataType.typeName()
    vals = k.select((F.explode(attr) if dt == "array" else F.col(attr)).alias("value"))
    c = vals.groupBy("value").agg(F.count(F.lit(1)).alias("_c"))
    tot = c.agg(F.sum("_c")).scalar()
    return c.select("value", (F.col("_c") / tot).alias("share"))


def broadcast_list(users: DataFrame, ranked: DataFrame, list_id="list_id", col="items") -> DataFrame:
    """Give every user the same (baseline) list: a one-row list as a scalar subquery."""
    return users.select(list_id).withColumn(col, ranked.select(col).scalar())


def check_consistent_lists(df: DataFrame, col: str) -> DataFrame:
    """Raise unless every row holds the same list."""
    n = df.agg(F.countDistinct(F.array_join(F.transform(col, lambda x: x.cast("string")), ",")).alias("n")).first()["n"]
    if n != 1:
        raise ValueError(f"{n} different candidate lists, expected 1")
    return df


def check_attribute(items: DataFrame, attr: str, key="item_id") -> DataFrame:
    """Raise, naming an item, when any item lacks the attribute."""
    r = items.agg(F.count_if(F.col(attr).isNull()).alias("n"),
                  F.min_by(key, F.when(F.col(attr).isNull(), F.col(key))).alias("first")).first()
    if r["n"]:
        raise ValueError(f"{r['n']} items lack '{attr}', e.g. {r['first']}")
    return items


BLOCK_LISTS = 1000  # baseline lists whose mean vectors form one array value; more are worked off in blocks


def baseline_report(lists: DataFrame, histories: DataFrame, vectors: DataFrame, popularity: DataFrame,
                    attrs: DataFrame, attr: str = "sentiment_score", list_name="list", col="items", user="list_id",
                    key="item_id", vec="embedding", block: int = BLOCK_LISTS) -> DataFrame:
    """Every baseline list given to every user, reported as mean / population std over users per list and
    metric, in one pass and without materialising user x list rows:

    * diversity, novelty and ``attr`` of a list do not depend on the user: computed once per list (std 0);
    * serendipity(user, list) = 1 - mean_unit(list) . mean_unit(history(user)); the lists' mean unit vectors
      become one array value per block of lists, scanned inside each user row.
    Users whose history has no known item get no serendipity value (as L2)."""
    L1 = lists.select(F.col(list_name).alias("_lid"), col)
    units = _unit_items(vectors, key, vec)
    mu_l = _known(L1, "_lid", col, units, key, ["_u"]).groupBy("_lid").agg(Summarizer.mean(F.col("_u")).alias("_m")) \
        .select("_lid", vector_to_array("_m").alias("_m"))
    mu_h = _known(histories, user, col, units, key, ["_u"]).groupBy(user).agg(Summarizer.mean(F.col("_u")).alias("_h")) \
        .select(user, vector_to_array("_h").alias("_h"))
    n_lists = lists.count()
    if n_lists > block:
        mu_l = dense_index(mu_l, ["_lid"], "_b").withColumn("_b", F.floor(F.col("_b") / block))
    per = None
    for i in range(max(1, -(-n_lists // block))):
        own = mu_l.filter(F.col("_b") == i) if n_lists > block else mu_l
        arr = own.agg(F.collect_list(F.struct(F.col("_lid").alias("l"), F.col("_m").alias("m")))).scalar()
        part = mu_h.withColumn("_ls", arr).select(F.explode(F.transform(
            "_ls", lambda e: F.struct(e["l"].alias("list"), (1.0 - L.dot(e["m"], "_h")).alias("v")))).alias("_p"))
        per = part if per is None else per.unionByName(part)
    ser = per.groupBy(F.col("_p.list").alias("list")).agg(F.avg("_p.v").alias("mean"), F.stddev_pop("_p.v").alias("std"))
    # a list without any known item still gets its (undefined) serendipity row
    ser = L1.select(F.col("_lid").alias("list")).join(ser, "list", "left").withColumn("metric", F.lit("serendipity"))
    div = intra_list_diversity(L1, vectors, "_lid", col, key, vec).select(F.col("_lid").alias("list"), F.col("diversity").alias("v")) \
        .withColumn("metric", F.lit("diversity"))
    nov = novelty(L1, popularity, list_id="_lid", col=col, key=key).select(F.col("_lid").alias("list"), F.col("novelty").alias("v")) \
        .withColumn("metric", F.lit("novelty"))
    sen = mean_attribute(L1, attrs, attr, list_id="_lid", col=col, key=key, out="v").select(F.col("_lid").alias("list"), "v") \
        .withColumn("metric", F.lit(attr))
    const = div.unionByName(nov).unionByName(sen).select("list", "metric", F.col("v").alias("mean"),
                                                          F.when(F.col("v").isNotNull(), F.lit(0.0)).alias("std"))
    return ser.select("list", "metric", "mean", "std").unionByName(const)
