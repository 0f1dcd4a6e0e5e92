"""Ranking, top-k, sampling and splitting.

Randomness is the md5 key of ``recsuite.functions.rng`` (portable, partition-independent).  Global orders that
feed dense positions (rank scores, equal parts, weighted splits, removals) use ``dense_index`` — range partitions
plus per-partition offsets — never a single-partition window or a row limit that grows with the data.  ``limit``
is used only where the result size is the feature (top-N reports).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.functions import rng
from recsuite.operators.common import as_list, dense_index


def rank_score(df: DataFrame, col: str, id_col: str, out="score") -> DataFrame:
    """score = 1 / rank under ``col`` descending (ties by id); output id, column, score."""
    r = dense_index(df.select(id_col, col), [F.col(col).desc(), F.col(id_col)], "_r", start=1)
    return r.select(id_col, col, (1.0 / F.col("_r")).alias(out))


def submission_ranks(df: DataFrame, group: str, pos="pos", score="score", out="ranks") -> DataFrame:
    """rank of every candidate inside its group (stable descending sort: earlier position wins ties, Q4),
    reported as a list in position order; duplicates keep their own rank (Q29)."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(pos))
    r = df.withColumn("_rk", F.row_number().over(w))
    return r.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(pos, "_rk"))).alias("_l")) \
        .select(group, F.transform("_l", lambda e: e["_rk"]).alias(out))


def top_n(df: DataFrame, order, n: int) -> DataFrame:
    """the first n rows under ``order`` (a top-N report: TakeOrdered keeps n rows per task)."""
    return df.orderBy(*as_list(order)).limit(n)


def top_users_by_activity(df: DataFrame, k: int, user="user_id") -> DataFrame:
    """the k most active users (count desc, id); a negative k means ``n_users // -k`` users."""
    counts = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    idx = dense_index(counts, [F.col("n").desc(), F.col(user)], "_i")
    if k >= 0:
        return idx.filter(F.col("_i") < k).select(user, "n")
    n_users = counts.agg(F.count(F.lit(1))).scalar()
    return idx.filter(F.col("_i") < F.floor(n_users / -k)).select(user, "n")


def random_users(df: DataFrame, k: int, seed, user="user_id") -> DataFrame:
    """k users chosen at random (smallest md5 keys) among those present."""
    u = df.select(user).distinct().withColumn("_k", rng.md5_key(seed, F.col(user)))
    return dense_index(u, ["_k"], "_i").filter(F.col("_i") < k).select(user)


def shuffle_rows(df: DataFrame, seed, key, out: str | None = None) -> DataFrame:
    """F8: rows in a seeded random order (the md5 key of the row key); ``out`` names a column for the 0-based
    position, without it the rows are sorted."""
    s = df.withColumn("_k", rng.md5_key(seed, *[F.col(c) for c in as_list(key)]))
    if out is None:
        return s.orderBy("_k").drop("_k")
    return dense_index(s, ["_k", *as_list(key)], out).drop("_k")


def sample_fraction(df: DataFrame, fraction: float, seed, key) -> DataFrame:
    """portable row sample: keep rows whose md5 draw is below the fraction (a filter, no shuffle)."""
    return df.filter(rng.uniform(seed, *[F.col(c) for c in as_list(key)]) < fraction)


def equal_parts(df: DataFrame, n_parts: int, order, out="part") -> DataFrame:
    """n contiguous parts of ceil(N/n) rows in ``order``; the last part may be short."""
    idx = dense_index(df, order, "_i")
    n = idx.agg(F.coalesce(F.max("_i") + 1, F.lit(0))).scalar()
    return idx.withColumn(out, F.floor(F.col("_i") / F.ceil(n / n_parts)).cast("int")).drop("_i")


def weighted_split(keys: DataFrame, weights: dict[str, float], seed, key: str, out="phase") -> DataFrame:
    """Assign each distinct key to a named part: keys in md5-shuffled order, part sizes floor(N * w /
    sum w), the remainder to the last part.  Returns the (key, part) assignment table (persist it to reuse)."""
    d = keys.select(key).distinct().withColumn("_k", rng.md5_key(seed, F.col(key)))
    idx = dense_index(d, ["_k", key], "_i")
    n = idx.agg(F.coalesce(F.max("_i") + 1, F.lit(0))).scalar()
    total = float(sum(weights.values()))
    names = list(weights)
    j = idx
    # cumulative floor sizes: part i holds indices [sum_{<i} floor(N w/W), sum_{<=i} floor(N w/W))
    expr = None
    cum = F.lit(0)
    for nm in names[:-1]:
        cum = cum + F.floor(n * (weights[nm] / total))
        cond = F.col("_i") < cum
        expr = F.when(cond, F.lit(nm)) if expr is None else expr.when(cond, F.lit(nm))
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return j.select(key, expr.alias(out))


def random_lists(df: DataFrame, pool: DataFrame, n: int, seed, key: str, pool_item="item_id", out="ranked") -> DataFrame:
    """a random N-item candidate list per row drawn from the candidate pool without replacement (seeded per
    row, partial Fisher-Yates: n draws per row whatever the pool size).  The pool gets a dense index once; a row's
    drawn positions are looked up in it by an equi-join, so pools of any size work."""
    idx = dense_index(pool.select(F.col(pool_item).alias("_it")).filter(F.col("_it").isNotNull()).distinct(), ["_it"], "_ci")
    size = idx.agg(F.count(F.lit(1))).scalar()
    keys = df.select(key).distinct()
    d = unrolled_sample_indices(keys.withColumn("_P", size), "_P", n, seed, key, "_o")
    d = d.select(key, F.posexplode(F.array(*[F.col(f"_o{i}").cast("bigint") for i in range(n)])).alias("_d", "_ci"))
    lists = d.join(idx, "_ci").groupBy(F.col(key).alias("_key")) \
        .agg(F.array_sort(F.collect_list(F.struct("_d", "_it"))).alias("_l"))  # n entries a row
    none = F.array().cast(f"array<{pool.schema[pool_item].dataType.simpleString()}>")
    return df.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left") \
        .withColumn(out, F.coalesce(F.transform("_l", lambda e: e["_it"]), none)).drop("_key", "_l")


def unrolled_sample_indices(df: DataFrame, size: str, n: int, seed, key: str, prefix: str = "_o") -> DataFrame:
    """The partial Fisher-Yates of ``lists.sample_indices`` unrolled at plan time (n is known): step k draws its
    swap partner j_k, reads the current values at k and j_k from two small arrays of earlier swaps (latest swap
    wins: ``array_position`` on the reversed arrays), emits ``{prefix}{k}`` (NULL beyond the size) and appends the
    swap.  Plain array functions only, so the generated code grows linearly with n."""
    sz = F.col(size)
    d = df.withColumns({"_js": F.array().cast("array<bigint>"), "_as": F.array().cast("array<bigint>")})

    def val(x):
        p = F.array_position(F.reverse(F.col("_js")), x)
        return F.when(p > 0, F.element_at(F.reverse(F.col("_as")), p.cast("int"))).otherwise(x.cast("bigint"))

    for k in range(n):
        ok = sz > k
        d = d.withColumn("_jk", F.when(ok, F.lit(k).cast("bigint")
                                       + F.pmod(rng.draw32(seed, F.col(key), F.lit(k)), F.greatest(sz - k, F.lit(1)))))
        d = d.withColumns({"_ak": F.when(ok, val(F.lit(k))), f"{prefix}{k}": F.when(ok, val(F.col("_jk"))).cast("int")})
        d = d.withColumns({"_js": F.concat("_js", F.array(F.col("_jk"))), "_as": F.concat("_as", F.array(F.col("_ak")))})
    return d.drop("_js", "_as", "_jk", "_ak")


def random_permutation_ranks(col, seed, row_key):
    """F16: a random permutation of ranks 1..len per row."""
    c = L.C(col)
    return L.shuffle_list(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), seed, row_key)


def remove_random(keys: DataFrame, n_remove: int, seed, key: str) -> DataFrame:
    """drop n_remove keys chosen at random: keep the keys ranked >= n_remove in md5 order."""
    d = keys.select(key).distinct().withColumn("_k", rng.md5_key(seed, F.col(key)))
    return dense_index(d, ["_k", key], "_i").filter(F.col("_i") >= n_remove).select(key)
