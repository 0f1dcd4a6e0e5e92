"""List-column operators as Spark higher-order-function expressions.

Everything here runs inside the row (``transform``/``filter``/``aggregate``/``zip_with``/``array_sort``), so none
of it shuffles.  Null semantics follow the reference (SURVEY section 1.3): membership against a NULL list is
false, set-minus keeps duplicates, ``tail(n)`` of a short list is the whole list, size of NULL is 0 where a
count is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsuite.functions import rng


def C(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size0(c) -> Column:
    """Length with NULL -> 0 (ANSI ``size(NULL)`` is NULL)."""
    return F.coalesce(F.size(C(c)), F.lit(0))


def contains(arr, x) -> Column:
    """Membership that is false (not NULL) for NULL lists and lists holding NULLs."""
    return F.coalesce(F.array_contains(C(arr), x), F.lit(False))


# ---- B3-B11: list filters -----------------------------------------------------------------------------------
def min_list_length(df: DataFrame, col: str, n: int | None) -> DataFrame:
    """Keep rows whose list has at least n elements; n None/<=0 or a missing column is a no-op."""
    if n is None or n <= 0 or col not in df.columns:
        return df
    return df.filter(F.size(col) >= n)


def max_list_length(df: DataFrame, col: str, n: int | None) -> DataFrame:
    """Keep rows whose list has at most n elements (same no-op rule)."""
    if n is None or n <= 0 or col not in df.columns:
        return df
    return df.filter(F.size(col) <= n)


def min_negatives(df: DataFrame, n: int, inview="inview", clicked="clicked") -> DataFrame:
    """Keep impressions with at least n non-clicked in-view items: len(inview) - len(clicked) >= n."""
    return df.filter(size0(inview) - size0(clicked) >= n)


def keep_elements_in(col, values) -> Column:
    """B9 (small literal set): keep list elements in ``values``; a list left empty becomes NULL (Q19)."""
    lit = F.array(*[F.lit(v) for v in values])
    f = F.filter(C(col), lambda x: F.array_contains(lit, x))
    return F.when(F.size(f) > 0, f)


def drop_null_elements(col) -> Column:
    """Drop NULL elements; a NULL list stays NULL."""
    return F.array_compact(C(col))


def distinct_elements(col) -> Column:
    """De-duplicate list elements (first occurrence kept)."""
    return F.array_distinct(C(col))


# ---- E4, E5: truncation and padding ---------------------------------------------------------------------------
def tail(col, n: int, pad=None) -> Column:
    """Last n elements; with ``pad`` the list is front-padded to exactly n."""
    c = C(col)
    if pad is None:
        return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)
    return F.slice(F.concat(F.array_repeat(F.lit(pad), n), c), -n, n)


def fit_length(col, max_length: int, keep="tail", pad=None, pad_side="front") -> Column:
    """E5: keep the head or the tail of a list up to ``max_length``; optionally pad (front or back) to it."""
    c = C(col)
    cut = tail(c, max_length) if keep == "tail" else F.slice(c, 1, max_length)
    if pad is None:
        return cut
    filler = F.array_repeat(F.lit(pad), F.greatest(F.lit(max_length) - F.size(cut), F.lit(0)))
    return F.concat(filler, cut) if pad_side == "front" else F.concat(cut, filler)


def pad_mask(col, max_length: int) -> Column:
    """1 for each real element, 0 for each back-padding slot."""
    n = F.least(size0(col), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))


# ---- J1, J2: labels from lists ---------------------------------------------------------------------------
def binary_labels(inview="inview", clicked="clicked") -> Column:
    """1 where the in-view item was clicked, else 0 (a NULL clicked list gives all 0)."""
    return F.transform(C(inview), lambda x: contains(clicked, x).cast("int"))


def remove_positives(inview="inview", clicked="clicked") -> Column:
    """In-view items that were not clicked, duplicates kept (not a set difference)."""
    return F.filter(C(inview), lambda x: ~contains(clicked, x))


# ---- F2: ranks inside a list -------------------------------------------------------------------------------
def rank_in_list(scores) -> Column:
    """F2: rank of each score inside its list (1 = best); equal scores: later position ranks first (Q3)."""
    s = C(scores)
    order = F.array_sort(F.transform(s, lambda x, i: F.struct((-x).alias("k"), (-i).alias("j"))))
    pos = F.transform(order, lambda e: -e["j"])
    # inverse permutation: rank of position i = 1 + index of i in ``pos``
    return F.transform(s, lambda x, i: F.array_position(pos, i).cast("int"))


# ---- F7, F9, F17: seeded list randomness ---------------------------------------------------------------------
def shuffle_list(col, seed, row_key) -> Column:
    """permutation of a list keyed by md5(seed|row|position): same result under any partitioning."""
    c = C(col)
    keyed = F.transform(c, lambda x, i: F.struct(rng.md5_key(seed, C(row_key), i).alias("k"), i.alias("i"),
                                                  x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda e: e["x"])


def sample_list(col, n: int, seed, row_key, replace: bool = False, on_short: str = "take_all") -> Column:
    """n elements of a list.  Without replacement = first n of the seeded shuffle (``on_short``: 'take_all'
    keeps a short list whole, 'null' gives NULL).  With replacement = n seeded draws; an empty list gives NULLs
    (Q20)."""
    c = C(col)
    if not replace:
        s = F.slice(shuffle_list(c, seed, row_key), 1, n)
        return s if on_short == "take_all" else F.when(size0(c) >= n, s)
    idx = lambda k: F.pmod(rng.draw32(seed, C(row_key), k), F.greatest(F.size(c), F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.lit(n)),
                       lambda k: F.when(F.size(c) > 0, F.element_at(c, (idx(k) + 1).cast("int"))))


def sample_indices(size, n: int, seed, row_key) -> Column:
    """n distinct 0-based indices out of ``size`` per row: a partial Fisher-Yates shuffle whose k-th swap
    partner is k + draw(seed, row, k) mod (size - k).  n md5 draws per row whatever the size; the swaps live in
    a small in-row list (O(n^2) per row)."""
    size = C(size)
    m = F.least(F.lit(n), size)
    init = F.struct(F.array().cast("array<struct<i:int,v:int>>").alias("sw"), F.array().cast("array<int>").alias("out"))

    def val(sw, x):
        return F.coalesce(F.try_element_at(F.filter(sw, lambda e: e["i"] == x), F.lit(-1))["v"], x)

    def step(acc, k):
        j = (k + F.pmod(rng.draw32(seed, C(row_key), k), size - k)).cast("int")
        va, vb = val(acc["sw"], k), val(acc["sw"], j)
        sw = F.concat(acc["sw"], F.array(F.struct(k.alias("i"), vb.alias("v")), F.struct(j.alias("i"), va.alias("v"))))
        return F.struct(sw.alias("sw"), F.concat(acc["out"], F.array(vb)).alias("out"))

    res = F.aggregate(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), init, step)
    return F.when(m > 0, res["out"]).otherwise(F.array().cast("array<int>"))


def sample_from_pool(pool, n: int, seed, row_key) -> Column:
    """n distinct elements of a per-row pool (``sample_indices`` over its size)."""
    p = C(pool)
    return F.transform(sample_indices(F.size(p), n, seed, row_key), lambda x: F.element_at(p, x + 1))


def ordered_subset(col, target_len, seed, row_key) -> Column:
    """order-preserving random subset of ``target_len`` elements (smallest md5 keys, re-sorted by position)."""
    c = C(col)
    keyed = F.transform(c, lambda x, i: F.struct(rng.md5_key(seed, C(row_key), i).alias("k"), i.alias("i"),
                                                  x.alias("x")))
    chosen = F.slice(F.array_sort(keyed), 1, F.least(F.greatest(C(target_len), F.lit(0)), size0(c)).cast("int"))
    back = F.array_sort(F.transform(chosen, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back, lambda e: e["x"])


# ---- F19: chunks -----------------------------------------------------------------------------------------------
def chunk_list(col, k: int) -> Column:
    """consecutive chunks of k elements; the last may be short."""
    c = C(col)
    n_chunks = F.ceil(size0(c) / k).cast("int")
    return F.when(n_chunks > 0, F.transform(F.sequence(F.lit(0), n_chunks - 1),
                                            lambda i: F.slice(c, i * k + 1, k))).otherwise(F.array())


# ---- E12-E14: decay weights ------------------------------------------------------------------------------------
def linear_decay(col, ascending: bool = True) -> Column:
    """Weights i/n (i = 1..n) per list; NULL or empty list -> []."""
    n = size0(col)
    w = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i / n)
    w = w if ascending else F.reverse(w)
    return F.when(n > 0, w).otherwise(F.array().cast("array<double>"))


def exponential_decay(col, lam: float, ascending: bool = True) -> Column:
    """Weights lam^(n-i) (i = 1..n) per list; NULL or empty list -> []."""
    n = size0(col)
    w = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.pow(F.lit(lam), n - i))
    w = w if ascending else F.reverse(w)
    return F.when(n > 0, w).otherwise(F.array().cast("array<double>"))


def custom_decay(col, fn) -> Column:
    """Q-2: user-supplied decay ``fn(i, n) -> Column`` evaluated for i = 1..n per list; NULL/empty -> []."""
    n = size0(col)
    w = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: fn(i, n).cast("double"))
    return F.when(n > 0, w).otherwise(F.array().cast("array<double>"))


def weight_vectors(vectors, weights) -> Column:
    """Scale each inner vector by its weight; a NULL inner vector becomes [NULL]."""
    return F.zip_with(C(vectors), C(weights), lambda v, a: F.coalesce(
        F.transform(v, lambda x: x * a), F.array(F.lit(None).cast("double"))))


def mean_vector(vectors) -> Column:
    """Element-wise mean of a list of equal-length vectors (NULL inner vectors skipped)."""
    vs = F.filter(C(vectors), lambda v: v.isNotNull() & (F.size(v) > 0))
    d = F.size(F.element_at(vs, 1))
    m = F.size(vs)
    return F.when(m > 0, F.transform(F.sequence(F.lit(1), d), lambda j: F.aggregate(
        vs, F.lit(0.0), lambda acc, v: acc + F.coalesce(F.element_at(v, j).cast("double"), F.lit(0.0))) / m))


# ---- H14: vector arithmetic ----------------------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(C(a), C(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b); a zero vector has similarity 0 (distance 1), as scikit-learn's normalisation gives."""
    den = norm(a) * norm(b)
    return 1.0 - F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def sq_euclidean(a, b) -> Column:
    return F.aggregate(F.zip_with(C(a), C(b), lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0),
                       lambda s, v: s + v)


def unit(a, norm_col=None) -> Column:
    """a / |a|; the zero vector stays zero.  Pass ``norm_col`` (a column already holding |a|) so the norm is not
    recomputed for every element."""
    n = norm_col if norm_col is not None else norm(a)
    return F.transform(C(a), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


# ---- output helpers for oracle checks --------------------------------------------------------------------------
def fmt_list(col, kind: str = "int") -> Column:
    """Render a list as text so engines compare it exactly: ints/strings as is, doubles with 6 decimals."""
    c = C(col)
    if kind == "double":
        c = F.transform(c, lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0))
    elif kind != "str":
        c = F.transform(c, lambda x: x.cast("string"))
    return F.array_join(c, ",", "null")


def sql_fmt_list(expr: str, kind: str = "int") -> str:
    if kind == "double":
        inner = f"list_transform({expr}, lambda x: coalesce(printf('%.6f', round(x, 6) + 0.0), 'null'))"
    else:
        inner = f"list_transform({expr}, lambda x: coalesce(CAST(x AS VARCHAR), 'null'))"
    return f"array_to_string({inner}, ',')"
