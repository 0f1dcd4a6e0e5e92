"""Column/row preparation and set operations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsuite.functions.lists import C, size0
from recsuite.operators.common import as_list, collect_rows, dense_index, explode_rows, first_per_key


# ---- B: projections, filters -----------------------------------------------------------------------------------
def rename_lenient(df: DataFrame, mapping: dict) -> DataFrame:
    """B1: rename columns; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def rename_strict(df: DataFrame, mapping: dict, id_col: str | None = None) -> DataFrame:
    """B2: rename with errors on missing source, name clash, or touching the protected id column."""
    for k, v in mapping.items():
        if k not in df.columns:
            raise KeyError(f"no column {k!r} to rename")
        if v in df.columns and v != k:
            raise ValueError(f"the name {v!r} is taken by another column")
        if id_col is not None and k == id_col:
            raise ValueError(f"id column {id_col!r} cannot be renamed")
    return df.withColumnsRenamed(mapping)


def drop_strict(df: DataFrame, cols, id_col: str | None = None) -> DataFrame:
    """B2: drop columns; missing names and the id column raise."""
    for c in as_list(cols):
        if c not in df.columns:
            raise KeyError(f"no column {c!r} to drop")
        if c == id_col:
            raise ValueError(f"id column {id_col!r} cannot be dropped")
    return df.drop(*as_list(cols))


def keep_strict(df: DataFrame, cols, id_col: str | None = None) -> DataFrame:
    """B2: keep only ``cols`` (the id column is always kept)."""
    cols = as_list(cols)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    if id_col and id_col not in cols:
        cols = [id_col, *cols]
    return df.select(*cols)


def min_value(df: DataFrame, col: str, n) -> DataFrame:
    """Keep rows with ``col >= n`` (read-time cutoff)."""
    return df.filter(F.col(col) >= n)


def non_empty_text(df: DataFrame, col: str) -> DataFrame:
    """Keep rows with a non-empty string (NULL dropped)."""
    return df.filter(F.length(col) > 0)


def null_unless_in(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Set a scalar to NULL when it is not in the id set; rows are kept.  The id set is a DataFrame joined
    left (distinct first), so it may be any size."""
    k = ids.select(F.col(id_col).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return df.join(k, df[col] == k["_k"], "left") \
        .withColumn(col, F.when(F.col("_hit"), F.col(col))).drop("_k", "_hit")


def keep_list_elements_in(df: DataFrame, list_col: str, ids: DataFrame, id_col: str, row_key,
                          empty_as_null: bool = True) -> DataFrame:
    """B9 / B19 (any-size id set): keep list elements found in ``ids``; order and duplicates kept.  Explode with
    position, join to the ids, re-collect by position; the other columns travel with the first element.  Q19: an emptied list is NULL (``empty_as_null``)
    or ``[]``; a NULL list stays NULL."""
    k = ids.select(F.col(id_col).alias("_id")).distinct()
    ex = explode_rows(df, row_key, F.col(list_col))
    j = ex.join(k, ex["_v"] == k["_id"], "left")
    got = collect_rows(j, row_key, F.col("_v"), list_col, F.col("_id").isNotNull())
    none = F.col("_null") | (F.size(list_col) == 0) if empty_as_null else F.col("_null")
    return got.withColumn(list_col, F.when(~none, F.col(list_col))).drop("_null")


def filter_expr(df: DataFrame, predicates: dict | None = None, row: list[str] | None = None) -> DataFrame:
    """B12 / Q-5: configured predicates as SQL strings; ``{col: [expr, ...]}`` where ``x`` names the column and
    the bare string ``'x'`` means "non-empty" (list size > 0 / string length > 0); ``row`` are whole-row SQL
    predicates."""
    out = df
    for col, exprs in (predicates or {}).items():
        dt = df.schema[col].dataType.typeName()
        for e in as_list(exprs):
            if e.strip() == "x":
                cond = F.size(col) > 0 if dt == "array" else F.length(col) > 0
            else:
                cond = F.expr(re.sub(r"\bx\b", f"`{col}`", e))
            out = out.filter(cond)
    for e in as_list(row):
        out = out.filter(F.expr(e))
    return out


def allow_list(df: DataFrame, ids: DataFrame, col: str, id_col: str | None = None) -> DataFrame:
    """Keep rows whose key is in the id table (left semi join; AQE broadcasts a small side)."""
    return df.join(ids.select(F.col(id_col or col).alias(col)).distinct(), col, "left_semi")


def positives_only(df: DataFrame, label="label") -> DataFrame:
    """Keep label == 1 rows."""
    return df.filter(F.col(label) == 1)


def binarize_ratings(df: DataFrame, rating="rating", neutral: int = 3, out="label") -> DataFrame:
    """Drop the neutral rating; above it is positive."""
    return df.filter(F.col(rating) != neutral).withColumn(out, (F.col(rating) > neutral).cast("int"))


def users_with_both_classes(df: DataFrame, user="user_id", label="label") -> DataFrame:
    """Users having at least one positive and one negative row."""
    return df.groupBy(user).agg(F.max(label).alias("_mx"), F.min(label).alias("_mn")) \
        .filter((F.col("_mx") == 1) & (F.col("_mn") == 0)).select(user)


def known_flag(df: DataFrame, reference: DataFrame, col="user_id", out="is_known") -> DataFrame:
    """Flag rows whose key appears in the reference table (left join to its distinct keys)."""
    k = reference.select(col).distinct().withColumn(out, F.lit(True))
    return df.join(k, col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def generated_flag(df: DataFrame, generated_items: DataFrame, user="user_id", item="item_id",
                   out="has_generated") -> DataFrame:
    """Per user, whether any of their items is a generated one."""
    g = generated_items.select(F.col(item).alias("_g")).distinct()
    per_user = df.join(g, df[item] == g["_g"], "left").groupBy(user) \
        .agg(F.max(F.col("_g").isNotNull()).alias(out))
    return per_user


def admissible_items(items: DataFrame, title="title") -> DataFrame:
    """Catalogue items with a non-blank title."""
    return items.filter(F.trim(F.col(title)) != "")


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the flag set and the rest (a NULL flag counts as unset)."""
    cond = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(cond), df.filter(~cond)


def fill_constants(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULLs by constants (``{col: value}``), or by another column when the value is a Column."""
    out = df
    for c, v in values.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v if isinstance(v, type(F.col("x"))) else F.lit(v)))
    return out


def fold_categories(col, listed, bucket: str):
    """Listed categories fold into one bucket."""
    return F.when(C(col).isin(list(listed)), F.lit(bucket)).otherwise(C(col))


def decode_codes(col, mapping: dict, unknown: str | None = None):
    """Integer code -> text through a literal map; a code outside it gives ``unknown``, a NULL code NULL."""
    if not mapping:
        return F.when(C(col).isNotNull(), F.lit(unknown))
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.when(C(col).isNotNull(), F.coalesce(F.element_at(m, C(col).cast("int")), F.lit(unknown)))


def cold_users(df: DataFrame, history="history", k: int = 5) -> DataFrame:
    """Users whose history has 1..k items."""
    return df.filter(F.size(history).between(1, k))


def rows_at_min_length(df: DataFrame, col: str) -> DataFrame:
    """Rows whose list length equals the minimum (a scalar subquery, no join)."""
    return df.filter(F.size(col) == df.agg(F.min(F.size(col))).scalar())


def check_columns(df: DataFrame, cols) -> DataFrame:
    """Raise naming the missing columns (plan-time check, no job)."""
    missing = [c for c in as_list(cols) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def check_equal_lengths(df: DataFrame, a: str, b: str) -> DataFrame:
    """Raise when any row's two lists differ in length (one aggregate job)."""
    bad = df.agg(F.count_if(size0(a) != size0(b)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} rows where len({a}) != len({b})")
    return df


# ---- G: set operations, append, de-duplication, re-keying -----------------------------------------------------
def distinct_ids(df: DataFrame, scalar: str | None, lists=(), out="id") -> DataFrame:
    """G1: all distinct non-null ids over a scalar column and list columns."""
    parts = []
    if scalar:
        parts.append(df.select(F.col(scalar).alias(out)))
    for lc in lists:
        parts.append(df.select(F.explode(lc).alias(out)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.filter(F.col(out).isNotNull()).distinct()


def concat_keep_first(parts: list[DataFrame], key, order_col: str) -> DataFrame:
    """Concatenate splits and keep the *first* row per key (split number, then the in-split order)."""
    tagged = None
    for i, p in enumerate(parts):
        t = p.withColumn("_split", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    return first_per_key(tagged, key, ["_split", order_col], [c for c in tagged.columns if c != "_split"])


def diagonal_concat(parts: dict[str, DataFrame], source_col="source") -> DataFrame:
    """Union by name with missing columns NULL, tagged with the source name."""
    out = None
    for name, p in parts.items():
        t = p.withColumn(source_col, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def set_difference(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Rows of a not in b (``exceptAll`` keeps multiplicities)."""
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both."""
    return a.intersect(b)


def append_with_offset(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Append ``second`` with its key shifted by max(first.key) (a scalar subquery)."""
    shifted = second.withColumn(key, F.col(key) + first.agg(F.max(key)).scalar())
    return first.unionByName(shifted)


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows to a table by column name."""
    return table.unionByName(rows)


def reset_index(df: DataFrame, old_id: str, new_id: str = "index") -> DataFrame:
    """Dense 0..n-1 ids in the order of the old id (scalable: range partitions + offsets)."""
    return dense_index(df, [old_id], new_id)


def running_user_ids(splits: dict[str, DataFrame], user="user_id", tag="tag", out="uid") -> DataFrame:
    """The users of several splits in one table: ``tag`` is the 0-based number of the split, and a new running id
    replaces the user id, which may repeat across splits (dense over (split, user))."""
    every = None
    for i, df in enumerate(splits.values()):
        part = df.withColumn(tag, F.lit(i))
        every = part if every is None else every.unionByName(part)
    return dense_index(every, [tag, user], out)


def prefixed_user_ids(df: DataFrame, user="user_id", tag: str = "train", out="uid") -> DataFrame:
    """A per-split user id ``{tag}_{user}``."""
    return df.withColumn(out, F.concat_ws("_", F.lit(tag), F.col(user).cast("string")))


def merge_generated_items(items: DataFrame, generated: DataFrame, history: DataFrame, id_col="item_id",
                          owner="user_id", hist_col="history", subcategory="subcategory") -> tuple[DataFrame, DataFrame]:
    """Append generated items with new ids after max(id) (sub-category 'others'), and append each new id to
    its owner's history (ordered by the generated row's order column ``gen_order``)."""
    mx = items.agg(F.max(id_col)).scalar()
    g = dense_index(generated, ["gen_order"], "_i") \
        .withColumn(id_col, mx + 1 + F.col("_i")).withColumn(subcategory, F.lit("others"))
    new_items = items.unionByName(g.select(*items.columns), allowMissingColumns=True)
    add = g.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("gen_order", id_col))).alias("_a")) \
        .select(owner, F.transform("_a", lambda e: e[id_col]).alias("_new"))
    h = history.join(add, owner, "left").withColumn(
        hist_col, F.concat(F.coalesce(F.col(hist_col), F.array().cast("array<bigint>")),
                           F.coalesce(F.col("_new"), F.array().cast("array<bigint>")))).drop("_new")
    return new_items, h
