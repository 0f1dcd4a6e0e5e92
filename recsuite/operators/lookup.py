"""Joins and lookups.

List columns never travel through joins whole when only their elements need a lookup: the list is exploded with
its position, the keys are joined (AQE picks broadcast for a small lookup table, sort-merge otherwise), and the
list is re-assembled once from ``(pos, value)`` structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsuite.operators.common import as_list, collect_rows, explode_rows, first_per_key


def attach_history(behaviors: DataFrame, history: DataFrame, user="user_id") -> DataFrame:
    """Behaviours left-joined with the per-user history table (skewed users: AQE skew join)."""
    return behaviors.join(history, user, "left")


def attach_embeddings(items: DataFrame, vectors: DataFrame, key="item_id", prefilter: bool = True) -> DataFrame:
    """Items left-joined with their vectors; optional semi-join reduction of the vector side first."""
    v = vectors.join(items.select(key), key, "left_semi") if prefilter else vectors
    return items.join(v, key, "left")


def map_list(df: DataFrame, list_col: str, lookup: DataFrame, key: str, value: str, row_key, out: str | None = None,
             mode: str = "keep", fill=None) -> DataFrame:
    """Map ids inside a list to values.  ``mode``: 'keep' (unknown -> NULL element), 'fill' (unknown ->
    ``fill``), 'drop' (unknown removed).  A NULL or empty list gives one element like the reference's explode:
    [NULL] in 'keep', [fill] in 'fill'; in 'drop' a list left without known ids is NULL."""
    out = out or list_col
    ex = explode_rows(df, row_key, F.col(list_col))
    lk = lookup.select(F.col(key).alias("_k"), F.col(value).alias("_val"))
    j = ex.join(lk, ex["_v"] == lk["_k"], "left")
    val = F.coalesce(F.col("_val"), F.lit(fill)) if mode == "fill" else F.col("_val")
    got = collect_rows(j, row_key, val, out, F.col("_val").isNotNull() if mode == "drop" else None)
    if mode == "drop":
        got = got.withColumn(out, F.when(F.size(out) > 0, F.col(out)))
    return got.drop("_null")


def map_list_small(list_col, mapping: dict, default=None):
    """C3 (small literal map): ``transform(list, x -> map[x])`` with a default for unknown ids."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(F.col(list_col), lambda x: F.coalesce(F.element_at(m, x), F.lit(default)))


def lookup_value(df: DataFrame, col: str, lookup: DataFrame, key: str, value: str, default=None,
                 out: str | None = None) -> DataFrame:
    """C4: scalar key -> value with a default."""
    lk = lookup.select(F.col(key).alias("_lk"), F.col(value).alias("_lv"))
    j = df.join(lk, df[col] == lk["_lk"], "left")
    return j.withColumn(out or value, F.coalesce(F.col("_lv"), F.lit(default))).drop("_lk", "_lv")


def _col_config(df: DataFrame, col: str) -> tuple:
    md = df.schema[col].metadata or {}
    return md.get("vocab"), md.get("max_length")


def union_by_key(base: DataFrame, others: list[tuple[DataFrame, str]], on: str) -> DataFrame:
    """Attach all columns of other tables keyed by ``on`` (their key column given per table).  A column present
    on both sides must have the same configuration (vocabulary and max length recorded in the column metadata,
    I18) or the union raises; with equal configurations the later table's values win.  The key column of each
    other table must use the same vocabulary as ``on`` when both record one."""
    out = base
    for t, tkey in others:
        if _col_config(out, on)[0] and _col_config(t, tkey)[0] and _col_config(out, on)[0] != _col_config(t, tkey)[0]:
            raise ValueError(f"the vocabularies of union column {on} and id column {tkey} do not match")
        t2 = t.withColumnRenamed(tkey, "_key_")
        clash = [c for c in t2.columns if c != "_key_" and c in out.columns]
        for c in clash:
            if _col_config(out, c) != _col_config(t2, c):
                raise ValueError(f"column {c} configuration conflict")
        out = out.drop(*clash).join(t2, out[on] == t2["_key_"], "left").drop("_key_")
    return out


def inject_columns(df: DataFrame, other: DataFrame, cols, key: str, other_key: str | None = None,
                   prefix: str = "") -> DataFrame:
    """Inject selected columns of another table by id (optionally renamed with a prefix)."""
    sel = [F.col(other_key or key).alias("_ik")] + [F.col(c).alias(prefix + c) for c in as_list(cols)]
    o = other.select(*sel)
    return df.join(o, df[key] == o["_ik"], "left").drop("_ik")


def with_descriptions(items: DataFrame, descriptions: DataFrame, key="item_id") -> DataFrame:
    """Items inner-joined with descriptions."""
    return items.join(descriptions, key, "inner")


def complete_attribute(ids: DataFrame, attr: DataFrame, key: str, col: str, fill="") -> DataFrame:
    """Every distinct id with its attribute, missing -> ``fill``."""
    return ids.select(key).distinct().join(attr.select(key, col), key, "left") \
        .withColumn(col, F.coalesce(F.col(col), F.lit(fill)))


def align_by_content(left: DataFrame, right: DataFrame, key: str, fields) -> DataFrame:
    """Align two catalogues by md5 of their text fields as a JSON array, so that fields keep their bounds (NULL counts
    as empty); among right duplicates the last id (max) wins."""
    h = lambda d: F.md5(F.to_json(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in as_list(fields)])))
    lh = left.select(F.col(key).alias("left_id"), h(left).alias("_h"))
    rh = right.select(F.col(key).alias("_rid"), h(right).alias("_h")).groupBy("_h").agg(F.max("_rid").alias("right_id"))
    return lh.join(rh, "_h").drop("_h")


def align_vectors(catalogue: DataFrame, vectors: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """A vector for every catalogue id; missing -> zero vector; column ``missing`` flags the fill."""
    j = catalogue.select(key).join(vectors.select(key, vec), key, "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return j.select(key, F.coalesce(F.col(vec), zero).alias(vec), F.col(vec).isNull().alias("missing"))


def first_match(df: DataFrame, key, order, cols) -> DataFrame:
    """C11: the first row per key under ``order`` (min_by aggregate: skew-safe partial aggregation)."""
    return first_per_key(df, key, order, cols)


def pending(work: DataFrame, done: DataFrame, key: str, content: str | None = None) -> DataFrame:
    """Work rows whose key is not in the done log (left anti join), minus empty contents (Q30)."""
    p = work.join(done.select(key).distinct(), key, "left_anti")
    if content:
        p = p.filter(F.col(content).isNotNull() & (F.col(content) != ""))
    return p


def label_by_membership(df: DataFrame, candidates: str, clicked: str, out_item="item_id", out_label="label") -> DataFrame:
    """One row per candidate with 1 if it is in the clicked list."""
    keep = [c for c in df.columns if c not in (candidates,)]
    e = df.select(*keep, F.explode(candidates).alias(out_item))
    return e.withColumn(out_label, F.coalesce(F.array_contains(clicked, F.col(out_item)), F.lit(False)).cast("int"))


def serve_examples(impressions: DataFrame, users: DataFrame, negatives: DataFrame, user="user_id") -> DataFrame:
    """Read-time star join impression -> user table -> negatives table (left joins)."""
    return impressions.join(users, user, "left").join(negatives, user, "left")


def point_lookup(table: DataFrame, vocab: DataFrame, external_id, id_col="idx", token_col="token") -> DataFrame:
    """C17: row of an encoded table by its external id, through the vocabulary."""
    v = vocab.filter(F.col(token_col) == F.lit(str(external_id))).select(F.col(id_col).alias("_i"))
    return table.join(v, table[id_col] == v["_i"]).drop("_i")


def attach_scores(lists: DataFrame, scores: DataFrame, key: str, pos="pos", score="score",
                  out="scores") -> DataFrame:
    """Flat (key, pos, score) rows back into an order-aligned list per key."""
    s = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, score))).alias("_s")) \
        .select(key, F.transform("_s", lambda e: e[score]).alias(out))
    return lists.join(s, key, "left")
