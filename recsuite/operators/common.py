"""Shared scalable building blocks: salted top-N per group, ordered collection, dense indexes, first row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recsuite.session import cut_lineage

DEFAULT_SALT = 32


def as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def _order_exprs(order):
    return [o if isinstance(o, Column) else F.col(o) for o in as_list(order)]


def top_n_per_group(df: DataFrame, keys, order, n: int, salt_buckets: int = DEFAULT_SALT,
                    salt_on=None) -> DataFrame:
    """Rows ranked 1..n per group under ``order`` (a total order incl. a tiebreak).

    Two stages so that one hot group never lands in one task whole: stage 1 ranks inside (group, salt) with
    salt = hash(salt_on or all columns) % salt_buckets and keeps n rows per salted part; stage 2 ranks the at most
    n * salt_buckets survivors of each group.  The result equals the single-stage top n."""
    keys = as_list(keys)
    o = _order_exprs(order)
    salt_cols = [F.col(c) for c in as_list(salt_on)] if salt_on else [F.col(c) for c in df.columns]
    s = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*o)
    s = s.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*o)
    return s.withColumn("_rank", F.row_number().over(w2)).filter(F.col("_rank") <= n)


def ordered_collect(df: DataFrame, keys, order_cols, value_cols, name="_vals") -> DataFrame:
    """groupBy(keys) -> one sorted array of structs(order..., values...) per group (a row's list is its result)."""
    keys = as_list(keys)
    fields = [F.col(c).alias(f"o{i}") for i, c in enumerate(as_list(order_cols))] + \
             [F.col(c).alias(c) for c in as_list(value_cols)]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def explode_rows(df: DataFrame, keys, values: Column) -> DataFrame:
    """One row per element of the list ``values`` (one row for an empty or NULL list): the row's ``keys``, the element
    ``_v`` with its position ``_p``, and on the first element ``_row``: all other columns and ``_null`` (list is
    NULL).  ``collect_rows`` puts the rows together again, so a list edit needs no join back to its input."""
    keys = as_list(keys)
    rest = [F.col(c) for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*rest, values.isNull().alias("_null")).alias("_row"),
                     F.posexplode_outer(values).alias("_p", "_v")) \
        .withColumn("_row", F.when(F.coalesce("_p", F.lit(0)) == 0, F.col("_row")))


def collect_rows(exploded: DataFrame, keys, value: Column, out: str, keep: Column | None = None) -> DataFrame:
    """The rows of ``explode_rows`` with the list ``out`` of ``value`` by position (elements where ``keep`` holds;
    ``[]`` if none) and ``_null`` beside the other columns."""
    keys = as_list(keys)
    item = F.struct(F.coalesce("_p", F.lit(0)).alias("p"), value.alias("v"))
    g = exploded.groupBy(*keys).agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        F.array_sort(F.collect_list(item if keep is None else F.when(keep, item))).alias("_l"))  # one list
    rest = [f.name for f in exploded.schema["_row"].dataType.fields if f.name != out]
    return g.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], F.transform("_l", lambda e: e["v"]).alias(out))


def first_per_key(df: DataFrame, keys, order, cols) -> DataFrame:
    """First row per key under ``order`` as a ``min_by`` aggregate: partial aggregation runs map-side, so a hot
    key costs one small partial row per task instead of a whole-group sort."""
    keys = as_list(keys)
    cols = [c for c in as_list(cols) if c not in keys]
    packed = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*_order_exprs(order)))
    return df.groupBy(*keys).agg(packed.alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in cols])


def ordered_parts(df: DataFrame, order, partitions: int | None = None) -> DataFrame:
    """``df`` with ``_pid`` (range partition under ``order``), ``_local`` (0-based row number inside it, in order) and
    ``_g`` (0-based row number in the whole table).

    Range bounds are sampled, so two evaluations of the same range partitioning need not agree: the numbered parts are
    written once through the reliable checkpoint, and the part sizes (one row per partition) are read from what was
    written.  ``order`` has to be a total order for a repeatable numbering."""
    o = _order_exprs(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = cut_lineage(df.repartitionByRange(n, *o).sortWithinPartitions(*o)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return s.join(F.broadcast(offsets), "_pid").withColumn("_g", F.col("_off") + F.col("_local")).drop("_off")


def dense_index(df: DataFrame, order, name: str = "idx", start: int = 0, partitions: int | None = None) -> DataFrame:
    """Dense 0-based (or ``start``-based) running index under a total ``order`` without a single-partition window."""
    parts = ordered_parts(df, order, partitions)
    return parts.select(*df.columns, (F.col("_g") + start).cast("bigint").alias(name))


def row_number_per_group(df: DataFrame, group, order, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group under a total ``order``, without putting a whole group in
    one task: rows are numbered over the whole table in (group, order), less the number of the group's first row.
    That first row is looked up per (partition, group), so a hot group is spread over its partitions in the join, and
    NULL groups count as one group."""
    g = as_list(group)
    s = ordered_parts(df, [*[F.col(c) for c in g], *_order_exprs(order)], partitions)
    parts = s.groupBy("_pid", *g).agg(F.min("_g").alias("_min"))
    w = Window.partitionBy(*g)  # one row per partition that the group reaches
    parts = parts.withColumn("_first", F.min("_min").over(w)).drop("_min") \
        .select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_grp{i}") for i, c in enumerate(g)], "_first")
    same = F.col("_pid") == F.col("_p")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_grp{i}"))
    return s.join(parts, same) \
        .withColumn(name, (F.col("_g") - F.col("_first") + 1).cast("bigint")) \
        .drop("_pid", "_local", "_g", "_p", "_first", *[f"_grp{i}" for i in range(len(g))])
