"""User histories and sequences.

Histories are built by partitioning on the user: a bounded sliding frame (E1), or a filtered, tail-cut,
ordered collection joined back (E2/E3).  When only the last N items are wanted they are cut by the salted
two-stage top-N first, so a very active user never sorts whole in one task.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsuite.functions.lists import C
from recsuite.operators.common import as_list, ordered_collect, row_number_per_group, top_n_per_group
from recsuite.session import cut_lineage


def _field(name):
    def get(e):
        return e[name]
    return get


def dynamic_history(df: DataFrame, n: int, user="user_id", item="item_id", time="ts", tiebreak=None,
                    out="history_dynamic") -> DataFrame:
    """For every row, the user's last n items strictly before it (rows ordered by time, tiebreak; the order
    must be total).  NULL items take a slot of the n-row frame and are then dropped.

    One plan for every shape of data, with one shuffle: rows are range-partitioned by (user, order), so a very active user
    spans many partitions, and written once (range bounds are sampled; two evaluations need not agree).  Tasks then
    walk their sorted rows over Arrow batches; what the first rows of a partition lack is what the same user's rows
    at the end of the partitions before it hold, at most n values per partition, joined to those rows alone."""
    order = [F.col(time)] + [c if not isinstance(c, str) else F.col(c) for c in as_list(tiebreak)]
    names = [c for c in df.columns if c != out]
    at_user, at_item = names.index(user), names.index(item)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = cut_lineage(df.repartitionByRange(parts, F.col(user), *order).sortWithinPartitions(F.col(user), *order)
                    .select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]))
    kind = {i: s.schema[i].dataType.simpleString() for i in (at_user, at_item)}
    ends = s.select(f"c{at_user}", f"c{at_item}").mapInArrow(
        partial(_partition_ends, n=n), f"part int, u {kind[at_user]}, slots array<{kind[at_item]}>")
    before = Window.partitionBy("u").orderBy("part").rowsBetween(-n, -1)  # a user's partitions, a few values each
    carry = ends.select("part", F.col("u").alias("_u"), F.flatten(F.collect_list("slots").over(before)).alias("_carry"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema)
    rows = s.mapInArrow(partial(_slide, n=n, at_user=at_user, at_item=at_item), f"{fields}, h array<{kind[at_item]}>, part int")
    rows = rows.join(F.broadcast(carry.withColumnRenamed("part", "_part")),
                     (F.col("part") == F.col("_part")) & F.col(f"c{at_user}").eqNullSafe(F.col("_u")), "left")
    need = F.lit(n) - F.size("h")
    got = F.slice("_carry", F.greatest(F.size("_carry") - need, F.lit(0)) + 1, need)
    whole = F.filter(F.concat(F.coalesce(got, F.array().cast(f"array<{kind[at_item]}>")), F.col("h")), lambda x: x.isNotNull())
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
                       F.when(F.col("part").isNull(), F.col("h")).otherwise(whole).alias(out))


def _codes(col) -> np.ndarray:
    """Equal numbers for equal values, NULL included."""
    return pc.dictionary_encode(col, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _partition_ends(batches, n: int):
    """Last n items of a partition's last user, and its first user with none if that is another one."""
    first = user = items = None
    for b in batches:
        if not b.num_rows:
            continue
        first = b.column(0).slice(0, 1) if first is None else first
        both = (lambda i, held: b.column(i) if held is None else pa.concat_arrays([held, b.column(i)]))
        user, items = both(0, user), both(1, items)
        code = _codes(user)
        own = len(code) - max(int(np.argmax(code[::-1] != code[-1])) or len(code), 1) if len(code) else 0
        own = max(own, len(code) - n)
        user, items = user.slice(own), items.slice(own)
    if first is None:
        return
    part = TaskContext.get().partitionId()
    last = user.slice(len(user) - 1, 1)
    users, slots = [last], [items.to_pylist()]
    if not first.equals(last):
        users, slots = [first, last], [[], items.to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(slots), pa.int32()), pa.concat_arrays(users),
                                      pa.array(slots, pa.list_(items.type))], names=["part", "u", "slots"])


def _slide(batches, n: int, at_user: int, at_item: int):
    """The rows with ``h``: the last n items before each row inside the partition, without NULLs.  Rows that may lack some from
    earlier partitions have NULLs still in and the partition number beside them."""
    part, seen, only = TaskContext.get().partitionId(), 0, True
    user = items = None
    for b in batches:
        if not b.num_rows:
            continue
        held = 0 if user is None else len(user)
        user = b.column(at_user) if user is None else pa.concat_arrays([user, b.column(at_user)])
        items = b.column(at_item) if items is None else pa.concat_arrays([items, b.column(at_item)])
        code, at = _codes(user), np.arange(len(user))
        change = np.append(True, code[1:] != code[:-1])
        start = np.maximum.accumulate(np.where(change, at, 0))
        low = np.maximum(at - n, start)[held:]
        count = at[held:] - low
        take = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(np.arange(b.num_rows), count)
        # rows of the partition's first user with fewer than n rows of it before them here
        head = (start[held:] == 0) & only & (seen + np.arange(b.num_rows) < n)
        values = items.take(pa.array(take))
        keep = values.is_valid().to_numpy(zero_copy_only=False) | head[row]
        offsets = np.append(0, np.cumsum(np.bincount(row[keep], minlength=b.num_rows)))
        h = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.filter(pa.array(keep)))
        yield pa.RecordBatch.from_arrays([*b.columns, h, pa.array(np.full(b.num_rows, part), pa.int32(), mask=~head)],
                                         names=[*b.schema.names, "h", "part"])
        seen, only = seen + b.num_rows, only and not change[1:].any()
        user, items = user.slice(max(0, len(user) - n - 1)), items.slice(max(0, len(items) - n - 1))


def fixed_history(df: DataFrame, cutoff, n: int | None = None, user="user_id", item="item_id", time="ts",
                  extra=(), suffix="_fixed", tiebreak=None, attach_to: DataFrame | None = None) -> DataFrame:
    """Per user the non-null items with ``time < cutoff`` in time order (optionally the last n),
    as parallel lists ``{item}{suffix}`` (+ ``{c}{suffix}`` for each extra column; NULLs in extra columns kept),
    attached to every row of ``attach_to`` (default: ``df``) by a left join; users without any get NULL."""
    tb = as_list(tiebreak) or [item]
    src = df.filter((F.col(time) < F.lit(cutoff)) & F.col(item).isNotNull())
    order_desc = [F.col(time).desc()] + [F.col(c).desc() for c in tb]
    if n is not None:
        src = top_n_per_group(src, [user], order_desc, n, salt_on=[item, time]).drop("_rank")
    coll = ordered_collect(src, [user], [time, *tb], [item, *extra], "_h")
    outs = [F.transform("_h", _field(c)).alias(f"{c}{suffix}") for c in [item, *extra]]
    hist = coll.select(user, *outs)
    target = df if attach_to is None else attach_to
    return target.join(hist, user, "left")


def sessions_from_pairs(df: DataFrame, user="user_id", item="item_id", time="ts", label="label") -> DataFrame:
    """Per user, positives in time order (``history``) and negatives (``neg``); users without positives are
    dropped.  Time sorts numerically (not as text, Q9) with the item as tiebreak; one session per user (Q10)."""
    coll = ordered_collect(df, [user], [time, item], [item, label], "_s")
    return coll.select(
        user,
        F.transform(F.filter("_s", lambda e: e[label] == 1), lambda e: e[item]).alias("history"),
        F.transform(F.filter("_s", lambda e: e[label] != 1), lambda e: e[item]).alias("neg"),
    ).filter(F.size("history") > 0)


def first_k_history(df: DataFrame, k: int, user="user_id", item="item_id", time="ts") -> tuple[DataFrame, DataFrame]:
    """The first k interactions of each user (time, item order) form the history; the rest stay as labelled
    interactions.  Returns (history per user, remaining rows).  Rows are numbered once per user and split on the
    number, so NULL columns and repeated rows fall on one side each."""
    order = [c for c in df.columns if c not in (user, time, item)]
    r = row_number_per_group(df, [user], [F.col(time), F.col(item), *order], "_rn")
    hist = ordered_collect(r.filter(F.col("_rn") <= k), [user], ["_rn"], [item], "_h") \
        .select(user, F.transform("_h", lambda e: e[item]).alias("history"))
    return hist, r.filter(F.col("_rn") > k).select(*df.columns)


def history_versions(df: DataFrame, user="user_id", history="history", order="impression_id",
                     out="uid_k") -> DataFrame:
    """``{user}_{k}`` for the k-th distinct history of a user in first-seen order (NULL-safe: one version for
    all NULL histories, Q24).  Histories are compared as arrays, element by element."""
    first_seen = df.groupBy(F.col(user).alias("_u"), C(history).alias("_hk")).agg(F.min(order).alias("_first"))
    ver = first_seen.withColumn("_k", F.dense_rank().over(Window.partitionBy("_u").orderBy("_first")) - 1)
    return df.join(ver, F.col(user).eqNullSafe(F.col("_u")) & C(history).eqNullSafe(F.col("_hk"))) \
        .withColumn(out, F.concat_ws("_", F.col(user).cast("string"), F.col("_k").cast("string"))) \
        .drop("_u", "_hk", "_k", "_first")


def position_in_group(df: DataFrame, group, order, out="position") -> DataFrame:
    """1-based position of each row inside its group (``order`` must be a total order); skew-safe numbering
    through range partitions and per-partition offsets instead of one window task per group."""
    return row_number_per_group(df, group, order, out)


# Fixed values of the reference: history cut lengths by cumulative probability (cut 5 is then drawn uniformly
# from 1..5; above 0.4 the cut is 9).
CUT_TABLE = ((0.1, 5), (0.2, 6), (0.3, 7), (0.4, 8))
CUT_ELSE = 9


def random_history_split(df: DataFrame, seed, user="user_id", hist="history") -> DataFrame:
    """Per user a seeded random history cut (by ``CUT_TABLE``); the items after the cut split in time order
    into train / dev / test with portion = len // 10 (dev and test get one portion each, train the rest); with
    portion 0, two or more items give train = all but the last two, dev = [second last], test = [last], fewer
    give train = dev = [] and test = the rest.  md5 draws make it partition-independent."""
    from recsuite.functions import rng
    u = rng.uniform(seed, F.col(user), F.lit("cut"))
    cut = None
    for p, c in CUT_TABLE:
        val = (F.pmod(rng.draw32(seed, F.col(user), F.lit("cut5")), F.lit(5)) + 1) if c == 5 else F.lit(c)
        cut = F.when(u <= p, val) if cut is None else cut.when(u <= p, val)
    cut = cut.otherwise(F.lit(CUT_ELSE)).cast("int")
    h = F.col(hist)
    n = F.size(h)
    d = df.withColumn("_cut", cut).withColumn("_rest", F.when(n > F.col("_cut"), F.slice(h, F.col("_cut") + 1, n))
                                                      .otherwise(F.array().cast(df.schema[hist].dataType)))
    r, m = F.col("_rest"), F.size("_rest")
    p = F.floor(m / 10).cast("int")
    empty = F.array().cast(df.schema[hist].dataType)
    train = F.when(p > 0, F.slice(r, 1, m - 2 * p)).when(m >= 2, F.slice(r, 1, m - 2)).otherwise(empty)
    dev = F.when(p > 0, F.slice(r, m - 2 * p + 1, p)).when(m >= 2, F.slice(r, m - 1, 1)).otherwise(empty)
    test = F.when(p > 0, F.slice(r, m - p + 1, p)).when(m >= 2, F.slice(r, m, 1)).otherwise(r)
    return d.select("*", F.slice(h, 1, F.col("_cut")).alias("history_cut"), train.alias("train"), dev.alias("dev"),
                    test.alias("test")).drop("_cut", "_rest")


def split_negatives(df: DataFrame, neg="neg", out_prefix="neg_") -> DataFrame:
    """A (shuffled) negative list split like the reference: portion = len // 10, train = all but the last two
    portions, dev = the second-last portion, test = the last portion (portion 0: test = all)."""
    r = F.col(neg)
    m = F.size(r)
    p = F.floor(m / 10).cast("int")
    empty = F.array().cast(df.schema[neg].dataType)
    return df.select("*", F.when(p > 0, F.slice(r, 1, m - 2 * p)).otherwise(empty).alias(f"{out_prefix}train"),
                     F.when(p > 0, F.slice(r, m - 2 * p + 1, p)).otherwise(empty).alias(f"{out_prefix}dev"),
                     F.when(p > 0, F.slice(r, m - p + 1, p)).otherwise(r).alias(f"{out_prefix}test"))
