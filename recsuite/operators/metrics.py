"""Accuracy metrics over scored candidate lists.

Input is the flat scored table ``(group..., pos, label, score)``: one row per candidate.  ``rank_frame`` ranks
every list once — one hash partitioning on the list key and one sort ``(score desc, pos desc)`` — and every list
metric reads the same ranked rows; ties use RANGE frames over the score, so no metric needs its own sort.
``list_metrics`` then does one ``groupBy`` of raw sums and one projection.  Undefined values (one-class lists,
empty denominators) are NULL, not NaN, and are counted by ``macro_mean``.

Tie conventions (the reference has two metric pools):
* first pool (MRR, nDCG with 2^rel-1 gain): among equal scores the *later* position ranks first (score desc, pos desc);
* second pool (hit ratio, recall): stable descending sort, the *earlier* position first (score desc, pos asc).
  That rank is derived inside the tie group from the first one: ``rn4 = 2*start + size - 1 - rn3``.
Labels are 0/1 (what J1 produces); the ideal DCG uses the closed form for binary relevance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference: clip of the per-list log loss (written 10e-12 there) and the float64 machine
# epsilon its global log loss clips with (scikit-learn 1.4, eps='auto').
LOGLOSS_CLIP = 10e-12
LOGLOSS_EPS_GLOBAL = 2.220446049250313e-16


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def rank_frame(df: DataFrame, group="impression_id", label="label", score="score", pos="pos") -> DataFrame:
    """Add per-list rank columns: ``_rn`` (score desc, pos desc), ``_ge``/``_eq`` (rows scored >= / = this one),
    ``_pos_ge``/``_neg_ge``/``_neg_eq`` (positives / negatives among them), ``_rn4`` (score desc, pos asc)."""
    g = _as_list(group)
    w_row = Window.partitionBy(*g).orderBy(F.col(score).desc(), F.col(pos).desc())
    w_ge = w_row.orderBy(F.col(score).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w_eq = w_row.orderBy(F.col(score).desc()).rangeBetween(Window.currentRow, Window.currentRow)
    lab = F.col(label)
    r = df.select(
        "*",
        F.row_number().over(w_row).alias("_rn"),
        F.count(F.lit(1)).over(w_ge).alias("_ge"),
        F.count(F.lit(1)).over(w_eq).alias("_eq"),
        F.sum(lab).over(w_ge).alias("_pos_ge"),
        F.sum(1 - lab).over(w_ge).alias("_neg_ge"),
        F.sum(1 - lab).over(w_eq).alias("_neg_eq"),
    )
    start = F.col("_ge") - F.col("_eq") + 1
    return r.withColumn("_rn4", 2 * start + F.col("_eq") - 1 - F.col("_rn"))


def _cum_discounts(k: int) -> Column:
    """Literal array C with C[r+1] = sum_{i=1..r} 1/log2(i+1), r = 0..k (built from the rule, k+1 entries)."""
    vals, acc = [0.0], 0.0
    for r in range(1, k + 1):
        acc += 1.0 / math.log2(r + 1)
        vals.append(acc)
    return F.array(*[F.lit(v) for v in vals])


def _disc_sum(lo: Column, hi: Column, k: int) -> Column:
    """sum_{r=lo..hi} 1/log2(r+1) for 1 <= lo, hi <= k, as a difference of two lookups in a literal table (plain
    array indexing: stays in generated code, unlike a per-row higher-order aggregate); 0 for an empty range."""
    c = _cum_discounts(k)
    return F.when(hi >= lo, F.element_at(c, (hi + 1).cast("int")) - F.element_at(c, lo.cast("int"))).otherwise(F.lit(0.0))


def list_metrics(df: DataFrame, group="impression_id", label="label", score="score", pos="pos",
                 ks=(5, 10), threshold: float = 0.5) -> DataFrame:
    """One row per list with every per-list metric."""
    g = _as_list(group)
    r = rank_frame(df, g, label, score, pos)
    lab, sc = F.col(label), F.col(score)
    clip = F.least(F.greatest(sc, F.lit(LOGLOSS_CLIP)), F.lit(1.0 - LOGLOSS_CLIP))
    pred = (sc >= threshold).cast("int")
    start = F.col("_ge") - F.col("_eq") + 1
    raw = [
        F.count(F.lit(1)).alias("n"),
        F.sum(lab).cast("bigint").alias("n_pos"),
        F.sum(F.when(lab == 1, F.col("_neg_ge"))).alias("_s_neg_ge"),
        F.sum(F.when(lab == 1, F.col("_neg_eq"))).alias("_s_neg_eq"),
        F.sum(lab / F.col("_rn")).alias("_s_rr"),
        F.avg(lab * F.ln(clip) + (1 - lab) * F.ln(1 - clip)).alias("_ll"),
        F.avg(F.pow(lab - sc, 2)).alias("_mse"),
        F.avg((lab == pred).cast("double")).alias("accuracy"),
        F.sum(lab * pred).alias("_tp"), F.sum((1 - lab) * pred).alias("_fp"), F.sum(lab * (1 - pred)).alias("_fn"),
        F.sum(F.when(lab == 1, F.col("_pos_ge") / F.col("_ge"))).alias("_s_lrap"),
    ]
    for k in ks:
        raw += [
            F.sum(F.when(F.col("_rn") <= k, (F.pow(F.lit(2.0), lab) - 1) / F.log2(F.col("_rn") + 1))
                  .otherwise(0.0)).alias(f"_dcg_{k}"),
            F.sum(lab * _disc_sum(start, F.least(start + F.col("_eq") - 1, F.lit(k)), k) / F.col("_eq"))
            .alias(f"_dcgsk_{k}"),
            F.max(F.when((F.col("_rn4") <= k) & (lab == 1), 1).otherwise(0)).alias(f"hit_{k}"),
            F.sum(F.when(F.col("_rn4") <= k, lab).otherwise(0)).alias(f"_hits_{k}"),
        ]
    a = r.groupBy(*g).agg(*raw)
    n, P = F.col("n"), F.col("n_pos")
    N = n - P
    both = (P > 0) & (N > 0)
    pn = (P * N).cast("double")
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    out = [*g, "n", "n_pos",
           F.when(both, (pn - F.col("_s_neg_ge") + 0.5 * F.col("_s_neg_eq")) / pn).alias("auc"),
           F.when(both, (pn - F.col("_s_neg_ge")) / pn).alias("auc_strict"),
           F.when(P > 0, F.col("_s_rr") / P).alias("mrr"),
           F.when(both, -F.col("_ll")).alias("logloss"),
           F.sqrt("_mse").alias("rmse"),
           "accuracy",
           F.when(2 * tp + fp + fn > 0, (2 * tp) / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"),
           F.when((P == 0) | (P == n), F.lit(1.0)).otherwise(F.col("_s_lrap") / P).alias("lrap")]
    for k in ks:
        idcg = _disc_sum(F.lit(1), F.least(P, F.lit(k)), k)
        out += [F.when(P > 0, F.col(f"_dcg_{k}") / idcg).alias(f"ndcg_{k}"),
                F.when(n > 1, F.when(P > 0, F.col(f"_dcgsk_{k}") / idcg).otherwise(F.lit(0.0))).alias(f"ndcg_sk_{k}"),
                f"hit_{k}",
                F.when(P > 0, F.col(f"_hits_{k}") / P).alias(f"recall_{k}")]
    return a.select(*out)


METRIC_COLUMNS = ("auc", "auc_strict", "mrr", "logloss", "rmse", "accuracy", "f1", "lrap")
K_COLUMNS = ("ndcg", "ndcg_sk", "hit", "recall")


def macro_mean(per_list: DataFrame, by=(), ks=(5, 10), digits: int | None = 6) -> DataFrame:
    """Average every per-list metric (NULLs skipped) with list and undefined counts; optional grouping."""
    cols = list(METRIC_COLUMNS) + [f"{c}_{k}" for k in ks for c in K_COLUMNS]

    def rnd(c):
        return F.round(c, digits) if digits is not None else c

    aggs = [F.count(F.lit(1)).alias("n_lists"),
            F.count_if(F.col("auc").isNull()).cast("bigint").alias("n_auc_undefined")]
    aggs += [rnd(F.avg(F.col(c).cast("double"))).alias(c) for c in cols]
    g = _as_list(by)
    return per_list.groupBy(*g).agg(*aggs) if g else per_list.agg(*aggs)


# ---- metric pool (K16) -----------------------------------------------------------------------------------
_POOL = {
    # first pool names
    "AUC": "auc", "GAUC": "auc", "MRR": "mrr", "NDCG": "ndcg", "LOGLOSS": "logloss", "RMSE": "rmse",
    "ACCURACY": "accuracy", "F1": "f1",
    # second pool names
    "LRAP": "lrap", "HITRATIO": "hit", "RECALL": "recall", "NDCG_SK": "ndcg_sk", "AUC_STRICT": "auc_strict",
}


def parse_metric(name: str) -> tuple[str, int | None]:
    """``'NDCG@5'`` -> (``'ndcg'``, 5).  Unknown names raise, as in the reference."""
    base, _, arg = name.partition("@")
    key = base.strip().upper()
    if key not in _POOL:
        raise ValueError(f"unknown metric {name!r}")
    return _POOL[key], (int(arg) if arg and _POOL[key] in K_COLUMNS else None)


def metric_pool(df: DataFrame, metrics: list[str], group="impression_id", label="label", score="score",
                pos="pos", threshold: float = 0.5, by=(), digits: int | None = 6) -> DataFrame:
    """Evaluate a list of metric names (``'AUC'``, ``'NDCG@5'``, ``'HitRatio@10'``, ...) in one job: one ranking,
    one per-list aggregation, one final aggregation.  Output columns are ``name`` lower-cased with ``@`` -> ``_``."""
    parsed = [parse_metric(m) for m in metrics]
    ks = sorted({k for _, k in parsed if k is not None}) or [5]
    per_list = list_metrics(df, [*_as_list(by), *_as_list(group)], label, score, pos, ks, threshold)
    aggs = [F.count(F.lit(1)).alias("n_lists")]
    for m, (col, k) in zip(metrics, parsed):
        c = f"{col}_{k}" if k is not None else col
        v = F.avg(F.col(c).cast("double"))
        aggs.append((F.round(v, digits) if digits is not None else v).alias(m.lower().replace("@", "_")))
    g = _as_list(by)
    return per_list.groupBy(*g).agg(*aggs) if g else per_list.agg(*aggs)


# ---- global metrics (K2, K7, K11, K17) ----------------------------------------------------------------------
def global_logloss(df: DataFrame, label="label", score="score") -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(LOGLOSS_EPS_GLOBAL)), F.lit(1.0 - LOGLOSS_EPS_GLOBAL))
    return -F.avg(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p))


def global_f1(label="label", score="score", threshold: float = 0.5) -> Column:
    pred = (F.col(score) >= threshold).cast("int")
    tp, fp, fn = F.sum(F.col(label) * pred), F.sum((1 - F.col(label)) * pred), F.sum(F.col(label) * (1 - pred))
    return F.when(2 * tp + fp + fn > 0, (2 * tp) / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def score_bucket(score: Column, per_octave: int = 64) -> Column:
    """Order-preserving bucket of a score without looking at the data: negatives < 0 < positives, and inside each
    sign ``floor(per_octave * log2|s|)`` (log is semi-monotonic, so buckets never invert the order).  At most
    ~2 x 2100 x per_octave buckets exist for doubles, whatever the data size."""
    mag = F.floor(F.log2(F.abs(score)) * per_octave)
    return F.when(score > 0, F.lit(2_000_000) + mag).when(score < 0, F.lit(-2_000_000) - mag).otherwise(F.lit(0)) \
        .cast("long")


def global_auc(df: DataFrame, label="label", score="score", partitions: int | None = None) -> DataFrame:
    """Exact ROC AUC (ties 1/2) over all rows, without a window over the rows:

    1. ``groupBy(score)`` positive / negative counts (map-side partial aggregation);
    2. the distinct scores are dealt by range, highest first, so tasks are even however the scores lie;
    3. a task walks its scores in order with a running sum and gives one row: positives, negatives, and what its positives lose
       to negatives of its own range;
    4. negatives of the ranges above are carried in over these rows (one per partition).

    NULL scores rank lowest."""
    per = df.groupBy(score).agg(F.sum(F.col(label)).cast("bigint").alias("p"), F.sum(1 - F.col(label)).cast("bigint").alias("q"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = F.col(score).desc_nulls_last()
    parts = per.repartitionByRange(n, down).sortWithinPartitions(down).select("p", "q") \
        .mapInArrow(_range_losses, "part int, p bigint, q bigint, lost double")
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    x = parts.withColumn("above", F.coalesce(F.sum("q").over(above), F.lit(0)))
    P, N = F.sum("p"), F.sum("q")
    return x.agg(P.alias("P"), N.alias("N"), F.sum(F.col("lost") + F.col("p") * F.col("above").cast("double")).alias("s")) \
        .select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                       (F.col("P").cast("double") * F.col("N") - F.col("s")) / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


def _range_losses(batches):
    """(partition, positives, negatives, positives x negatives above them inside the partition, ties 1/2)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    P = N = 0
    lost = 0.0
    for b in batches:
        p, q = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        above = N + np.cumsum(q) - q
        lost += float((p * (above + 0.5 * q)).sum())
        P, N = P + int(p.sum()), N + int(q.sum())
    if P or N:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([P]), pa.array([N]),
                                          pa.array([lost])], names=["part", "p", "q", "lost"])


# ---- user-defined metric (Q-3) ------------------------------------------------------------------------------
def custom_list_metric(df: DataFrame, fn, name: str, group="impression_id", label="label", score="score",
                       pos="pos") -> DataFrame:
    """Q-3: a user metric ``fn(labels: np.ndarray, scores: np.ndarray) -> float`` per list.  Each list (bounded by
    itself) is collected in position order, then a scalar pandas UDF evaluates many lists per Arrow batch (no
    per-group Python round trip); NaN results become NULL."""
    import math

    import numpy as np
    import pandas as pd
    from pyspark.sql.functions import PandasUDFType

    def run(labels, scores):
        out = []
        for y, s in zip(labels, scores):
            v = float(fn(np.asarray(y), np.asarray(s)))
            out.append(None if math.isnan(v) else v)
        return pd.Series(out, dtype="float64")

    udf = F.pandas_udf(run, "double", PandasUDFType.SCALAR)
    g = _as_list(group)
    lists = df.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct(pos, label, score))).alias("_l"))
    return lists.select(*g, udf(F.transform("_l", lambda e: e[label]),
                                F.transform("_l", lambda e: e[score])).alias(name))


def mean_table(df: DataFrame, cols, batch: str | None = None) -> DataFrame:
    """Mean of every score column over a log; with ``batch``, the mean of the batches' means (a batch counts once
    however many rows it has, as when a mean is added per batch)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if batch is not None:
        df = df.groupBy(batch).agg(*[F.avg(c).alias(c) for c in cols])
    return df.agg(*[F.avg(c).alias(c) for c in cols])
