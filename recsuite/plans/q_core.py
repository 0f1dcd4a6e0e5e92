"""Queries for the metric operators (K) over the scored candidate view."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsuite.operators import metrics as M
from recsuite.plans.registry import query
from recsuite.plans.sql_metrics import list_metrics_sql, macro_mean_sql
from recsuite.sources import fixtures as fx

KS = (5, 10)


def _metric_sql(select: str, by=None) -> str:
    ctes = list_metrics_sql("candidates", ["impression_id"] if not by else [*by, "impression_id"], KS)
    return fx.with_views(select, "candidates", extra=ctes)


@query("metrics_macro", ids=("K1", "K3", "K4", "K5", "K6", "K8", "K9", "K10", "K12", "K13", "K14", "K15"),
       sql=_metric_sql(macro_mean_sql(KS)))
def metrics_macro(spark, sf_dir):
    """Flagship: rank every in-view list once, compute all list metrics, macro-average into one row."""
    per_list = M.list_metrics(fx.candidates(spark, sf_dir), "impression_id", ks=KS)
    return M.macro_mean(per_list, ks=KS)


_PER_LIST_COLS = ["impression_id", "n", "n_pos"] + list(M.METRIC_COLUMNS) + [
    f"{c}_{k}" for k in KS for c in M.K_COLUMNS]


def _round_sql(cols):
    out = []
    for c in cols:
        if c in ("impression_id", "n", "n_pos") or c.startswith("hit_"):
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(f"round({c}, 6) AS {c}")
    return ", ".join(out)


@query("metrics_per_list", ids=("K1", "K3", "K4", "K5", "K6", "K8", "K9", "K10", "K12", "K13", "K14", "K15"),
       sql=_metric_sql(f"SELECT {_round_sql(_PER_LIST_COLS)} FROM per_list"))
def metrics_per_list(spark, sf_dir):
    """Every per-list metric, one row per impression (strongest oracle check: no averaging hides errors)."""
    pl = M.list_metrics(fx.candidates(spark, sf_dir), "impression_id", ks=KS)
    sel = []
    for c in _PER_LIST_COLS:
        if c in ("impression_id", "n", "n_pos") or c.startswith("hit_"):
            sel.append(F.col(c).cast("bigint").alias(c))
        else:
            sel.append(F.round(F.col(c), 6).alias(c))
    return pl.select(*sel)


def _pool_sql(names_cols: list[tuple[str, str]]) -> str:
    sel = ["count(*) AS n_lists"] + [f"round(avg(CAST({c} AS DOUBLE)), 6) AS {a}" for a, c in names_cols]
    return _metric_sql(f"SELECT {', '.join(sel)} FROM per_list")


_POOL = ["GAUC", "MRR", "NDCG@5", "NDCG@10", "HitRatio@5", "Recall@10", "LRAP", "F1", "LogLoss", "RMSE",
         "Accuracy", "AUC_STRICT", "NDCG_SK@5"]


def _pool_cols():
    out = []
    for m in _POOL:
        col, k = M.parse_metric(m)
        out.append((m.lower().replace("@", "_"), f"{col}_{k}" if k is not None else col))
    return out


@query("metric_pool_names", ids=("K16",), sql=_pool_sql(_pool_cols()))
def metric_pool_names(spark, sf_dir):
    """Metric pool driven by a list of metric-name strings, evaluated in one job."""
    return M.metric_pool(fx.candidates(spark, sf_dir), _POOL)


@query("metrics_by_segment", ids=("D23",), sql=fx.with_views(
    """SELECT segment, count(*) AS n_lists, round(avg(auc), 6) AS auc, round(avg(mrr), 6) AS mrr,
              round(avg(ndcg_5), 6) AS ndcg_5
       FROM per_list GROUP BY segment""",
    "candidates", extra={
        "seg": "SELECT *, CAST(user_id % 3 AS BIGINT) AS segment FROM candidates",
        **list_metrics_sql("seg", ["segment", "impression_id"], KS)}))
def metrics_by_segment(spark, sf_dir):
    """Metrics per user segment (segment = user_id % 3 as the segment flag column)."""
    c = fx.candidates(spark, sf_dir).withColumn("segment", (F.col("user_id") % 3).cast("bigint"))
    return M.metric_pool(c, ["AUC", "MRR", "NDCG@5"], by="segment").withColumnRenamed("ndcg_5", "ndcg_5")


@query("auc_global", ids=("K2",), sql=fx.with_views(
    """SELECT round(sum(p * (neg_below + 0.5 * q)) / (sum(p) * sum(q)), 6) AS auc
       FROM (SELECT score, p, q,
                    coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
             FROM (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM candidates GROUP BY score))""",
    "candidates"))
def auc_global(spark, sf_dir):
    """AUC over all rows at once, exact, via per-score counts and bucketed prefix sums."""
    return M.global_auc(fx.candidates(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("logloss_f1_global", ids=("K7", "K11", "K17"), sql=fx.with_views(
    """SELECT round(-avg(label * ln(least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
                      + (1 - label) * ln(1 - least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS logloss,
              round(CASE WHEN 2 * sum(label * CAST(score >= 0.5 AS INTEGER)) + sum((1 - label) * CAST(score >= 0.5 AS INTEGER))
                         + sum(label * (1 - CAST(score >= 0.5 AS INTEGER))) > 0
                    THEN 2 * sum(label * CAST(score >= 0.5 AS INTEGER)) /
                         (2 * sum(label * CAST(score >= 0.5 AS INTEGER)) + sum((1 - label) * CAST(score >= 0.5 AS INTEGER))
                          + sum(label * (1 - CAST(score >= 0.5 AS INTEGER)))) ELSE 0 END, 6) AS f1,
              round(avg(score), 6) AS mean_score
       FROM candidates""", "candidates"))
def logloss_f1_global(spark, sf_dir):
    """Global log loss, global F1@0.5 and the mean-score table (Meaner) in one aggregation."""
    c = fx.candidates(spark, sf_dir)
    return c.agg(F.round(M.global_logloss(c), 6).alias("logloss"), F.round(M.global_f1(), 6).alias("f1"),
                 F.round(F.avg("score"), 6).alias("mean_score"))


@query("k17_mean_table", ids=("K17",), sql=fx.with_views(
    """SELECT (SELECT round(avg(score), 6) FROM candidates) AS mean_score,
              (SELECT round(avg(m), 6) FROM (SELECT avg(score) AS m FROM candidates GROUP BY impression_id)) AS mean_of_batches""",
    "candidates"))
def k17_mean_table(spark, sf_dir):
    """Mean score over the log, and the mean of the impressions' means."""
    c = fx.candidates(spark, sf_dir)
    whole, batches = M.mean_table(c, "score"), M.mean_table(c, "score", "impression_id")
    return whole.select(F.round("score", 6).alias("mean_score"),
                        batches.select(F.round("score", 6)).scalar().alias("mean_of_batches"))
