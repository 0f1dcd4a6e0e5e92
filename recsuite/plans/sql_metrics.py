"""DuckDB text of the list metrics, written from the metric definitions (independent of the Spark code path)."""

from __future__ import annotations


def _disc(lo: str, hi: str) -> str:
    return f"coalesce(list_sum(list_transform(range({lo}, ({hi}) + 1), lambda r: 1 / log2(r + 1))), 0.0)"


def list_metrics_sql(src: str, group: list[str], ks=(5, 10), threshold: float = 0.5) -> dict[str, str]:
    """CTEs ``ranked`` and ``per_list`` over the CTE/table ``src(group..., pos, label, score)``."""
    g = ", ".join(group)
    part = f"PARTITION BY {g} ORDER BY score DESC"
    ge = f"({part} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    eq = f"({part} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    ranked = f"""
        SELECT *, _ge - _eq + 1 AS _start, 2 * (_ge - _eq + 1) + _eq - 1 - _rn AS _rn4 FROM (
          SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY score DESC, pos DESC) AS _rn,
                 count(*) OVER {ge} AS _ge, count(*) OVER {eq} AS _eq,
                 sum(label) OVER {ge} AS _pos_ge, sum(1 - label) OVER {ge} AS _neg_ge,
                 sum(1 - label) OVER {eq} AS _neg_eq
          FROM {src})"""
    clip = "least(greatest(score, 10e-12), 1 - 10e-12)"
    pred = f"CAST(score >= {threshold} AS INTEGER)"
    raw = [
        "count(*) AS n", "CAST(sum(label) AS BIGINT) AS n_pos",
        "sum(CASE WHEN label = 1 THEN _neg_ge END) AS s_neg_ge",
        "sum(CASE WHEN label = 1 THEN _neg_eq END) AS s_neg_eq",
        "sum(label / _rn) AS s_rr",
        f"avg(label * ln({clip}) + (1 - label) * ln(1 - {clip})) AS ll",
        "avg(pow(label - score, 2)) AS mse",
        f"avg(CAST(label = {pred} AS DOUBLE)) AS accuracy",
        f"sum(label * {pred}) AS tp", f"sum((1 - label) * {pred}) AS fp", f"sum(label * (1 - {pred})) AS fn",
        "sum(CASE WHEN label = 1 THEN _pos_ge / _ge END) AS s_lrap",
    ]
    for k in ks:
        raw += [
            f"sum(CASE WHEN _rn <= {k} THEN (pow(2.0, label) - 1) / log2(_rn + 1) ELSE 0 END) AS dcg_{k}",
            f"sum(label * {_disc('_start', f'least(_start + _eq - 1, {k})')} / _eq) AS dcgsk_{k}",
            f"max(CASE WHEN _rn4 <= {k} AND label = 1 THEN 1 ELSE 0 END) AS hit_{k}",
            f"sum(CASE WHEN _rn4 <= {k} THEN label ELSE 0 END) AS hits_{k}",
        ]
    agg = f"SELECT {g}, {', '.join(raw)} FROM ranked GROUP BY {g}"
    both = "(n_pos > 0 AND n - n_pos > 0)"
    pn = "CAST(n_pos * (n - n_pos) AS DOUBLE)"
    out = [g, "n", "n_pos",
           f"CASE WHEN {both} THEN ({pn} - s_neg_ge + 0.5 * s_neg_eq) / {pn} END AS auc",
           f"CASE WHEN {both} THEN ({pn} - s_neg_ge) / {pn} END AS auc_strict",
           "CASE WHEN n_pos > 0 THEN s_rr / n_pos END AS mrr",
           f"CASE WHEN {both} THEN -ll END AS logloss",
           "sqrt(mse) AS rmse", "accuracy",
           "CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp) / (2 * tp + fp + fn) ELSE 0.0 END AS f1",
           "CASE WHEN n_pos = 0 OR n_pos = n THEN 1.0 ELSE s_lrap / n_pos END AS lrap"]
    for k in ks:
        idcg = _disc("1", f"least(n_pos, {k})")
        out += [f"CASE WHEN n_pos > 0 THEN dcg_{k} / {idcg} END AS ndcg_{k}",
                f"CASE WHEN n > 1 THEN (CASE WHEN n_pos > 0 THEN dcgsk_{k} / {idcg} ELSE 0.0 END) END AS ndcg_sk_{k}",
                f"hit_{k}",
                f"CASE WHEN n_pos > 0 THEN hits_{k} / n_pos END AS recall_{k}"]
    per_list = f"SELECT {', '.join(out)} FROM ({agg})"
    return {"ranked": ranked, "per_list": per_list}


METRIC_COLUMNS = ("auc", "auc_strict", "mrr", "logloss", "rmse", "accuracy", "f1", "lrap")
K_COLUMNS = ("ndcg", "ndcg_sk", "hit", "recall")


def macro_mean_sql(ks=(5, 10), by: list[str] | None = None) -> str:
    cols = list(METRIC_COLUMNS) + [f"{c}_{k}" for k in ks for c in K_COLUMNS]
    sel = ["count(*) AS n_lists", "CAST(count(*) FILTER (WHERE auc IS NULL) AS BIGINT) AS n_auc_undefined"]
    sel += [f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in cols]
    if by:
        return f"SELECT {', '.join(by)}, {', '.join(sel)} FROM per_list GROUP BY {', '.join(by)}"
    return f"SELECT {', '.join(sel)} FROM per_list"
