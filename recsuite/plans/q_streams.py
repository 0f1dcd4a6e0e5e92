"""Queries for streaming operators (P1, P2) and iterative curation (O1, O2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.operators import curate as O
from recsuite.operators import history as H
from recsuite.operators import prep as P
from recsuite.plans.registry import query
from recsuite.sources import fixtures as fx
from recsuite.streaming import streams as ST


def _events_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return ST.event_stream(spark, sf, "events.parquet", schema)


@query("p1_windowed_ctr_stream", ("P1",), """
    WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS shown,
                      CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks
               FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, shown, clicks, round(clicks / shown, 6) AS ctr
    FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type IN ('view', 'click')) - INTERVAL 1 HOUR""")
def p1(spark, sf):
    """Daily CTR of view/click events from a file stream with a 1-hour watermark in append mode: only windows
    closed by the watermark are emitted."""
    out = ST.run_to_parquet(ST.windowed_ctr(_events_stream(spark, sf)), "p1_ctr")
    r = spark.read.parquet(out)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "shown", "clicks",
                    F.round("ctr", 6).alias("ctr"))


@query("p1_windowed_auc_stream", ("P1",), """
    WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, value, CAST(event_type = 'click' AS INTEGER) AS y FROM events
               WHERE event_type IN ('view', 'click')),
         r AS (SELECT w, y, rank() OVER (PARTITION BY w ORDER BY value) + (count(*) OVER (PARTITION BY w, value) - 1) / 2.0 AS rk FROM e),
         a AS (SELECT w, sum(y) AS p, count(*) AS n, sum(CASE WHEN y = 1 THEN rk END) AS s FROM r GROUP BY w)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(p AS BIGINT) AS clicks, n AS shown,
           round(CASE WHEN p > 0 AND n > p THEN (s - p * (p + 1) / 2.0) / (p * (n - p)) END, 6) AS auc
    FROM a WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type IN ('view', 'click')) - INTERVAL 1 HOUR""")
def p1_auc(spark, sf):
    """Daily AUC of the event value as a score for click against view, from streamed counts per window and score."""
    out = ST.run_to_parquet(ST.windowed_score_counts(_events_stream(spark, sf), "value"), "p1_auc")
    r = ST.windowed_auc(spark.read.parquet(out))
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "clicks", "shown",
                    F.round("auc", 6).alias("auc"))


@query("p1_windowed_auc_sketch_stream", ("P1",), """
    WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, value, floor(value / 4) AS b, CAST(event_type = 'click' AS INTEGER) AS y FROM events
               WHERE event_type IN ('view', 'click') AND value IS NOT NULL),
         k AS (SELECT w, b, sum(y) AS p, sum(1 - y) AS q, min(value) = max(value) AS one FROM e GROUP BY w, b),
         c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY w ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
         a AS (SELECT w, sum(p) AS p, sum(q) AS q, sum(p * (below + 0.5 * q)) AS s, sum(CASE WHEN one THEN 0 ELSE 0.5 * p * q END) AS o
               FROM c GROUP BY w)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(p AS BIGINT) AS clicks, CAST(p + q AS BIGINT) AS shown,
           round(CASE WHEN p > 0 AND q > 0 THEN s / (p * q) END, 6) AS auc, round(CASE WHEN p > 0 AND q > 0 THEN o / (p * q) END, 6) AS auc_error
    FROM a WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL) - INTERVAL 1 HOUR""")
def p1_sketch(spark, sf):
    """Daily AUC with its error bound from a sketch of score buckets (4 wide here) kept as streaming state."""
    out = ST.run_to_parquet(ST.windowed_auc_sketch(_events_stream(spark, sf), "value", bucket=lambda v: F.floor(v / 4)), "p1_sketch")
    r = spark.read.parquet(out)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "clicks", "shown",
                    F.round("auc", 6).alias("auc"), F.round("auc_error", 6).alias("auc_error"))


@query("p2_ordered_history_stream", ("P2", "E1"), f"""
    SELECT user_id, event_id, history FROM (
      SELECT user_id, event_id, ts, {L.sql_fmt_list('coalesce(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), [])')} AS history
      FROM events) WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def p2_ordered(spark, sf):
    """Last 3 events before each event per user; rows wait for the watermark (1 hour) and leave in time order."""
    out = ST.run_to_parquet(ST.ordered_last_n_history_stream(_events_stream(spark, sf), 3), "p2_ordered", ST.ROCKSDB)
    return spark.read.parquet(out).select("user_id", "event_id", L.fmt_list("history").alias("history"))


@query("p2_last_n_history_stream", ("P2",), f"""
    SELECT user_id, event_id, {L.sql_fmt_list('coalesce(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), [])')} AS history
    FROM events""")
def p2(spark, sf):
    """Last 3 events before each event per user, computed by a stateful streaming operator (state <= 3 ids per
    user); equals the batch window operator for in-order input."""
    out = ST.run_to_parquet(ST.last_n_history_stream(_events_stream(spark, sf), 3), "p2_hist")
    r = spark.read.parquet(out)
    return r.select("user_id", "event_id", L.fmt_list("history").alias("history"))


def _sessions(spark, sf):
    return H.sessions_from_pairs(P.binarize_ratings(fx.ratings(spark, sf)))


W = fx.with_views
_INCIDENCES_SQL = """s AS (SELECT * FROM ratings WHERE rating <> 3 AND user_id IN (SELECT user_id FROM ratings WHERE rating > 3)),
    e0 AS MATERIALIZED (SELECT user_id, CAST(rating < 3 AS INTEGER) AS c, item_id,
                          row_number() OVER (PARTITION BY user_id, rating < 3 ORDER BY ts, item_id) AS p FROM s),
    z0 AS (SELECT -1 AS size, {cap} AS cap)"""


def _peel_sql(rounds: int, keep: str, least: int, cap: int, shrink: float, final: int) -> str:
    """Rounds of {count items, keep those with ``keep``, cut lists, drop short rows} written out; more rounds than needed
    change nothing."""
    steps = [_INCIDENCES_SQL.format(cap=cap)]
    for i in range(rounds):
        steps.append(f"""n{i} AS MATERIALIZED (SELECT item_id FROM e{i} GROUP BY item_id HAVING {keep}),
    z{i + 1} AS MATERIALIZED (SELECT n AS size, CASE WHEN n = z{i}.size THEN greatest({final}, CAST(floor(cap * {shrink}) AS INTEGER)) ELSE cap END AS cap
      FROM z{i}, (SELECT count(*) AS n FROM n{i})),
    f{i} AS MATERIALIZED (SELECT f.* FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, c ORDER BY p) AS r FROM e{i} e
      WHERE item_id IN (SELECT item_id FROM n{i})) f, z{i + 1} z WHERE f.r <= z.cap),
    e{i + 1} AS MATERIALIZED (SELECT user_id, c, item_id, p FROM f{i} WHERE user_id IN (
      SELECT user_id FROM f{i} WHERE c = 0 GROUP BY user_id HAVING count(*) >= {least}))""")
    lists = ", ".join(f"coalesce({L.sql_fmt_list(f'list(item_id ORDER BY p) FILTER (WHERE c = {c})')}, '') AS {n}"
                      for c, n in enumerate(("history", "neg")))
    return W(f"WITH {', '.join(steps)} SELECT user_id, {lists} FROM e{rounds} GROUP BY user_id", "ratings")


@query("o1_shrinking_cap_cascade", ("O1",), _peel_sql(24, "count(*) BETWEEN 18 AND 40", 1, 30, 0.5, 8))
def o1_cascade(spark, sf):
    """The shrinking-cap fixed point with bounds that bite: items seen 18..40 times, cap 30 -> 15 -> 8."""
    out, _ = O.shrinking_cap_fixed_point(_sessions(spark, sf), min_count=18, max_count=40, start_cap=30, shrink=0.5, final_cap=8)
    return out.select("user_id", L.fmt_list("history").alias("history"), L.fmt_list("neg").alias("neg"))


@query("o2_core_cascade", ("O2",), _peel_sql(14, "count(*) >= 18", 8, 2**30, 1, 2**30))
def o2_cascade(spark, sf):
    """The core of the sessions: items seen >= 18 times, users with >= 8 history items, without random removals."""
    out, _ = O.core_fixed_point(_sessions(spark, sf), min_item_count=18, min_history=8)
    return out.select("user_id", L.fmt_list("history").alias("history"), L.fmt_list("neg").alias("neg"))


@query("o1_shrinking_cap_fixed_point", ("O1",), _peel_sql(8, "count(*) BETWEEN 5 AND 10000", 1, 30000, 0.2, 100))
def o1(spark, sf):
    """Item-frequency fixed point with a shrinking length cap over user sessions (positives + negatives):
    items seen 5..10000 times, cap 30000 -> x0.2 -> ... -> 100, users with empty history dropped."""
    out, _ = O.shrinking_cap_fixed_point(_sessions(spark, sf))
    return out.select("user_id", L.fmt_list("history").alias("history"), L.fmt_list("neg").alias("neg"))


@query("o2_core_fixed_point", ("O2", "F18"))
def o2(spark, sf):
    """k-core-like fixed point: items seen >= 5 times, users with >= 10 history items, repeated until stable;
    at the first stable point 50 random users are removed and the loop continues to the next fixed point."""
    out, _ = O.core_fixed_point(_sessions(spark, sf), remove_counts=[50])
    return out.select("user_id", L.fmt_list("history").alias("history"), L.fmt_list("neg").alias("neg"))
