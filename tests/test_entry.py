"""t1 / t2: the driver contract — entry() on sf0.001 and a sample of queries against the DuckDB oracle."""

import os
import subprocess
import sys

import pytest

from paths import SF_SMOKE

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n_lists > 0
    assert {"auc", "mrr", "ndcg_5", "ndcg_10"} <= set(df.columns)


def test_every_query_has_callable_and_sql_keys_subset():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert len(q) >= 150 and set(s) <= set(q)


@pytest.mark.parametrize("pattern", ["^(metrics_macro|b9_|c3_|e1_|e2_|f12_|i1_|j3_|l1_|m3_|n4_|p2_|a14_)"])
def test_oracle_sample_sf0001(pattern):
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "oracle_check.py"), SF_SMOKE, pattern],
                         capture_output=True, text=True, timeout=1200, cwd=ROOT)
    lines = [ln for ln in out.stdout.splitlines() if ln.split(" ")[0] in ("ok", "MISMATCH", "FAIL-SPARK", "FAIL-DUCK", "rows-only")]
    assert lines, out.stdout[-2000:] + out.stderr[-2000:]
    bad = [ln for ln in lines if not ln.startswith(("ok", "rows-only"))]
    assert not bad, bad
