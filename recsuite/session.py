"""Session construction and shared-storage helpers.

Library code never creates its own session; it receives one.  ``local_session`` is only for tests, the bench
and the oracle checker.  On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
filesystem named by the cluster); we only pick our own folder when that setting is absent, as in tests.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours carries.  ANSI stays on (PySpark 4 default); UTC so timestamps print the same
# in Spark and DuckDB; AQE for coalescing and skew joins; Arrow for the few pandas UDF paths.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast only below a fixed, checked size; everything larger takes a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


# Rows go to the Python workers in batches of at most so many bytes (one row at least).  Spark's own bound of 64 MB holds
# each batch several times over, in the executor's memory outside its heap and in the worker's.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "recsuite",
                  extra: dict | None = None) -> SparkSession:
    """A local[N] session for tests and benchmarks (never used by library code)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names.  Only a session in one machine's memory (``local``, as in
    tests) gets a scratch folder of its own when none is named; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="recsuite-ckpt-", dir=os.environ.get("RECSUITE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def bound_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` for the session's Arrow functions, unless the session names a bound of its own."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder: survives executor loss, truncates lineage of iterative jobs."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder of ours, on whatever filesystem it is; nothing may read its tables any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
