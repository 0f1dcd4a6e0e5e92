"""Sources and sinks.

Readers take explicit schemas (no inference on large inputs); sinks are plain ``DataFrameWriter`` calls.  Scratch
output of tests goes under the session's ``spark.checkpoint.dir`` (a shared folder on a cluster).
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsuite.operators.common import as_list


def scan(spark: SparkSession, path: str, cols=None) -> DataFrame:
    """A1: Parquet scan with column selection (pruned at the reader)."""
    df = spark.read.parquet(path)
    return df.select(*as_list(cols)) if cols else df


def read_tsv(spark: SparkSession, path: str, names: list[str], usecols=None, header: bool = False,
             sep: str = "\t", encoding: str = "UTF-8", schema: T.StructType | None = None) -> DataFrame:
    """A2 / A3 / A4 / A5: delimited text with given column names (header line skipped and replaced when
    ``header``), an optional typed schema and column subset; ``encoding`` e.g. ISO-8859-1 for Latin-1 files."""
    sch = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (spark.read.schema(sch).option("sep", sep).option("header", header).option("encoding", encoding)
          .option("quote", "\u0000").csv(path))
    return df.select(*as_list(usecols)) if usecols else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, cols=None) -> DataFrame:
    """JSON-lines with an explicit schema and projection."""
    df = spark.read.schema(schema).json(path)
    return df.select(*as_list(cols)) if cols else df


def read_reply_log_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON-lines reply log; malformed lines are kept as ``_corrupt_record`` (PERMISSIVE)."""
    sch = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    sch = T.StructType(list(sch.fields) + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(sch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_reply_log_tsv(spark: SparkSession, path: str, key_prefix: str | None = None,
                       reject_suffix: str | None = None) -> DataFrame:
    """``id \\t text`` reply log with the acceptance rule of the caller: id starts with ``key_prefix``, text
    does not end with ``reject_suffix``."""
    t = spark.read.text(path)
    parts = F.split(F.col("value"), "\t", 2)
    df = t.select(parts.getItem(0).alias("id"), parts.getItem(1).alias("text")).filter(F.col("text").isNotNull())
    if key_prefix:
        df = df.filter(F.col("id").startswith(key_prefix))
    if reject_suffix:
        df = df.filter(~F.col("text").endswith(reject_suffix))
    return df


def parse_list_literal(col, element_type: str = "string"):
    """A Python list literal such as ``['a', "it's", None]`` -> array, without eval: elements are read with their
    own quotes and backslash escapes; anything that is not a bracketed list gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    element = r"""(?s)'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,'"\[\]]+"""
    found = F.regexp_extract_all(c, F.lit(element), F.lit(0))

    def value(x):
        quoted = x.rlike("^['\"]")
        inner = F.substr(x, F.lit(2), F.length(x) - 2)
        plain = F.regexp_replace(inner, r"(?s)\\(.)", "$1")
        return F.when(quoted, plain).when(x != "None", x).cast(element_type)
    return F.when(c.rlike(r"(?s)^\s*\[.*\]\s*$"), F.transform(found, value))


def write_tsv(df: DataFrame, path: str, header: bool = False, list_sep: str = " ", mode: str = "overwrite") -> None:
    """A10: tab-separated sink; list columns are written as ``list_sep``-joined text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), list_sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink, optionally partitioned (e.g. by ``phase``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*as_list(partition_by))
    w.parquet(path)


def submission_lines(df: DataFrame, key: str, ranks: str, out: str = "line") -> DataFrame:
    """``impression_id [r1,r2,...]`` per row."""
    return df.withColumn(out, F.concat(F.col(key).cast("string"), F.lit(" ["),
                                       F.array_join(F.transform(ranks, lambda x: x.cast("string")), ","), F.lit("]")))


def write_submission(df: DataFrame, key: str, ranks: str, path: str, compression: str | None = None) -> None:
    """Submission text sink (optionally compressed, e.g. 'gzip')."""
    w = submission_lines(df, key, ranks).select("line").write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def read_submission(spark: SparkSession, path: str, value_type: str = "double") -> DataFrame:
    """Submission lines back to ``(impression_id, values)``."""
    t = spark.read.text(path)
    sp = F.split(F.col("value"), " ", 2)
    return t.select(sp.getItem(0).cast("bigint").alias("impression_id"),
                    F.from_json(sp.getItem(1), f"array<{value_type}>").alias("values"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines artefact sink (``mode='append'`` appends accepted replies to a log)."""
    df.write.mode(mode).json(path)


def read_phase(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """One phase of a phase-partitioned dataset (the predicate prunes partitions)."""
    return spark.read.parquet(path).filter(F.col("phase") == phase)


def predicate_key(predicates, source: str = "") -> str:
    """Order-insensitive cache key of a set of predicate strings over one source."""
    return hashlib.md5(json.dumps([source, *sorted(set(as_list(predicates)))]).encode()).hexdigest()[:16]


def source_identity(df: DataFrame) -> str:
    """Version of the files a table is read from, and its canonical plan: a job adds up hashes of every file's path, size and
    modification time, so no file list comes to the driver and a file replaced in place is another version.  A table
    that is not a plain read of files has to be named by the caller."""
    try:
        files = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h"))
    except AnalysisException:
        raise ValueError("name the source of a table that is not read from files") from None
    d = files.distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return json.dumps([d.n, str(d.s), d.x, df._jdf.queryExecution().analyzed().canonicalized().toString()])


def cached_filter(df: DataFrame, predicates, cache_dir: str, source: str | None = None) -> DataFrame:
    """Filter by a set of SQL predicates, materialised once as Parquet under the key of source version and predicate set
    and read back on later calls (any predicate order hits the same entry).  An entry counts once its ``done`` mark is
    written, so one that a dying job left half-written is made anew."""
    spark = df.sparkSession
    path = os.path.join(cache_dir, predicate_key(predicates, source_identity(df) if source is None else source))
    try:
        if spark.read.text(f"{path}/done").first() is not None:
            return spark.read.parquet(f"{path}/data")  # any filesystem Spark can read: a hit costs a footer read
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    out = df
    for p in sorted(set(as_list(predicates))):
        out = out.filter(F.expr(p))
    out.write.mode("overwrite").parquet(f"{path}/data")
    spark.range(1).select(F.lit("done")).coalesce(1).write.mode("overwrite").text(f"{path}/done")
    return spark.read.parquet(f"{path}/data")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for a query's own output under the shared checkpoint folder."""
    from recsuite.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.replace("file:", ""), "recsuite-io", name)
