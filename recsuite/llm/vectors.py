"""Vector columns as numpy matrices, and scratch tables that are dropped when their work is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def lengths(col: pa.Array) -> np.ndarray:
    """Components of every vector, -1 for NULL."""
    return pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def finite_rows(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the vectors with exactly ``dims`` components, none NULL or non-finite."""
    at = np.flatnonzero(lengths(col) == dims)
    flat = pc.list_flatten(col.take(pa.array(at))).cast(pa.float64())
    matrix = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    ok = np.isfinite(matrix).all(axis=1)
    return at[ok], matrix[ok]


def to_integers(matrix: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as int64; an integer beyond ``limit`` is an error, as its results would not fit a long."""
    q = np.floor(matrix * scale)
    if q.size and np.abs(q).max() > limit:
        raise ValueError(f"a component times {scale} is beyond {limit}: distances or products would not fit 64 bits")
    return q.astype(np.int64)


def integer_groups(col: pa.Array, scale: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``finite_rows`` as integers for every vector length in the batch; empty vectors are left out."""
    for dims in np.unique(lengths(col)):
        if dims > 0:
            at, matrix = finite_rows(col, int(dims))
            if len(at):
                yield at, to_integers(matrix, scale, limit)


class Scratch:
    """A folder of Parquet tables below the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self) -> None:
        """Remove the folder; DataFrames over its tables must not be used any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
