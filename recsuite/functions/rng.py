"""Portable seeded randomness.

Every random choice is a pure function of ``(seed, row key, position)`` hashed with md5, so a result does not
depend on partitioning, executor count or retries, and the same draw can be written in plain SQL
(``md5(concat_ws('|', seed, key, pos))`` in Spark and DuckDB alike).  A numeric draw is the first 32 bits of the
digest: ``conv(substr(md5, 1, 8), 16, 10)`` in Spark, ``('0x' || substr(md5, 1, 8))::BIGINT`` in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _parts(seed, *parts) -> list[Column]:
    cols = [F.lit(str(seed))]
    for p in parts:
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return cols


def md5_key(seed, *parts) -> Column:
    """Hex md5 of ``seed|part1|part2...`` (parts are columns or literals)."""
    return F.md5(F.concat_ws("|", *_parts(seed, *parts)))


def draw32(seed, *parts) -> Column:
    """Uniform integer in [0, 2^32) from the md5 key."""
    return F.conv(F.substring(md5_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return draw32(seed, *parts) / F.lit(TWO_32)


def sql_md5_key(seed, *parts: str) -> str:
    """DuckDB / Spark SQL text of the same key (parts are SQL expressions)."""
    inner = ", ".join([f"'{seed}'", *parts])
    return f"md5(concat_ws('|', {inner}))"


def sql_draw32(seed, *parts: str) -> str:
    return f"('0x' || substr({sql_md5_key(seed, *parts)}, 1, 8))::BIGINT"
