"""Carrying columns through an Arrow function whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(df: DataFrame, keep: list[str], **own: str) -> tuple[DataFrame, str, list[Column]]:
    """(``keep`` columns as __k0, __k1, ... followed by the ``own`` columns under their new names, schema text of the
    first, columns that give them their names back)."""
    src = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)],
                    *[F.col(f"`{c}`").alias(name) for name, c in own.items()])
    fixed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name not in own)
    return src, fixed, [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
