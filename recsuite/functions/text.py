"""Scalar string / date / numeric helpers as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsuite.functions.lists import C


def concat_columns(cols, sep: str = " ") -> tuple[str, Column]:
    """H1: join columns with a separator, NULL if any part is NULL (``concat``, not ``concat_ws``); the output
    name is the column names joined by '-'."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(C(c).cast("string"))
    return "-".join(cols), F.concat(*parts)


def join_list(col, sep: str = " ") -> Column:
    """H2: strings of a list joined with a separator."""
    return F.array_join(C(col), sep)


def parse_impressions(col) -> Column:
    """``"N1-1 N2-0 N3"`` -> array of (item, label) with a missing ``-flag`` meaning 0."""
    return F.transform(F.split(C(col), " "), lambda x: F.struct(
        F.split_part(x, F.lit("-"), F.lit(1)).alias("item"),
        F.coalesce(F.nullif(F.split_part(x, F.lit("-"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0)).alias("label")))


def title_and_year(col) -> tuple[Column, Column]:
    """H4: ``"Name (1995)"`` -> (``"Name"``, ``"1995"``): text[:-7] and text[-5:-1]."""
    c = C(col)
    n = F.length(c)
    return F.substring(c, F.lit(1), n - 7), F.substring(c, n - 4, F.lit(4))


def prefix(col, text: str) -> Column:
    """H6: a fixed prefix (e.g. ``"Book named "``)."""
    return F.concat(F.lit(text), C(col))


def remove_word(col, word: str) -> Column:
    """H6: remove a word and trim."""
    return F.trim(F.regexp_replace(C(col), r"\s*\b" + word + r"\b", ""))


def concat_in_order(df: DataFrame, key, order: str, text: str, sep: str = " ", out: str = "text") -> DataFrame:
    """H6: texts of a group concatenated in order (e.g. captions per article)."""
    from recsuite.operators.common import as_list
    k = as_list(key)
    return df.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l")) \
        .select(*k, F.array_join(F.transform("_l", lambda e: e[text]), sep).alias(out))


def fake_to_user(col) -> Column:
    """H7: ``FAKE123@src`` -> ``U123``."""
    return F.split_part(F.regexp_replace(C(col), "FAKE", "U"), F.lit("@"), F.lit(1))


def parse_web_date(col, keep_wall_clock: bool = True) -> Column:
    """H9 / Q8: ``"Fri Dec 09 15:51:44 -0800 2016"`` -> epoch seconds.  The weekday is dropped (pattern letter E
    cannot parse in Spark 3+).  ``keep_wall_clock`` = reference behaviour: the offset is discarded and the wall
    clock read as UTC; False = the true instant."""
    rest = F.substr(C(col), F.lit(5))
    if keep_wall_clock:
        no_zone = F.concat_ws(" ", F.slice(F.split(rest, " "), 1, 3), F.element_at(F.split(rest, " "), 5))
        ts = F.try_to_timestamp(no_zone, F.lit("MMM dd HH:mm:ss yyyy"))
    else:
        ts = F.try_to_timestamp(rest, F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.unix_timestamp(ts)


def duration_text(seconds) -> Column:
    """``"{days} days {h}:{m}:{s}"`` without zero padding (timedelta days/hours/minutes/seconds)."""
    s = C(seconds).cast("bigint")
    d = F.floor(s / 86400)
    r = s - d * 86400
    return F.format_string("%d days %d:%d:%d", d, F.floor(r / 3600), F.floor((r % 3600) / 60), r % 60)


def clip(col, lo: float, hi: float) -> Column:
    """Clip into [lo, hi]."""
    return F.least(F.greatest(C(col), F.lit(lo)), F.lit(hi))


def threshold(col, t: float) -> Column:
    """1 if >= t else 0 (pure, no in-place mutation, Q7)."""
    return (C(col) >= t).cast("int")


def flatten_struct(df: DataFrame, sep: str = "-") -> DataFrame:
    """Flatten nested struct columns; a leaf is named child-...-parent (the reference's key order)."""
    cols = []

    def walk(path: list[str], dt):
        for f in dt.fields:
            p = path + [f.name]
            if isinstance(f.dataType, T.StructType):
                walk(p, f.dataType)
            else:
                cols.append(F.col("`" + "`.`".join(p) + "`").alias(sep.join(reversed(p))))

    walk([], df.schema)
    return df.select(*cols)


def parse_json(col, schema: str) -> Column:
    """JSON text -> struct (malformed -> NULL fields)."""
    return F.from_json(C(col), schema)


def to_json(*cols) -> Column:
    """Struct of columns -> JSON text."""
    return F.to_json(F.struct(*cols))
