"""Prompt rendering and reply handling.  The model call itself is out of scope; these
build the work table and bring replies back.  All rendering is column expressions plus ordered collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsuite.functions.lists import C
from recsuite.operators.common import as_list


def _text(c, null_as: str) -> Column:
    return F.coalesce(C(c).cast("string"), F.lit(null_as))


def render_fields(fields: dict, null_as: str = "") -> Column:
    """``[key] value\\n`` lines for an ordered ``{key: column}`` map (NULL -> ``null_as``; the reference
    prints 'nan')."""
    parts = []
    for k, c in fields.items():
        parts += [F.lit(f"[{k}] "), _text(c, null_as), F.lit("\n")]
    return F.concat(*parts)


def render_inline(title, description=None, style: str = "tagged") -> Column:
    """``[book] {title}, description: {desc}\\n`` (tagged), ``title: ..\\ndescription: ..\\n`` (v2), or
    ``[book] {title}\\n`` without a description."""
    if description is None:
        return F.concat(F.lit("[book] "), _text(title, ""), F.lit("\n"))
    if style == "v2":
        return F.concat(F.lit("title: "), _text(title, ""), F.lit("\ndescription: "), _text(description, ""), F.lit("\n"))
    return F.concat(F.lit("[book] "), _text(title, ""), F.lit(", description: "), _text(description, ""), F.lit("\n"))


def first_words(col, n: int = 50) -> Column:
    """H5: the first n space-separated words."""
    return F.array_join(F.slice(F.split(C(col), " "), 1, n), " ")


def short_text(title, category=None, description=None, n_words: int = 50) -> Column:
    """An item's short text: title; ``(category) title``; or ``title, description: first-50-words``."""
    if category is not None:
        return F.concat(F.lit("("), _text(category, ""), F.lit(") "), _text(title, ""))
    if description is not None:
        return F.concat(_text(title, ""), F.lit(", description: "), first_words(description, n_words))
    return _text(title, "")


def numbered_lines(entries, numbers=None) -> Column:
    """``(i) text\\n`` lines from an array of texts; ``numbers`` (same length) overrides the 1-based numbering
    (used to keep gaps, Q14); NULL texts are skipped."""
    e = C(entries)
    z = F.arrays_zip(e.alias("t"), (C(numbers) if numbers is not None else F.sequence(F.lit(1), F.size(e))).alias("i"))
    kept = F.filter(z, lambda x: x["t"].isNotNull())
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("("), x["i"].cast("string"), F.lit(") "), x["t"],
                                                            F.lit("\n"))), "")


def render_history(history: DataFrame, texts: DataFrame, user: str, hist: str, item: str, text: str,
                   out: str = "prompt") -> DataFrame:
    """A user's history rendered as numbered lines of item texts (explode with position, join the text,
    ordered re-collection).  An empty history gives one row with a NULL prompt (Q15)."""
    ex = history.select(user, F.posexplode_outer(hist).alias("_p", item))
    j = ex.join(texts.select(item, F.col(text).alias("_t")), item, "left")
    g = j.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("_l"))
    lines = F.transform(F.filter("_l", lambda e: e["_p"].isNotNull()), lambda e: e["_t"])
    s = numbered_lines(lines)
    return g.select(user, F.when(s != "", s).alias(out))


def render_user_facts(facts: dict, reads: DataFrame, texts: DataFrame, user: str, item: str, text: str,
                      read_time: str, scroll: str, users: DataFrame, top: int = 100, descending: bool = False,
                      order=None, out: str = "prompt") -> DataFrame:
    """``[key] value`` facts (NULL facts skipped) then ``[articles]`` and the user's first ``top`` reads
    sorted by read time (ascending as the reference, Q13), numbered by sorted position; unknown articles keep
    their number and are skipped (gaps, Q14).  ``facts`` maps key -> column of ``users``; ``order`` (default:
    read time, item) is the sort, ``read_time`` / ``scroll`` the displayed values."""
    from recsuite.operators.common import top_n_per_group
    keys = [F.col(c) for c in (as_list(order) or [read_time, item])]
    if descending:
        keys = [keys[0].desc(), *keys[1:]]
    # first ``top`` reads per user by the salted two-stage top-n: a heavy reader is cut in parallel
    r = top_n_per_group(reads, [user], keys, top, salt_on=reads.columns).withColumnRenamed("_rank", "_n")
    j = r.join(texts.select(item, F.col(text).alias("_t")), item, "left")
    line = F.when(F.col("_t").isNotNull(), F.concat(
        F.lit("("), F.col("_n").cast("string"), F.lit(")title: "), F.col("_t"), F.lit(", read time: "),
        _text(read_time, "nan"), F.lit(", scroll percentage: "), _text(scroll, "nan"), F.lit("\n")))
    g = j.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("_line")))).alias("_l"))
    arts = g.select(user, F.array_join(F.transform("_l", lambda e: e["_line"]), "").alias("_arts"))
    fact_txt = F.concat(*[F.when(C(c).isNotNull(), F.concat(F.lit(f"[{k}] "), C(c).cast("string"), F.lit("\n")))
                          .otherwise(F.lit("")) for k, c in facts.items()]) if facts else F.lit("")
    base = users.select(user, fact_txt.alias("_facts"))
    return base.join(arts, user, "left").select(
        user, F.concat("_facts", F.lit("[articles]"), F.coalesce("_arts", F.lit(""))).alias(out))


def chain_prompt(interests: DataFrame, histories: DataFrame, user: str, interest: str, prompt: str,
                 out: str = "prompt") -> DataFrame:
    """The user's parsed interests followed by their rendered history, for users present in both."""
    return interests.join(histories, user).select(
        user, F.concat(F.lit("[interests]\n"), F.array_join(F.transform(interest, lambda x: F.concat(F.lit("- "), x)), "\n"),
                       F.lit("\n[history]\n"), F.col(prompt)).alias(out))


def parse_sections(col, section: str = "topics") -> Column:
    """The ``- item`` bullet lines under ``[section]`` in a reply, as an array (other sections ignored)."""
    body = F.regexp_extract(C(col), r"\[" + section + r"\]\n((?:- [^\n]*(?:\n|$))*)", 1)
    lines = F.split(body, "\n")
    return F.transform(F.filter(lines, lambda x: x.rlike("^- ")), lambda x: F.substr(x, F.lit(3)))


def parse_json_reply(col, schema: str) -> Column:
    """A JSON reply parsed to a struct; a malformed reply keeps its text in ``_corrupt_record`` (its other
    fields are NULL), so bad replies can be counted."""
    return F.from_json(C(col), schema + ", _corrupt_record string",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def parse_tagged(col, tag: str) -> Column:
    """The text after ``[tag] ``, over several lines up to the next line that starts with a tag (NULL when the
    tag is absent)."""
    v = F.regexp_extract(C(col), r"(?s)\[" + tag + r"\]\s*(.*?)\s*(?=\n\[[^\]\n]+\]|\z)", 1)
    return F.when(v != "", F.trim(v))


def validate_against(values, allowed: list[str]) -> Column:
    """Keep only allowed values (order kept)."""
    lit = F.array(*[F.lit(a) for a in allowed])
    return F.filter(C(values), lambda x: F.array_contains(lit, x))


def violation_rate(df: DataFrame, values: str, allowed: list[str]) -> DataFrame:
    """Share of parsed values that are not allowed."""
    lit = F.array(*[F.lit(a) for a in allowed])
    bad = F.size(F.filter(values, lambda x: ~F.array_contains(lit, x)))
    return df.agg(F.sum(F.size(values)).alias("n_values"), F.sum(bad).alias("n_violations")) \
        .withColumn("violation_rate", F.try_divide(F.col("n_violations").cast("double"), F.col("n_values")))


def append_replies(df: DataFrame, path: str, cols) -> None:
    """Append accepted replies to a JSON-lines log."""
    df.select(*as_list(cols)).write.mode("append").json(path)
