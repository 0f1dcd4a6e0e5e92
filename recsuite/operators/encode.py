"""Encode jobs over several tables that share growing vocabularies, and the example table made of them
(SURVEY I14, I17, J15).

A vocabulary only ever grows at its end: an id once given never moves, tokens of a later table or split are numbered behind
the largest id, and a range ``0..max`` can be reserved for columns that hold ids already.  A job names its tables in
order; every table first extends the open vocabularies it uses (one aggregation per vocabulary) and is then encoded.
All list columns of a table are encoded in one pass: exploded together, joined once, collected once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsuite.functions.lists import fit_length
from recsuite.operators.common import as_list, collect_rows, cut_lineage, dense_index, explode_rows
from recsuite.operators.vocab import build_vocab, encode_number, first_appearances, word_tokens

VOCAB = "vocab string, token string, idx bigint, cnt bigint"


def grow_vocab(old: DataFrame | None, df: DataFrame, cols, order, name: str, reserved=None) -> DataFrame:
    """``old`` with the tokens of ``cols`` that it lacks appended in the order of their first appearance; known
    tokens keep their ids, and occurrence counts add up.  Without ``old`` a new vocabulary (``reserved`` tokens first)."""
    if old is None:
        return cut_lineage(build_vocab(df, cols, order, name, reserved=reserved))
    first = cut_lineage(first_appearances(df, cols, order))
    known = old.join(first.select("token", F.col("cnt").alias("_more")), "token", "left") \
        .select("vocab", "token", "idx", (F.col("cnt") + F.coalesce("_more", F.lit(0))).alias("cnt"))
    start = old.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("s")).scalar()
    fresh = dense_index(first.join(old.select("token"), "token", "left_anti"), [F.col("_first"), F.col("token")], "_n")
    fresh = fresh.select(F.lit(name).alias("vocab"), "token", (F.col("_n") + start).alias("idx"), F.col("cnt").cast("bigint").alias("cnt"))
    return cut_lineage(known.unionByName(fresh))


def reserve_ids(old: DataFrame | None, df: DataFrame, cols, name: str) -> DataFrame:
    """The vocabulary ``0..max`` of columns (scalars or lists) that hold ids already; the tokens are the ids' decimal text.  An
    ``old`` one is extended behind its end if its ids fall short.  NULLs are skipped; a negative id is an error."""
    parts = None
    for c in as_list(cols):
        is_list = isinstance(df.schema[c].dataType, T.ArrayType)
        top, low = (F.array_max(c), F.array_min(c)) if is_list else (F.col(c), F.col(c))
        part = df.agg(F.max(top).cast("bigint").alias("hi"), F.min(low).cast("bigint").alias("lo"))
        parts = part if parts is None else parts.unionByName(part)
    r = parts.agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).first()
    if r.lo is not None and r.lo < 0:
        raise ValueError(f"{name}: {r.lo} is no id")
    start = 0 if old is None else old.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    top = -1 if r.hi is None else r.hi
    rows = df.sparkSession.range(start, max(start, top + 1)).select(
        F.lit(name).alias("vocab"), F.col("id").cast("string").alias("token"), F.col("id").alias("idx"), F.lit(0).cast("bigint").alias("cnt"))
    return rows if old is None else old.select("vocab", "token", "idx", "cnt").unionByName(rows)


@dataclass
class ListColumn:
    """How a list column is encoded: unknown elements are left out, or become ``oov``."""
    vocab: str
    oov: int | None = None


def encode_lists(df: DataFrame, columns: dict[str, ListColumn], vocabs: dict[str, DataFrame], key) -> DataFrame:
    """I7 / I8 for several list columns at once: a table is shuffled once, however many lists it has.  NULL lists
    become [].  ``key`` identifies a row."""
    names = list(columns)
    tag = lambda c, i, v: F.transform(
        F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")),
        lambda x: F.struct(F.lit(i).alias("c"), F.lit(v).alias("n"), x.alias("t")))
    ex = explode_rows(df, key, F.concat(*[tag(c, i, s.vocab) for i, (c, s) in enumerate(columns.items())]))
    known = None
    for v in {s.vocab for s in columns.values()}:
        part = vocabs[v].select(F.lit(v).alias("_n"), F.col("token").alias("_t"), F.col("idx").alias("_i"))
        known = part if known is None else known.unionByName(part)
    j = ex.join(known, (F.col("_v.n") == F.col("_n")) & (F.col("_v.t") == F.col("_t")), "left")
    oov = F.array(*[F.lit(s.oov).cast("bigint") for s in columns.values()])
    j = j.withColumn("_i", F.coalesce("_i", F.when(F.col("_p").isNotNull(), F.get(oov, F.col("_v.c")))))
    r = collect_rows(j, key, F.struct(F.col("_v.c").alias("c"), F.col("_i").alias("i")), "_enc", F.col("_i").isNotNull())
    own = lambda i: F.transform(F.filter("_enc", lambda e: e["c"] == i), lambda e: e["i"])
    return r.withColumns({c: own(i) for i, c in enumerate(names)}).drop("_enc", "_null")


@dataclass
class TableJob:
    """One table of a job.  ``spec``: {column: {"vocab": name, "kind": ..., ...}} with the kinds

    id / scalar   one token (``id`` for the table's id column, encoded last)
    list / split / words   lists of tokens, ids separated by ``sep``, text
    number   its own id below ``vocab_size``
    ids   a scalar or list of ids already; its vocabulary covers 0..max

    ``open``: whether unknown tokens extend the vocabulary (default) or are left out / become ``oov`` / raise
    (``policy`` drop, oov, error).  ``max_length``, ``keep``, ``pad``, ``pad_side`` fit a list; ``order`` gives the rows' order."""
    name: str
    table: DataFrame
    id_col: str
    spec: dict[str, dict]
    order: str | None = None
    index: str | None = field(default=None)  # add a running 0-based row number under ``order``


def _domain(c: str, size, is_list: bool) -> Column:
    col = F.col(c)
    high = F.array_max(col) if is_list else col
    low = F.array_min(col) if is_list else col
    bad = F.raise_error(F.lit(f"{c}: an id outside of its vocabulary"))
    return F.when((high >= size) | (low < 0), bad.cast("array<bigint>" if is_list else "bigint")) \
        .otherwise(col.cast("array<bigint>" if is_list else "bigint"))


def _encode(job: TableJob, vocabs: dict[str, DataFrame]) -> DataFrame:
    # the table is read by the check, by every vocabulary and by the encoding: it is written once, not worked out for each
    df, order = cut_lineage(job.table), job.order or job.id_col
    if df.groupBy(job.id_col).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{job.name}: id column {job.id_col} is not unique")
    kinds = {c: s.get("kind", "scalar") for c, s in job.spec.items()}
    if any(k == "id" and c != job.id_col for c, k in kinds.items()):
        raise ValueError(f"{job.name}: only {job.id_col} can be of kind id")
    for c, s in job.spec.items():
        if kinds[c] == "split":
            df = df.withColumn(c, F.split(F.col(c), s.get("sep", " ")))
        elif kinds[c] == "words":
            df = df.withColumn(c, word_tokens(c))
    shared: dict[str, list[str]] = {}
    for c, s in job.spec.items():
        if kinds[c] not in ("number", "ids") and s.get("open", True):
            shared.setdefault(s["vocab"], []).append(c)
        elif kinds[c] == "ids":
            vocabs[s["vocab"]] = reserve_ids(vocabs.get(s["vocab"]), df, [c], s["vocab"])
        elif kinds[c] != "number" and s["vocab"] not in vocabs:
            raise ValueError(f"{job.name}: there is no vocabulary {s['vocab']!r} yet")
    for v, cols in shared.items():
        vocabs[v] = grow_vocab(vocabs.get(v), df, cols, order, v, job.spec[cols[0]].get("reserved"))

    lists = {c: ListColumn(s["vocab"], s.get("oov") if s.get("policy", "drop") == "oov" else None)
             for c, s in job.spec.items() if kinds[c] in ("list", "split", "words")}
    for c, s in job.spec.items():
        if kinds[c] == "number":
            df = encode_number(df, c, s["vocab_size"])
        elif kinds[c] == "ids":
            size = vocabs[s["vocab"]].agg(F.coalesce(F.max("idx") + 1, F.lit(0))).scalar()
            df = df.withColumn(c, _domain(c, size, isinstance(df.schema[c].dataType, T.ArrayType)))
    if lists:
        df = encode_lists(df, lists, vocabs, job.id_col)
    for c in [*[c for c, k in kinds.items() if k == "scalar"], *[c for c, k in kinds.items() if k == "id"]]:
        df = _scalar(df, c, vocabs[job.spec[c]["vocab"]], job.spec[c])
    for c, s in job.spec.items():
        if s.get("max_length") and isinstance(df.schema[c].dataType, T.ArrayType):
            df = df.withColumn(c, fit_length(c, s["max_length"], keep=s.get("keep", "head"), pad=s.get("pad"),
                                             pad_side=s.get("pad_side", "back")))
    if job.index:
        df = dense_index(df.select(*[c for c in df.columns if c != job.index]), as_list(order), job.index)
    return df


def _scalar(df: DataFrame, col: str, vocab: DataFrame, spec: dict) -> DataFrame:
    v = vocab.select(F.col("token").alias("_tok"), F.col("idx").alias("_idx"))
    policy = "oov" if spec.get("open", True) else spec.get("policy", "oov")
    j = df.join(v, df[col].cast("string") == v["_tok"], "inner" if policy == "drop" else "left")
    value = F.col("_idx")
    if policy == "error":  # checked where the row is made, no extra job
        value = F.when(F.col(col).isNotNull() & value.isNull(),
                       F.raise_error(F.lit(f"{col}: unknown token for a closed vocabulary")).cast("bigint")).otherwise(value)
    elif spec.get("oov") is not None:
        value = F.coalesce(value, F.lit(spec["oov"]))
    return j.withColumn(col, value.cast("bigint")).drop("_tok", "_idx")


def encode_tables(jobs: Iterable[TableJob], vocabs: dict[str, DataFrame] | None = None
                  ) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Encode tables one after the other over shared vocabularies (``vocabs`` are the ones there are already); returns the
    encoded tables and all vocabularies as they stand at the end."""
    vocabs, out = dict(vocabs or {}), {}
    for job in jobs:
        if job.name in out:
            raise ValueError(f"two tables named {job.name}")
        out[job.name] = _encode(job, vocabs)
    return out, vocabs


def dataset_jobs(config: dict, tables: dict[str, DataFrame]) -> list[TableJob]:
    """The jobs of a dataset configuration for the tables that are given, in the configuration's order.  A configured table
    may come in splits (``interactions.train``, ``interactions.dev``, ...): each is a job of its own, in the order given."""
    jobs = []
    for role, c in config.items():
        for name, t in tables.items():
            if name == role or name.startswith(f"{role}."):
                jobs.append(TableJob(name, t, c["id"], c["columns"], c.get("order"), c.get("index")))
    missing = [n for n in tables if not any(j.name == n for j in jobs)]
    if missing:
        raise ValueError(f"no configuration for {', '.join(missing)}")
    return jobs


def _news(item_columns: dict, history: int, negatives: int | None = None) -> dict:
    ids = lambda v: {"vocab": v, "kind": "id"}
    past = {"vocab": "nid", "kind": "split", "sep": " ", "max_length": history, "keep": "tail"}
    neg = {"vocab": "nid", "kind": "split", "sep": " ", **({"max_length": negatives, "keep": "tail"} if negatives else {})}
    return {"item": {"id": "nid", "columns": {"nid": ids("nid"), **item_columns}},
            "user": {"id": "uid", "columns": {"uid": ids("uid"), "history": past}},
            "interactions": {"id": "row", "order": "row", "index": "index",
                             "columns": {"imp": {"vocab": "imp", "kind": "scalar"}, "uid": {"vocab": "uid", "kind": "scalar"},
                                         "nid": {"vocab": "nid", "kind": "scalar"}, "click": {"kind": "number", "vocab_size": 2}}},
            "negatives": {"id": "uid", "columns": {"uid": {**ids("uid"), "open": False, "policy": "drop"},
                                                   "neg": {**neg, "open": False}}}}


def _text(n: int) -> dict:
    return {"vocab": "english", "kind": "words", "max_length": n}


# Columns and lengths of the news datasets; the large one has a third interactions split and the same columns
_CATEGORIES = {"cat": {"vocab": "cat", "kind": "scalar"}, "subcat": {"vocab": "subcat", "kind": "scalar"}}
NEWS_SMALL = _news({**_CATEGORIES, "title": _text(20), "abs": _text(50)}, 30)
NEWS_LARGE = NEWS_SMALL
PENS = _news({"cat": {"vocab": "cat", "kind": "scalar"}, "topic": {"vocab": "topic", "kind": "scalar"},
              "title": _text(30), "body": _text(500)}, 50)


# ---- J15 -----------------------------------------------------------------------------------------------------------
def _field(name: str):
    return lambda e: e[name]


def gather(df: DataFrame, key, list_col: str, table: DataFrame, id_col: str, columns: dict[str, tuple[str, object]],
           length: int | None = None, keep: str = "tail", pad_side: str = "front") -> DataFrame:
    """Lists aligned with ``list_col``: {new column: (column of ``table``, value of an unknown id)}.  With ``length`` the list
    is first cut to its head or tail, and padded with the unknown value.  The values may be lists themselves (token rows), so the
    result is a list of lists; a NULL list counts as empty."""
    cut = F.coalesce(F.col(list_col), F.array().cast(df.schema[list_col].dataType))
    if length is not None:
        cut = fit_length(cut, length, keep=keep)
    ex = explode_rows(df, key, cut)
    values = F.struct(*[F.col(src).alias(f"g{i}") for i, (src, _) in enumerate(columns.values())])
    t = table.select(F.col(id_col).alias("_id"), values.alias("_g"))
    j = ex.join(t, F.col("_v") == F.col("_id"), "left")
    unknown = [F.lit(d) if not isinstance(d, (list, tuple)) else F.array(*[F.lit(x) for x in d]) for _, d in columns.values()]
    types = [f.dataType for f in t.schema["_g"].dataType.fields]
    filled = F.struct(*[F.coalesce(F.col(f"_g.g{i}"), u.cast(ty)).alias(f"g{i}") for i, (u, ty) in enumerate(zip(unknown, types))])
    r = collect_rows(j, key, filled, "_got", F.col("_p").isNotNull()).drop("_null")
    for i, (out, ty) in enumerate(zip(columns, types)):
        got = F.transform("_got", _field(f"g{i}"))
        if length is not None:
            filler = F.array_repeat(unknown[i].cast(ty), F.lit(length) - F.size("_got"))
            got = F.concat(filler, got) if pad_side == "front" else F.concat(got, filler)
        r = r.withColumn(out, got)
    return r.drop("_got")


def example_table(impressions: DataFrame, histories: DataFrame, items: DataFrame, key="impression_id", user="user_id",
                  inview="inview", history="history", item="item_id", index="idx", tokens="tokens", category="category_id",
                  history_size: int = 20, title_size: int | None = None) -> DataFrame:
    """One model-ready row per impression: the user's last ``history_size`` items and the candidates as item indexes
    (0 = unknown), token rows (zeros if unknown) and category ids (0 if unknown).  ``items``: (item, index from 1,
    tokens, category from 1).  Histories are gathered once per user, not once per impression; a user without a history has an
    all-unknown one."""
    title = title_size or items.agg(F.max(F.size(tokens))).first()[0] or 0
    t = items.select(F.col(item).alias("_item"), F.col(index).cast("bigint").alias("_x"), F.col(category).cast("bigint").alias("_c"),
                     fit_length(F.col(tokens).cast("array<bigint>"), title, keep="head", pad=0, pad_side="back").alias("_t"))
    blank = [0] * title
    side = lambda p: {f"{p}_idx": ("_x", 0), f"{p}_tokens": ("_t", blank), f"{p}_category": ("_c", 0)}
    past = gather(histories.select(user, history), user, history, t, "_item", side("history"), history_size).drop(history)
    now = gather(impressions, key, inview, t, "_item", side("candidate"))
    none = {"history_idx": F.array_repeat(F.lit(0).cast("bigint"), history_size),
            "history_tokens": F.array_repeat(F.array(*[F.lit(0).cast("bigint")] * title), history_size),
            "history_category": F.array_repeat(F.lit(0).cast("bigint"), history_size)}
    j = now.join(past, user, "left")
    return j.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
