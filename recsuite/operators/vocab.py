"""Vocabularies and column encoding.

A vocabulary is a table ``(vocab, token string, idx long, cnt long)``.  Building one is a ``groupBy(token)``
(first appearance = the minimum ``(column, row order, position)`` key, partially aggregated map-side) followed by a
dense index in that order (range partitions + offsets, no single-partition window).  Encoding is a join of tokens
to the vocabulary: list columns are exploded with their position, joined, and re-collected by position.
"""

import json
import math
import os

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsuite.functions.lists import C
from recsuite.operators.common import as_list, collect_rows, dense_index, explode_rows

# Fixed value of the reference: the token a word-level encoding falls back to when no word is known.
EMPTY_TEXT_TOKEN = ","


def _tokens(df: DataFrame, col: str, order: str, col_no: int) -> DataFrame:
    dt = df.schema[col].dataType
    if isinstance(dt, T.ArrayType):
        return df.select(F.posexplode(col).alias("_p", "_t"), F.col(order).alias("_o")) \
            .select(F.col("_t").cast("string").alias("token"), F.lit(col_no).alias("_c"), "_o", "_p")
    return df.select(F.col(col).cast("string").alias("token"), F.lit(col_no).alias("_c"), F.col(order).alias("_o"),
                     F.lit(0).alias("_p"))


def first_appearances(df: DataFrame, cols, order: str) -> DataFrame:
    """(token, ``_first`` appearance as (column number, order, position), cnt) of the columns' non-NULL tokens."""
    u = None
    for i, c in enumerate(as_list(cols)):
        t = _tokens(df, c, order, i)
        u = t if u is None else u.unionByName(t)
    return u.filter(F.col("token").isNotNull()).groupBy("token").agg(
        F.min(F.struct("_c", "_o", "_p")).alias("_first"), F.count(F.lit(1)).alias("cnt"))


def build_vocab(df: DataFrame, cols, order: str, name: str = "vocab", reserved=None,
                min_count: int | None = None, max_count: int | None = None) -> DataFrame:
    """I1 (+ I2, I4, I5): vocabulary over one or more columns sharing it; index by first appearance
    (column order, then ``order``, then list position); NULL tokens skipped.  ``reserved`` (a list of tokens or
    a count of ``[UNUSED..]`` tokens) takes the first indexes; ``min_count`` / ``max_count`` trim by occurrence
    count, survivors keep their relative order and are re-indexed after the reserved tokens."""
    first = first_appearances(df, cols, order)
    if min_count is not None:
        first = first.filter(F.col("cnt") >= min_count)
    if max_count is not None:
        first = first.filter(F.col("cnt") <= max_count)
    res = reserved_tokens(reserved)
    idx = dense_index(first, [F.col("_first"), F.col("token")], "idx", start=len(res))
    out = idx.select(F.lit(name).alias("vocab"), "token", "idx", F.col("cnt").cast("bigint").alias("cnt"))
    if res:
        spark = df.sparkSession
        r = spark.createDataFrame([(name, t, i, 0) for i, t in enumerate(res)], "vocab string, token string, idx long, cnt long")
        out = r.unionByName(out)
    return out


def reserved_tokens(reserved) -> list[str]:
    """A list of reserved tokens, or n generated ones ``[UNUSED{i:0{d}}]`` with d = int(log10(n)) digits."""
    if reserved is None:
        return []
    if isinstance(reserved, int):
        digits = int(math.log10(reserved)) if reserved > 0 else 0
        return [("[UNUSED%0" + str(digits) + "d]") % i for i in range(reserved)]
    return [str(t) for t in reserved]


def trimmed_tokens(full: DataFrame, kept: DataFrame) -> DataFrame:
    """I4: the tokens a trim removed (anti join)."""
    return full.join(kept.select("token"), "token", "left_anti").select("token", "cnt")


def encode_scalar(df: DataFrame, col: str, vocab: DataFrame, out: str | None = None, policy: str = "oov",
                  oov: int | None = None) -> DataFrame:
    """Token -> index.  ``policy``: 'oov' (unknown -> ``oov``, NULL if not given), 'drop' (row removed),
    'error' (raises if any unknown)."""
    v = vocab.select(F.col("token").alias("_tok"), F.col("idx").alias("_idx"))
    j = df.join(v, df[col].cast("string") == v["_tok"], "left")
    if policy == "error":
        bad = j.filter(F.col("_idx").isNull() & F.col(col).isNotNull()).limit(1).count()
        if bad:
            raise ValueError(f"unknown token in {col} for a closed vocabulary")
    if policy == "drop":
        j = j.filter(F.col("_idx").isNotNull())
    val = F.col("_idx") if oov is None else F.coalesce(F.col("_idx"), F.lit(oov))
    return j.withColumn(out or col, val.cast("bigint")).drop("_tok", "_idx")


def encode_list(df: DataFrame, col: str, vocab: DataFrame, key, out: str | None = None, policy: str = "drop",
                oov: int | None = None, sep: str | None = None) -> DataFrame:
    """Encode a list column (or a ``sep``-separated string) element by element; unknown elements
    are dropped ('drop', the -1 filter of the reference) or mapped to ``oov``; NULL input -> [].  Explode with
    position, join the vocabulary, re-collect by position (the list never travels through the join whole)."""
    out = out or col
    src = F.split(F.col(col), sep) if sep is not None else F.col(col)
    ex = explode_rows(df, key, src)
    v = vocab.select(F.col("token").alias("_t"), F.col("idx").alias("_i"))
    j = ex.join(v, ex["_v"].cast("string") == v["_t"], "left")
    idx = F.coalesce("_i", F.when(F.col("_p").isNotNull(), F.lit(oov))) if policy == "oov" and oov is not None else F.col("_i")
    r = collect_rows(j.withColumn("_i", idx.cast("bigint")), key, F.col("_i"), "_enc", F.col("_i").isNotNull()).drop("_null")
    if out in df.columns:
        r = r.drop(out)
    return r.withColumnRenamed("_enc", out)


def encode_number(df: DataFrame, col: str, vocab_size: int, out: str | None = None) -> DataFrame:
    """A number column used as its own index, with a domain check (>= vocab_size raises at run time);
    NULL -> [] (list form, as the reference)."""
    c = F.col(col).cast("bigint")
    checked = F.when(c >= vocab_size, F.raise_error(F.lit(f"{col}: value out of vocabulary domain"))).otherwise(c)
    return df.withColumn(out or col, F.when(c.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(checked)))


WORD_PATTERN = r"\w+|[^\w\s]"


def word_tokens(col):
    """Lower-cased word / punctuation tokens (our rule; the reference's tokenizer is not available)."""
    return F.regexp_extract_all(F.lower(C(col)), F.lit(WORD_PATTERN), 0)


def encode_words(df: DataFrame, col: str, vocab: DataFrame, key, out: str | None = None,
                 max_length: int | None = None) -> DataFrame:
    """Word-level encode: lower-cased tokens, unknown words dropped, no known word -> the index of ','."""
    tmp = df.withColumn("_words", word_tokens(col))
    enc = encode_list(tmp, "_words", vocab, key, out="_enc", policy="drop").drop("_words")
    comma = vocab.filter(F.col("token") == EMPTY_TEXT_TOKEN).agg(F.min("idx")).scalar()
    val = F.when(F.size("_enc") > 0, F.col("_enc")).otherwise(F.array(comma))
    if max_length:
        val = F.slice(val, 1, max_length)
    return enc.withColumn(out or f"{col}_ids", val).drop("_enc")


def encode_with_tokenizer(df: DataFrame, col: str, name: str, max_length: int, tokenizer_factory=None,
                          pad: int = 0, out: str | None = None) -> DataFrame:
    """I12 / Q-4: subword encoding with a user-supplied tokenizer (``tokenizer_factory() -> callable(text) ->
    list[int]``), built once per Python worker and applied to Arrow batches (pandas UDF); special tokens are the
    tokenizer's business; output truncated to ``max_length`` and back-padded.  New column
    ``{col}_encode_{name}``.  Default tokenizer: the word rule hashed into 2^20 ids (md5 of the word), by built-in
    functions (``default_hash_tokenizer`` is the same as a user's tokenizer)."""
    if tokenizer_factory is None:
        words = F.coalesce(word_tokens(col), F.array().cast("array<string>"))
        ids = F.transform(F.slice(words, 1, max_length), lambda w: (
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % HASH_BUCKETS).cast("int"))
        return df.withColumn(out or f"{col}_encode_{name}", F.concat(ids, F.array_repeat(
            F.lit(pad), F.lit(max_length) - F.size(ids))))
    import pandas as pd

    factory = tokenizer_factory

    @F.pandas_udf("array<int>")
    def _enc(texts: pd.Series) -> pd.Series:
        tok = _worker_tokenizer(factory)
        res = []
        for t in texts:
            ids = [] if t is None else list(tok(t))[:max_length]
            res.append(ids + [pad] * (max_length - len(ids)))
        return pd.Series(res)

    return df.withColumn(out or f"{col}_encode_{name}", _enc(F.col(col)))


_TOKENIZERS: dict = {}


def _worker_tokenizer(factory):
    """One tokenizer per worker and factory; the key is the factory's pickled form, which holds its name or code and
    whatever it was configured with."""
    from pyspark import cloudpickle

    k = cloudpickle.dumps(factory)
    if k not in _TOKENIZERS:
        _TOKENIZERS[k] = factory()
    return _TOKENIZERS[k]


HASH_BUCKETS = 1 << 20


def default_hash_tokenizer():
    import hashlib
    import re

    pat = re.compile(r"\w+|[^\w\s]", re.ASCII)

    def tok(text: str):
        return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % HASH_BUCKETS for w in pat.findall(text.lower())]

    return tok


def lookup_matrix(vectors: DataFrame, key: str, vec: str, unknown: str = "zeros") -> tuple[DataFrame, DataFrame]:
    """Ids 1..n in key order and the matrix rows ``(idx, vector)`` with row 0 = unknown: zeros, or the
    element-wise column mean."""
    idx = dense_index(vectors.select(key, vec), [key], "idx", start=1)
    if unknown == "mean":
        v = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
        m = vectors.filter(F.col(vec).isNotNull()).agg(Summarizer.mean(v).alias("_m")) \
            .select(F.lit(0).cast("bigint").alias("idx"), vector_to_array("_m").cast("array<float>").alias(vec))
    else:
        d = vectors.select(F.size(vec).alias("_d")).agg(F.max("_d").alias("_d"))
        m = d.select(F.lit(0).cast("bigint").alias("idx"), F.array_repeat(F.lit(0.0).cast("float"), F.col("_d")).alias(vec))
    mapping = idx.select(key, "idx")
    matrix = m.unionByName(idx.select("idx", vec))
    return mapping, matrix


def with_schema_facts(df: DataFrame, col: str, vocab: str, vocab_size: int, max_length: int | None = None) -> DataFrame:
    """Record (vocabulary name, domain size, maximum length, is-list) in the column's metadata."""
    dt = df.schema[col].dataType
    meta = {"vocab": vocab, "vocab_size": vocab_size, "max_length": max_length, "is_list": isinstance(dt, T.ArrayType)}
    return df.withMetadata(col, meta)


def schema_facts(df: DataFrame) -> dict:
    """The recorded facts per column."""
    return {f.name: dict(f.metadata) for f in df.schema.fields if f.metadata}


def encode_table(df: DataFrame, spec: dict, id_col: str, order: str | None = None,
                 vocabs: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Declarative multi-column encoding.  ``spec``: ``{column: {"vocab": name, "kind":
    'scalar'|'list'|'split'|'words'|'number', "sep": ' ', "max_length": n, "keep": 'head'|'tail',
    "pad": value}}``.  Columns naming the same vocabulary share it; ``vocabs`` supplies existing vocabularies
    (the "fast" path: encode against them, no rebuild).  The id column must be unique (checked)."""
    from recsuite.functions.lists import fit_length
    dup = df.groupBy(id_col).count().filter("count > 1").limit(1).count()
    if dup:
        raise ValueError(f"id column {id_col} is not unique")
    order = order or id_col
    vocabs = dict(vocabs or {})
    by_vocab: dict[str, list[str]] = {}
    for c, s in spec.items():
        if s.get("kind") != "number":
            by_vocab.setdefault(s["vocab"], []).append(c)
    prepared = df
    for c, s in spec.items():
        if s.get("kind") == "split":
            prepared = prepared.withColumn(c, F.split(F.col(c), s.get("sep", " ")))
        elif s.get("kind") == "words":
            prepared = prepared.withColumn(c, word_tokens(c))
    for name, cols in by_vocab.items():
        if name not in vocabs:
            vocabs[name] = build_vocab(prepared, cols, order, name, reserved=spec[cols[0]].get("reserved"))
    out = prepared
    for c, s in spec.items():
        kind = s.get("kind", "scalar")
        if kind == "number":
            out = encode_number(out, c, s["vocab_size"])
            continue
        v = vocabs[s["vocab"]]
        if kind == "scalar":
            out = encode_scalar(out, c, v, policy=s.get("policy", "oov"), oov=s.get("oov"))
        else:
            out = encode_list(out, c, v, id_col, policy=s.get("policy", "drop"), oov=s.get("oov"))
            if s.get("max_length"):
                out = out.withColumn(c, fit_length(c, s["max_length"], keep=s.get("keep", "head"), pad=s.get("pad"),
                                                   pad_side=s.get("pad_side", "back")))
    return out, vocabs


# ---- A12 / A13: encoded-table store -------------------------------------------------------------------------
META_VERSION = "recsuite-1"


def save_encoded(df: DataFrame, vocabs: dict[str, DataFrame], path: str, id_col: str, spec: dict) -> None:
    """``data/`` (Parquet), ``vocab/`` (one table partitioned by vocabulary name) and ``meta.json``
    (version, id column, column -> vocabulary / max length / padding, vocabulary sizes)."""
    df.write.mode("overwrite").parquet(os.path.join(path, "data"))
    allv = None
    for v in vocabs.values():
        allv = v if allv is None else allv.unionByName(v)
    allv.write.mode("overwrite").partitionBy("vocab").parquet(os.path.join(path, "vocab"))
    sizes = {r["vocab"]: r["n"] for r in allv.groupBy("vocab").agg(F.count(F.lit(1)).alias("n")).collect()}
    meta = {"version": META_VERSION, "id_col": id_col,
            "cols": {c: {"vocab": s.get("vocab"), "max_length": s.get("max_length"), "padding": s.get("pad")}
                     for c, s in spec.items()},
            "vocabs": {k: {"size": v} for k, v in sizes.items()}}
    # written through Spark so the store works on any cluster filesystem (one small text file)
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "meta.json"))


def load_encoded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Read back data, vocabularies and metadata; older metadata keys (``col_info``/``cols``,
    ``vocab_info``/``vocs``/``vocabs``, ``voc``/``vocab``) are accepted."""
    raw = json.loads(spark.read.text(os.path.join(path, "meta.json")).first()["value"])
    cols = raw.get("cols") or raw.get("col_info") or {}
    cols = {c: {"vocab": s.get("vocab", s.get("voc")), "max_length": s.get("max_length"), "padding": s.get("padding")}
            for c, s in cols.items()}
    vocs = raw.get("vocabs") or raw.get("vocs") or raw.get("vocab_info") or {}
    meta = {"version": raw.get("version"), "id_col": raw.get("id_col"), "cols": cols, "vocabs": vocs}
    data = spark.read.parquet(os.path.join(path, "data"))
    vocab = spark.read.parquet(os.path.join(path, "vocab"))
    return data, vocab, meta


def set_column(table: DataFrame, id_col: str, values: DataFrame, name: str, vocab: str, vocab_size: int) -> DataFrame:
    """Add or replace a column from an ``(id, value)`` table; the value count must equal the table's row count
    (checked), and the column's vocabulary is recorded in its metadata."""
    n_rows, n_vals = table.count(), values.count()
    if n_rows != n_vals:
        raise ValueError(f"{n_vals} values for {n_rows} rows of column {name!r}")
    v = values.withColumnRenamed(values.columns[1], "_val").withColumnRenamed(values.columns[0], id_col)
    out = table.drop(name) if name in table.columns else table
    out = out.join(v, id_col, "left").withColumnRenamed("_val", name)
    return with_schema_facts(out, name, vocab, vocab_size)


def rename_vocab(vocab: DataFrame, old: str, new: str) -> DataFrame:
    """Rename vocabulary ``old`` to ``new`` inside a vocabulary table; when ``new`` already exists both must
    have the same size (checked) and they become one vocabulary (``new``'s rows kept)."""
    sizes = {r["vocab"]: r["n"] for r in vocab.filter(F.col("vocab").isin(old, new))
             .groupBy("vocab").agg(F.count(F.lit(1)).alias("n")).collect()}
    if old not in sizes:
        raise ValueError(f"there is no vocabulary {old!r} to merge")
    if new in sizes:
        if sizes[new] != sizes[old]:
            raise ValueError(f"vocabulary {new!r} is there already and has another number of tokens")
        return vocab.filter(F.col("vocab") != old)
    return vocab.withColumn("vocab", F.when(F.col("vocab") == old, F.lit(new)).otherwise(F.col("vocab")))


# ---- I17: dataset encode configurations (declarative; the same ``encode_table`` job runs each) ----------------
# Column roles and lengths per dataset as the blueprint lists them; kinds: scalar (entity / id), words (text),
# split (separator string of ids), list (id list).  ``keep='tail'`` keeps the most recent items of a history.
DATASET_SPECS = {
    "news_small": {
        "item": {"cat": {"vocab": "cat", "kind": "scalar"}, "subcat": {"vocab": "subcat", "kind": "scalar"},
                 "title": {"vocab": "english", "kind": "words", "max_length": 20},
                 "abs": {"vocab": "english", "kind": "words", "max_length": 50}},
        "user": {"history": {"vocab": "nid", "kind": "split", "sep": " ", "max_length": 30, "keep": "tail"}},
        "negatives": {"neg": {"vocab": "nid", "kind": "split", "sep": " "}},
    },
    "books": {
        "item": {"title": {"vocab": "english", "kind": "words", "max_length": 20}},
        "user": {"history": {"vocab": "bid", "kind": "list"}},
        "negatives": {"neg": {"vocab": "bid", "kind": "list"}},
    },
    "movies": {
        "item": {"name": {"vocab": "english", "kind": "words"}, "year": {"vocab": "english", "kind": "words"}},
        "user": {"history": {"vocab": "mid", "kind": "list", "max_length": 20, "keep": "tail"}},
    },
    "pens": {
        "item": {"cat": {"vocab": "cat", "kind": "scalar"}, "topic": {"vocab": "topic", "kind": "scalar"},
                 "title": {"vocab": "english", "kind": "words", "max_length": 30},
                 "body": {"vocab": "english", "kind": "words", "max_length": 500}},
        "user": {"history": {"vocab": "nid", "kind": "split", "sep": " ", "max_length": 50, "keep": "tail"}},
    },
    "danish_news_a": {
        "item": {"title": {"vocab": "english", "kind": "words", "max_length": 20},
                 "subtitle": {"vocab": "english", "kind": "words", "max_length": 60},
                 "body": {"vocab": "english", "kind": "words", "max_length": 100},
                 "category": {"vocab": "category", "kind": "scalar"}},
        "user": {"history": {"vocab": "nid", "kind": "list", "max_length": 50, "keep": "tail"}},
        "negatives": {"neg": {"vocab": "nid", "kind": "list", "max_length": 250, "keep": "tail"}},
    },
    "danish_news_b": {
        "item": {"title": {"vocab": "english", "kind": "words", "max_length": 20},
                 "subtitle": {"vocab": "english", "kind": "words", "max_length": 50},
                 "body": {"vocab": "english", "kind": "words", "max_length": 50}},
        "user": {"history": {"vocab": "nid", "kind": "list"}},
    },
}
