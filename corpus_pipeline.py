"""Corpus cleaning as five stages over `documents`, each written as Parquet and read again by the next.

language_id        drop documents without a letter, or whose best two languages compress the text equally well
near_duplicates    keep the smallest document of each near-duplicate component
suffix_dedup       cut every byte of a passage of 50 bytes or more that a document with a smaller id has too; characters
                   of which only a part is left go, too; documents of which nothing is left but white space are dropped
decontamination    drop documents that hold a benchmark item
bpe                token ids of the remaining texts, and their decoded form

A stage that changes the text sets ``n_chars`` to its length.  A document that is clean goes through all of them
unchanged.  Rows with a NULL id are kept by the stages that compare documents.

The stages send whole texts to Python workers; their session gets ``session.bound_batches``, so what a task holds of them
does not depend on how long the texts are or how many rows a file has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsuite.llm import bpe, decontam, langid, neardup, suffix
from recsuite.llm.entry import word_tokenizer
from recsuite.session import bound_batches, ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


def _plain(docs: DataFrame) -> DataFrame:
    """The same columns under names that clash with none of an operator's."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


def _quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


@_bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled training fold, drop what the classifier rejects."""
    model = langid.train(docs.filter(~langid.held_out(4, 2)))
    named = _plain(docs)
    found = langid.identify(named, model, named.columns).filter(~F.col("rejected"))
    return found.select(*named.columns).toDF(*docs.columns)


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id."""
    dropped = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*_quoted(docs))


@_bounded
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages; the text is what is left."""
    named = _plain(docs)
    left = suffix.remove_repeats(named.withColumn("no_text", F.col("text").isNull()),
                                 keep=[*[c for c in named.columns if c != "text"], "no_text"], result="kept string",
                                 make=lambda b: b.decode("utf-8", "ignore"))
    left = left.filter((F.size("spans") == 0) | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != ""))
    size = F.when(F.size("spans") == 0, F.col(named.columns[docs.columns.index("n_chars")])) \
        .otherwise(F.length("kept")).cast("long")
    return left.select(*[F.when(~F.col("no_text"), F.col("kept")).alias(c) if c == "text" else
                         size.alias(c) if c == "n_chars" else F.col(n).alias(c)
                         for c, n in zip(docs.columns, named.columns)])


@_bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark item."""
    hits = decontam.op8_decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*_quoted(docs))


@_bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the decoded text."""
    return bpe.encode_and_decode(docs, word_tokenizer(), ["doc_id", "lang", "source"])


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("suffix_dedup", suffix_dedup),
          ("decontamination", decontamination), ("bpe", tokens)]
ORACLE_SQL = None  # stages of trained models, sketches and suffixes are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's result is a Parquet table under the checkpoint folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}_{name}")
        docs = spark.read.parquet(f"{root}/{k}_{name}")
    return docs
