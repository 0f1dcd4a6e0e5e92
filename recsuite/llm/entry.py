"""Queries of this subpackage: (spark, sf_dir) -> DataFrame over the whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clusters, decontam, html_extract, langid, license, neardup, negatives, packing, pylm, quality, suffix, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(bpe.WORD_FILE)


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(packing.TEXT_FILE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "op1_html_extraction": lambda s, d: html_extract.op1_html_extraction(t(s, d, "pages")),
        "op2_bpe": lambda s, d: bpe.op2_bpe(t(s, d, "documents"), word_tokenizer()),
        "op3_top_k": lambda s, d: topk.op3_top_k(t(s, d, "embeddings")),
        "op4_lm_scoring": lambda s, d: pylm.op4_lm_scoring(t(s, d, "documents")),
        "op5_near_duplicates": lambda s, d: neardup.op5_near_duplicates(t(s, d, "documents")),
        "op6_language_id": lambda s, d: langid.op6_language_id(t(s, d, "documents")),
        "op7_license_scan": lambda s, d: license.op7_license_scan(t(s, d, "documents")),
        "op8_decontamination": lambda s, d: decontam.op8_decontamination(t(s, d, "documents"), t(s, d, "benchmark")),
        "op9_suffix_dedup": lambda s, d: suffix.op9_suffix_dedup(t(s, d, "documents")),
        "op10_quality": lambda s, d: quality.op10_quality(t(s, d, "documents"), t(s, d, "labels")),
        "op11_centroids": lambda s, d: clusters.op11_centroids(t(s, d, "embeddings")),
        "op12_packing": lambda s, d: packing.op12_packing(t(s, d, "documents"), byte_tokenizer),
        "op13_hard_negatives": lambda s, d: negatives.op13_hard_negatives(t(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": topk.ORACLE, "op11_centroids": clusters.ORACLE, "op13_hard_negatives": negatives.ORACLE}
