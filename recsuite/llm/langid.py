"""Language identification by compression.

For every language a raw-content zstandard dictionary is built from a bounded sample of labelled training text.  A
text is compressed once with each dictionary, in pieces of ``PIECE_BYTES`` that each start from the dictionary, so every
part of a long text counts alike; the language with the smallest result wins, at equal sizes the one with
more training rows.  The answer is rejected when the runner-up is within ``min_margin`` bytes.

Defined results: NULL text or no letter -> ``und``, score 0, rejected; no labelled training row -> every row ``und``;
equal sizes and training rows -> the alphabetically first language; equal sizes are rejected (margin 0).  Rows are independent: repeated rows repeat,
an empty table gives an empty result.  Extra columns of ``docs`` are ignored by ``identify``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import top_n_per_group
from .blocks import row_blocks
from .frames import carried

UNKNOWN = "und"
SAMPLE_DOCS = 600       # labelled rows per language that a dictionary is made of
SAMPLE_CHARS = 400      # characters of each of them
DICT_BYTES = 110 << 10  # bytes of a dictionary
MAX_LANGUAGES = 500     # distinct labels accepted: dictionaries are held by every task
PIECE_BYTES = 64 << 10  # bytes of a text that are compressed at a time: the dictionary stays in the compressor's window
MIN_MARGIN = 1          # bytes by which the winner must be shorter
# Compressor settings: a lazy matcher that also takes matches of 4 bytes tells languages apart in a few words
SETTINGS = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 1, "min_match": 4, "target_length": 0,
            "strategy": zstandard.STRATEGY_LAZY}

_ASCII = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def normalise(text: str) -> bytes:
    """Lower case, ASCII non-letters as single spaces, UTF-8."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_ASCII).split())


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
          dict_bytes: int = DICT_BYTES, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> dict[str, tuple[int, bytes]]:
    """(training rows, dictionary) per language from labelled rows; in the dictionary: the ``sample_docs`` rows of the language with the smallest
    hash of their text, ``sample_chars`` characters each (documented bound of the sample), at most ``dict_bytes``
    bytes.  Texts of under ``sample_chars`` / 8 characters are taken only where longer ones run out."""
    rows = (docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"),
                    F.substring(text_col, 1, sample_chars).alias("part")))
    counts = dict(rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    # copies share a hash and count once, so a large group of copies cannot fill the sample
    hashes = rows.select("lang", "h", (F.length("part") < sample_chars // 8).alias("short")).distinct()
    chosen = top_n_per_group(hashes, ["lang"], ["short", "h"], sample_docs, salt_on=["h"]).select("lang", "h")
    picked = (rows.join(F.broadcast(chosen), ["lang", "h"])  # languages x sample_docs rows, checked below
              .groupBy("lang", "h").agg(F.min("part").alias("part")))
    by_lang: dict[str, dict[bytes, None]] = {}
    for r in picked.orderBy("lang", "h", "part").collect():  # at most languages x sample_docs short rows
        by_lang.setdefault(r.lang, {})[normalise(r.part)] = None
    return {lang: (counts[lang], (b" " + b" ".join(parts))[-dict_bytes:]) for lang, parts in by_lang.items()}


def _compressors(model: dict[str, tuple[int, bytes]]):
    """One compressor per language, the language with most training rows first."""
    out = []
    for lang in sorted(model, key=lambda x: (-model[x][0], x)):
        d = zstandard.ZstdCompressionDict(model[lang][1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(**SETTINGS, write_content_size=False, write_checksum=False,
                                                       write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=settings)))
    return out


def classify(text: str | None, compressors) -> tuple[str, float, int]:
    """(language, score, margin in bytes).  The score reads a size as a code length: a language's weight is
    2 ** -(bytes above the smallest), and the score is the winner's share."""
    if not text or not compressors or not _has_letter(text):
        return UNKNOWN, 0.0, 0
    raw = normalise(text)
    parts = [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)] or [raw]
    sizes = np.array([sum(len(c.compress(p)) for p in parts) for _, c in compressors])
    best = int(sizes.argmin())
    above = np.delete(sizes, best) - sizes[best]
    share = 1.0 / (1.0 + float(np.exp2(-above.astype(np.float64)).sum()))
    return compressors[best][0], share, int(above.min()) if len(above) else len(raw)


def identify(docs: DataFrame, model: dict[str, tuple[int, bytes]], keep: list[str] | None = None,
             min_margin: int = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` plus ``lang_pred``, ``score`` and ``rejected``."""
    keep = ["doc_id"] if keep is None else keep
    # a text that is kept is sent to the workers once, not a second time to be read
    src, fixed, names = carried(docs, keep, **({} if text_col in keep else {"__text": text_col}))
    at = keep.index(text_col) if text_col in keep else len(keep)
    read = src.columns[at]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comps = _compressors(sent.value)
        for batch in batches:
            for part in row_blocks(batch, read):
                got = [classify(t.as_py(), comps) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64()),
                     pa.array([g[0] == UNKNOWN or g[2] < min_margin for g in got], pa.bool_())],
                    names=[*part.schema.names[:len(keep)], "lang_pred", "score", "rejected"])

    out = src.mapInArrow(run, f"{fixed}lang_pred string, score double, rejected boolean")
    return out.select(*names, "lang_pred", "score", "rejected")


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo: the fold that is kept out of training.  A NULL id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder,
                      F.lit(False))


def op6_language_id(docs: DataFrame) -> DataFrame:
    out = held_out(4, 2)
    model = train(docs.filter(~out))
    marked = docs.withColumn("__held", out)
    return identify(marked, model, ["doc_id", "__held"]).select(
        "doc_id", F.col("__held").alias("held_out"), "lang_pred", "score", "rejected")
