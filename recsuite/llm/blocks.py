"""Arrow and numpy helpers shared by the operators of this subpackage.

Text is handled as one byte buffer per block of rows (a few MB), so per-document work becomes a handful of numpy
passes over the buffer.  A NULL text is the empty text everywhere unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64

# bytes 0x09-0x0D and 0x20 separate words (the white space of the contracts)
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True

# one random odd 64-bit value per byte; A-Z share the value of a-z, so word hashes ignore ASCII case
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_FOLD = _BYTE.copy()
_BYTE_FOLD[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_column(batch: pa.RecordBatch, column: str = "text") -> pa.LargeStringArray:
    """The column as large strings, NULL as the empty string."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    return pc.fill_null(col, "") if col.null_count else col


def text_bytes(col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; text i is bytes[offsets[i]:offsets[i + 1]]."""
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def row_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes together; one row at least each."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of every word; words are runs of non-gap bytes and never cross texts."""
    if not buf.size:
        z = np.empty(0, np.int64)
        return z, z, z
    gap = GAP[buf]
    word = ~gap
    head, tail = word.copy(), word.copy()
    head[1:] &= gap[:-1]
    tail[:-1] &= gap[1:]
    filled = np.flatnonzero(off[1:] > off[:-1])
    first, last = off[filled], off[filled + 1] - 1
    head[first], tail[last] = word[first], word[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        down = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64))
    return up, down


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of every byte span, the same wherever the span stands; ``fold`` ignores ASCII case."""
    n = buf.size
    size = BLOCK_BYTES
    while size < n:
        size *= 2
    up, down = _powers(size)
    table = _BYTE_FOLD if fold else _BYTE
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[buf] * up[:n], out=total[1:])
        # an empty span may start at n
        at = np.minimum(starts, size - 1)
        h = (total[ends] - total[starts]) * down[at]
        return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring word hashes (len(words) - size + 1 of them)."""
    m = len(words) - size + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for j in range(1, size):
            h = h * U64(_BASE) + words[j:j + m]
        return mix(h)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a whole word sequence shorter than a shingle; its length is part of the hash."""
    with np.errstate(over="ignore"):
        h = U64(len(words)) * _MULT
        for w in words:
            h = h * U64(_BASE) + w
        return mix(np.array([h], dtype=np.uint64))
