"""Repeated byte strings across documents by winnowed hash grouping.

This takes the place of a depth-limited radix sort of suffixes: nothing is ordered, and every pass groups anew by hashes.
Only strings of ``span`` bytes are compared, and a group that holds one document leaves at once.  The passes, called
digits:

  digit 1  the first ``GRAM`` bytes of sampled suffixes.  Of the GRAM-byte strings in every window of ``span`` bytes
           the one with the smallest hash is sampled, so equal windows sample the same place.  Groups are the strings
           of equal hash; suffixes of documents without a shared group are finished here.
  digit 2  everything a window around a surviving sample can reach.  Samples whose whole surroundings are equal form a
           class: each window of a class also starts in the class's smallest document.
  digit 3  the windows themselves, where samples of one group have different surroundings (the edges of a repeat).
           Only the smallest document of each class takes part, with the windows whose own sample is open; equal groups of windows are exactly the repeats.

Every pass is one two-way exchange (``exchange.round_trip``) in which a chunk of documents sends each distinct key
once, with the smallest document that has it, so a passage shared by a third of the corpus is one entry per chunk.
Hashes: 40 bits in pass 1 (a filter only), 128 bits in passes 2 and 3.

Defined results: a byte is repeated if a ``span``-byte string over it also starts in a document with a smaller id;
documents with equal ids (repeated rows) do not cover each other; a NULL id covers nothing and loses nothing; NULL or
empty or short texts lose nothing.  Extra columns are carried only if listed in ``keep``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import U64, mix, row_blocks, text_bytes, text_column
from .exchange import buckets_of, pack, release, round_trip, unpack

SPAN = 50
GRAM = 24
_C = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                       0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                       0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_KEY_BITS = 40


def _words(buf: np.ndarray, margin: int) -> np.ndarray:
    """The 8 bytes from every position on as one number; ``margin`` bytes 0xFF (never in UTF-8) on both sides."""
    wide = np.full(buf.size + 2 * margin + 8, 0xFF, np.uint8)
    wide[margin:margin + buf.size] = buf
    return np.ndarray((buf.size + 2 * margin,), np.uint64, wide.data, strides=(1,)).copy()


def _hash(words: np.ndarray, at: np.ndarray | slice, steps: list[int], seed: int) -> np.ndarray:
    """Hash of the 8-byte words at ``at`` + each step."""
    with np.errstate(over="ignore"):
        h = None
        for k, step in enumerate(steps):
            w = words[at.start + step:at.stop + step] if isinstance(at, slice) else words[at + step]
            part = (w ^ (w >> U64(29))) * _C[(k + seed) % len(_C)]
            h = part if h is None else (h ^ (h >> U64(32))) * _C[(k + seed + 3) % len(_C)] + part
        return mix(h)


def _steps(length: int) -> list[int]:
    """Starts of 8-byte words that cover ``length`` bytes."""
    return [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i:i + width] for every i."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def minima(buf: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram-byte string at every position, smallest of them in the window at every position; 0 where a
    window does not lie inside a text)."""
    h = _hash(_words(buf, 0), slice(0, buf.size - gram + 1), _steps(gram), 0) | U64(1)
    low = _slide(h, span - gram + 1, np.minimum)
    for a, b in zip(np.maximum(off[1:-1] - span + 1, 0), off[1:-1]):  # windows that cross into the next text
        low[a:b] = 0
    return h, low


def samples(buf: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the gram-byte strings that have the smallest hash of some window inside a text."""
    if buf.size < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    reach = span - gram + 1
    h, low = minima(buf, off, span, gram)
    best = np.zeros(h.size + reach - 1, np.uint64)
    best[reach - 1:reach - 1 + low.size] = low
    at = np.flatnonzero(_slide(best, reach, np.maximum) == h)
    return at, h[at]


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group in that order) of equal key tuples."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _least(keys: list[np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct keys in order, smallest id of each, number of the key of each entry)."""
    order, first = _groups(keys)
    where = np.empty(len(order), np.int64)
    where[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    least = np.minimum.reduceat(ids[order], first) if len(order) else ids
    return [k[order][first] for k in keys], least, where


def _by_bucket(key: np.ndarray, buckets: int):
    """(bucket, slice) runs of ascending 64-bit keys, buckets being equal ranges of the key's high 32 bits."""
    b = ((key >> U64(32)) * U64(buckets)) >> U64(32)
    found, first = np.unique(b, return_index=True)
    return [(int(x), slice(i, j)) for x, i, j in zip(found, first, np.append(first[1:], len(key)))]


class _Chunk:
    """Documents of a chunk, block by block: text bytes, row offsets, ids and which rows take part."""

    def __init__(self, blocks, id_at: int, text_col: str):
        self.blocks = []
        for b in blocks:
            buf, off = text_bytes(text_column(b, text_col))
            col = b.column(id_at)
            ids = col.cast(pa.int64()).fill_null(0).to_numpy()
            self.blocks.append((b, buf, off, ids, col.is_valid().to_numpy(zero_copy_only=False)))


def _merge(starts: np.ndarray, span: int) -> np.ndarray:
    """Flat [start, end, start, end, ...] of the runs covered by windows at the ascending ``starts``."""
    if not len(starts):
        return np.empty(0, np.int64)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + span)
    lo, hi = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + span
    return np.column_stack([lo, hi]).ravel()


def _without(raw: np.ndarray, spans: np.ndarray) -> bytes:
    if not len(spans):
        return raw.tobytes()
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[spans[::2]] += 1
    mark[spans[1::2]] -= 1
    return raw[np.cumsum(mark[:-1]) == 0].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                   span: int = SPAN, gram: int = GRAM, result: str = "kept binary",
                   make: Callable[[bytes], object] = bytes) -> DataFrame:
    """``keep`` columns of ``docs`` (default: the id) plus ``n_bytes``, ``spans`` (flat starts and ends of the removed
    runs) and the column ``result``, which ``make`` derives from the remaining bytes."""
    if span < gram or gram < 8:
        raise ValueError("span has to be at least gram, and gram at least 8")
    keep = [id_col] if keep is None else keep
    name, kind = result.split(" ", 1)
    n_keep = len(keep) + 1
    src = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("__id"),
                      F.col(text_col).alias("__text"))
    fixed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    schema = f"{fixed}, __text string, __at array<int>, __got array<int>, n_bytes bigint, spans array<int>, `{name}` {kind}"
    buckets = buckets_of(docs)
    reach = span - gram
    around = [x - reach for x in _steps(span + reach)]
    root = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/repeats-{uuid.uuid4().hex}"

    def table(df: DataFrame, step: int) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/{step}")
        return df.sparkSession.read.parquet(f"{root}/{step}")

    def rows(block, texts, at, got, finished):
        """A batch of the state: unfinished rows carry text, open positions and what is covered so far."""
        spans = [_merge(got[i], span) if finished[i] else None for i in range(block.num_rows)]
        done = [make(_without(texts[i], spans[i])) if finished[i] else None for i in range(block.num_rows)]
        text = block.column(block.schema.get_field_index("__text"))
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [*block.columns[:n_keep], pa.array([None if f else t for f, t in zip(finished, text)], pa.string()),
             pa.array([None if f else a for f, a in zip(finished, at)], ints),
             pa.array([None if f else g for f, g in zip(finished, got)], ints),
             pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, ints),
             pa.array(done, pa.binary() if kind == "binary" else pa.string())],
            names=[*block.schema.names[:n_keep], "__text", "__at", "__got", "n_bytes", "spans", name])

    def texts_of(buf, off):
        return [buf[a:b] for a, b in zip(off[:-1], off[1:])]

    def split(values, owner, n, base=None):
        """Values per row, less the row's base."""
        ends = np.searchsorted(owner, np.arange(n + 1))
        return [values[a:b] - (0 if base is None else base[i]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]

    # pass 1 -------------------------------------------------------------------------------------------------------
    def sampled(chunk):
        for b, buf, off, ids, valid in chunk.blocks:
            at, h = samples(buf, off, span, gram)
            row = np.searchsorted(off, at, side="right") - 1
            use = valid[row]
            yield b, buf, off, ids, at[use], h[use] >> U64(64 - _KEY_BITS) << U64(64 - _KEY_BITS), row[use]

    def grams(chunk):
        """(ascending distinct hashes, held by several documents?, entries per block)."""
        parts = list(sampled(chunk))
        h = np.concatenate([p[5] for p in parts])
        doc = np.concatenate([p[3][p[6]] for p in parts])
        (key,), low, where = _least([h], doc)
        high = np.full(len(key), np.iinfo(np.int64).min)
        np.maximum.at(high, where, doc)
        return parts, key, low != high, where, low

    def send_1(blocks):
        _, key, many, _, low = grams(_Chunk(blocks, n_keep - 1, "__text"))
        for b, s in _by_bucket(key, buckets):
            yield b, pack(np.diff(key[s] >> U64(64 - _KEY_BITS), prepend=U64(0)), np.packbits(many[s]))

    def answer_1(payloads):
        got = [unpack(p) for p in payloads]
        keys = [np.cumsum(k, dtype=np.uint64) for k, _ in got]
        many = np.concatenate([np.unpackbits(m, count=len(k)).astype(bool) for k, (_, m) in zip(keys, got)])
        every, where, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        hot = times > 1
        hot[where[many]] = True
        return [pack(np.packbits(x)) for x in np.split(hot[where], np.cumsum([len(k) for k in keys])[:-1])]

    def finish_1(blocks, replies):
        parts, key, _, where, _ = grams(_Chunk(blocks, n_keep - 1, "__text"))
        hot = np.zeros(len(key), bool)
        for b, s in _by_bucket(key, buckets):
            hot[s] = np.unpackbits(unpack(replies[b])[0], count=s.stop - s.start)
        hot = hot[where]
        begin = 0
        for b, buf, off, _, at, _, row in parts:
            mine = hot[begin:begin + len(at)]
            begin += len(at)
            open_at = split(at[mine], row[mine], b.num_rows, off[:-1])
            yield rows(b, texts_of(buf, off), open_at, [np.empty(0, np.int32)] * b.num_rows,
                       [not len(x) for x in open_at])

    # passes 2 and 3: positions and covered starts come with the rows -------------------------------------------------
    def positions(block, off):
        col = block.column(block.schema.get_field_index("__at"))
        at = col.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(block.num_rows), np.diff(col.offsets.to_numpy()))
        return at + off[:-1][row], row

    def surroundings(chunk):
        for b, buf, off, ids, _ in chunk.blocks:
            at, row = positions(b, off)
            words = _words(buf, reach)
            left = np.minimum(at - off[row], reach)
            right = np.minimum(off[row + 1] - at, span)
            # bytes beyond the text do not count: their words are cut to the text's bytes
            h = np.zeros(len(at), np.uint64)
            with np.errstate(over="ignore"):
                for k, step in enumerate(around):
                    w = words[at + reach + step]
                    cut_l = np.clip(-left - step, 0, 8).astype(np.uint64)
                    cut_r = np.clip(step + 8 - right, 0, 8).astype(np.uint64)
                    full = U64(0xFFFFFFFFFFFFFFFF)
                    mask_l = np.where(cut_l < 8, full << (np.minimum(cut_l, U64(7)) * U64(8)), U64(0))
                    mask_r = np.where(cut_r < 8, full >> (np.minimum(cut_r, U64(7)) * U64(8)), U64(0))
                    w = w & mask_l & mask_r
                    h = (h ^ (h >> U64(32))) * _C[k % len(_C)] + (w ^ (w >> U64(29))) * _C[(k + 5) % len(_C)]
                h = mix(h + (left * 256 + right).astype(np.uint64) * _C[2])
            yield b, buf, off, ids, at, row, _hash(words, at + reach, _steps(gram), 0) | U64(1), h

    def classes(chunk):
        parts = list(surroundings(chunk))
        keys, low, where = _least([np.concatenate([p[6] for p in parts]), np.concatenate([p[7] for p in parts])],
                                  np.concatenate([p[3][p[5]] for p in parts]))
        return parts, keys, low, where

    def send_least(keys, low):
        for b, s in _by_bucket(keys[0], buckets):
            yield b, pack(keys[0][s], keys[1][s], low[s])

    def send_2(blocks):
        _, keys, low, _ = classes(_Chunk(blocks, n_keep - 1, "__text"))
        yield from send_least(keys, low)

    def answer_least(payloads, several: bool):
        got = [unpack(p) for p in payloads]
        keys, least, where = _least([np.concatenate([g[i] for g in got]) for i in (0, 1)],
                                    np.concatenate([g[2] for g in got]))
        same = np.zeros(len(least), bool)
        if several:  # groups of the first key with more than one class
            twin = keys[0][1:] == keys[0][:-1]
            same[1:] |= twin
            same[:-1] |= twin
        ends = np.cumsum([len(g[0]) for g in got])[:-1]
        return [pack(a, np.packbits(b)) for a, b in zip(np.split(least[where], ends), np.split(same[where], ends))]

    def replied(keys, replies):
        least, flag = np.empty(len(keys[0]), np.int64), np.zeros(len(keys[0]), bool)
        for b, s in _by_bucket(keys[0], buckets):
            got = unpack(replies[b])
            least[s], flag[s] = got[0], np.unpackbits(got[1], count=s.stop - s.start)
        return least, flag

    def window_starts(at, row, off):
        """Starts of the windows around positions, and the position each belongs to."""
        lo, hi = np.maximum(at - reach, off[row]), np.minimum(at, off[row + 1] - span)
        n = np.maximum(hi - lo + 1, 0)
        which = np.repeat(np.arange(len(at)), n)
        return lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which

    def finish_2(blocks, replies):
        parts, keys, _, where = classes(_Chunk(blocks, n_keep - 1, "__text"))
        least, several = (x[where] for x in replied(keys, replies))
        begin = 0
        for b, buf, off, ids, at, row, *_ in parts:
            mine = slice(begin, begin + len(at))
            begin += len(at)
            covered = ids[row] > least[mine]
            starts, which = window_starts(at[covered], row[covered], off)
            owner = row[covered][which]
            starts, pick = np.unique(starts, return_index=True)
            got = split(starts, owner[pick], b.num_rows, off[:-1])
            still = ~covered & several[mine]
            open_at = split(at[still], row[still], b.num_rows, off[:-1])
            yield rows(b, texts_of(buf, off), open_at, got, [not len(x) for x in open_at])

    def windows(chunk):
        parts = []
        for b, buf, off, ids, _ in chunk.blocks:
            at, row = positions(b, off)
            starts, which = window_starts(at, row, off)
            if len(starts):  # a window is decided at its own sample: others around an open sample need no digit 3
                h, low = minima(buf, off, span, gram)
                own = h[at[which]] == low[starts]
                starts, which = starts[own], which[own]
            starts, pick = np.unique(starts, return_index=True)
            words = _words(buf, 8)
            parts.append((b, buf, off, ids, starts, row[which][pick], _hash(words, starts + 8, _steps(span), 1),
                          _hash(words, starts + 8, _steps(span), 6)))
        keys, low, where = _least([np.concatenate([p[6] for p in parts]), np.concatenate([p[7] for p in parts])],
                                  np.concatenate([p[3][p[5]] for p in parts]))
        return parts, keys, low, where

    def send_3(blocks):
        _, keys, low, _ = windows(_Chunk(blocks, n_keep - 1, "__text"))
        yield from send_least(keys, low)

    def finish_3(blocks, replies):
        parts, keys, _, where = windows(_Chunk(blocks, n_keep - 1, "__text"))
        least = replied(keys, replies)[0][where]
        begin = 0
        for b, buf, off, ids, starts, row, *_ in parts:
            mine = slice(begin, begin + len(starts))
            begin += len(starts)
            covered = ids[row] > least[mine]
            found = split(starts[covered], row[covered], b.num_rows, off[:-1])
            before = b.column(b.schema.get_field_index("__got"))
            got = [np.union1d(f, np.array(g.as_py(), dtype=np.int64)) for f, g in zip(found, before)]
            yield rows(b, texts_of(buf, off), found, got, [True] * b.num_rows)

    one = table(round_trip(src, "__text", send_1, answer_1, finish_1, schema), 1)
    release(docs.sparkSession)
    is_open = F.col("__text").isNotNull()
    two = table(round_trip(one.filter(is_open), "__text", send_2, lambda p: answer_least(p, True), finish_2, schema), 2)
    release(docs.sparkSession)
    three = round_trip(two.filter(is_open), "__text", send_3, lambda p: answer_least(p, False), finish_3, schema)
    every = one.filter(~is_open).unionByName(two.filter(~is_open)).unionByName(three)
    return every.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", name)


def op9_suffix_dedup(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs, result="kept_sha256 string", make=lambda kept: hashlib.sha256(kept).hexdigest())
    size = F.size("spans")
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.floor(size / 2).cast("long").alias("n_spans"),
                        "kept_sha256")
