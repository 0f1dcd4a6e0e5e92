"""Benchmark decontamination: documents that hold a benchmark item, word for word or nearly.

The windows of a document that are compared with an item have as many words as the item, or are the whole document where
it is shorter.  Windows and items get a
64-bit SimHash of their weighted shingles; a window is a candidate if its fingerprint is within ``radius`` bits of the
item's, found over ``radius + 1`` blocks of the fingerprint, one of which has to be equal (multi-index Hamming), so no
fingerprint within the radius is missed.  Candidates are verified by the exact weighted Jaccard similarity of their
shingles.  A shingle weighs the more the fewer items hold it.

A window that shares no shingle with an item has similarity 0, so windows are formed only around shared shingles.

Items are processed in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words, whose index every task holds;
each block is one pass over the documents.  Weights are those of the whole benchmark for every block: driver and tasks
hold 16 bytes for every shingle that several items share, the only memory that grows with the benchmark.

Defined results: words are runs of letters and digits in lower case.  NULL, empty or wordless texts match nothing;
items of fewer than ``SHINGLE`` words are found where a text has exactly their words in a row (without ``short_runs``:
only as a whole text); repeated rows give repeated matches; a NULL item id
or text matches nothing; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import (_BASE, _MULT, FOLD, U64, mix, row_blocks, shingle_hashes, span_hashes, spread, text_bytes,
                     text_column, whole_hash)

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 24            # bits.  At the threshold the cosine is 0.89 or more, so 9.7 of 64 bits differ on average with a
                       # deviation of 2.9: a window that reaches the threshold is within 24 bits but for 1 in a million
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000

# word bytes: ASCII letters and digits and every byte of a multi-byte character
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lower(text: str | None) -> str:
    """Lower case that never changes where words end; multi-byte marks and spaces become blanks."""
    text = (text or "").lower()
    return text if text.isascii() else re.sub(r"[^\w\x00-\x7f]", " ", text)


def _spans(buf: np.ndarray, off: np.ndarray):
    word = _IN_WORD[buf]
    head, tail = word.copy(), word.copy()
    if buf.size:
        head[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        filled = np.flatnonzero(off[1:] > off[:-1])
        head[off[filled]], tail[off[filled + 1] - 1] = word[off[filled]], word[off[filled + 1] - 1]
    st = np.flatnonzero(head)
    return st, np.flatnonzero(tail) + 1, np.searchsorted(off, st, side="right") - 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end)."""
    buf, off = text_bytes(texts)
    if buf.size and (buf >= 128).any():
        buf, off = text_bytes(pa.array([lower(t.as_py()) for t in texts], pa.large_string()))
    else:
        buf = FOLD[buf]
    st, en, doc = _spans(buf, off)
    return span_hashes(buf, st, en), np.searchsorted(doc, np.arange(len(off)))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    return shingle_hashes(words, size) if len(words) >= size else whole_hash(words) if len(words) else words


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """``whole_hash`` of every run of ``n`` words."""
    m = max(0, len(words) - n + 1)
    with np.errstate(over="ignore"):
        h = np.full(m, U64(n) * _MULT)
        for j in range(n):
            h = h * U64(_BASE) + words[j:j + m]
        return mix(h)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """-1 / +1 for the 64 bits of every hash."""
    raw = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1)
    return raw.astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


class Index:
    """Items of one block: shingles, weights, fingerprints and the Hamming blocks."""

    def __init__(self, ids: list, texts: list, weights: tuple[np.ndarray, np.ndarray, float], size: int, radius: int):
        hashes, first = word_hashes(pa.array(texts, pa.large_string()))
        self.size, self.radius = size, radius
        self.shared, self.shared_weight, self.alone = weights
        self.ids, self.words, self.bags = [], [], []
        for i, a, b in zip(ids, first[:-1], first[1:]):
            if b > a:
                self.ids.append(i)
                self.words.append(int(b - a))
                self.bags.append(_shingles(hashes[a:b], size))
        flat = np.concatenate(self.bags) if self.bags else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(self.bags)), [len(b) for b in self.bags])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.known, self.begin = np.unique(self.flat, return_index=True)
        self.end = np.append(self.begin[1:], len(self.flat))
        self.prints = np.array([self._print(b) for b in self.bags], dtype=np.uint64)
        self.total = [self._mass(Counter(b.tolist())) for b in self.bags]
        # blocks of the fingerprint: radius + 1 runs of bits, at most 64
        edges = np.linspace(0, 64, min(radius + 1, 64) + 1).astype(int)
        self.masks = np.array([((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:])],
                              dtype=np.uint64)
        # presence of a shingle: a bit table keeps nearly all others away from the search
        self.table = np.zeros(1 << 22, bool)
        self.table[self.known >> U64(42)] = True
        # items under a shingle's length: item of each run of words, by the number of words
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({w for w in self.words if w < size}):
            own = np.array([i for i, w in enumerate(self.words) if w == n])
            hashes_n = np.array([self.bags[i][0] for i in own], np.uint64)
            by = np.argsort(hashes_n, kind="stable")
            self.runs[n] = hashes_n[by], own[by]

    def short_runs(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first word within the text) of the first place of every short item in every text."""
        out: dict[tuple[int, int], int] = {}
        for n, (known, own) in self.runs.items():
            every = run_hashes(words, n)
            low = np.searchsorted(known, every)
            count = np.searchsorted(known, every, side="right") - low
            at = np.flatnonzero(count)
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + n <= first[row + 1]  # runs end in the text they start in
            for p, r in zip(at[inside].tolist(), row[inside].tolist()):
                for i in own[low[p]:low[p] + count[p]].tolist():
                    out.setdefault((r, i), p - int(first[r]))
        return [(r, i, p) for (r, i), p in out.items()]

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        """Weights of shingles over the whole benchmark, also of those that only items of other blocks hold."""
        out = np.full(len(shingles), self.alone)
        if len(self.shared) and len(shingles):
            k = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
            out = np.where(self.shared[k] == shingles, self.shared_weight[k], out)
        return out

    def _mass(self, bag: Counter) -> float:
        w = self.weigh(np.fromiter(bag, np.uint64, len(bag)))
        return float(sum(x * c for x, c in zip(w.tolist(), bag.values())))

    def _print(self, bag: np.ndarray) -> np.uint64:
        w = self.weigh(bag).astype(np.float32)
        return _pack((_bits(bag) * w[:, None]).sum(axis=0, keepdims=True))[0]

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[shingles >> U64(42)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        return at[self.known[k] == shingles[at]]

    def items_at(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``shingles``, item) of all shared shingles."""
        k = np.searchsorted(self.known, shingles)
        n = self.end[k] - self.begin[k]
        return np.repeat(np.arange(len(shingles)), n), self.owner[np.repeat(self.begin[k], n) + spread(n)]

    def similarity(self, bag: Counter, item: int) -> float:
        mine = Counter(self.bags[item].tolist())
        both = self._mass(mine & bag)
        every = self.total[item] + self._mass(bag) - both
        return both / every if every else 0.0


def _matches(words: np.ndarray, shingles: np.ndarray, found: np.ndarray, index: Index, threshold: float):
    """Best window per item: (item, similarity, first word) of the windows of one document that reach the threshold."""
    if len(words) < index.size:
        hit_at, item_at = index.items_at(shingles[found])
        return [(i, 1.0, 0) for i in np.unique(item_at).tolist()
                if index.words[i] == len(words) and index.similarity(Counter(shingles.tolist()), i) >= threshold]
    hit, item = index.items_at(shingles[found])
    pos = found[hit]
    out = []
    order = np.lexsort((pos, item))
    item, pos = item[order], pos[order]
    weight = index.weigh(shingles)
    for i in np.unique(item).tolist():
        if index.words[i] < index.size:
            continue
        length = min(index.words[i], len(words))
        span = length - index.size + 1  # shingles of a window
        near = pos[item == i]
        starts = np.unique(np.clip((near[:, None] - np.arange(span)[None, :]).ravel(), 0, len(words) - length))
        # a window needs at least the threshold's share of the item's weight; its hits bound that from above
        lo, hi = np.searchsorted(near, starts), np.searchsorted(near, starts + span)
        mass = np.concatenate([[0.0], np.cumsum(weight[near])])
        starts = starts[mass[hi] - mass[lo] >= threshold * index.total[i] * (1 - 1e-6)]
        if not len(starts):
            continue
        a, b = starts.min(), starts.max() + span
        sums = np.zeros((b - a + 1, 64), np.float64)
        np.cumsum(_bits(shingles[a:b]) * weight[a:b, None], axis=0, out=sums[1:])
        prints = _pack(sums[starts - a + span] - sums[starts - a])
        apart = prints ^ index.prints[i]
        block = ((apart[:, None] & index.masks[None, :]) == 0).any(axis=1)
        close = block & (np.bitwise_count(apart) <= index.radius)
        best = (0.0, 0)
        for s in starts[close].tolist():
            got = index.similarity(Counter(shingles[s:s + span].tolist()), i)
            if got > best[0]:
                best = (got, s)
        if best[0] >= threshold:
            out.append((i, best[0], best[1]))
    return out


def _weights(rows: list, size: int) -> dict:
    """1 + ln(items / items with the shingle) for every shingle; under None the weight of a shingle of no item."""
    hashes, first = word_hashes(pa.array([r[1] for r in rows], pa.large_string()))
    held = Counter(h for a, b in zip(first[:-1], first[1:]) for h in set(_shingles(hashes[a:b], size).tolist()))
    n = max(1, len(rows))
    return {h: 1.0 + float(np.log(n / c)) for h, c in held.items()} | {None: 1.0 + float(np.log(n))}


def _item_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()


def _shared_weights(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles that several items hold, their weights, weight of all others) over all items, as ``_weights`` has them:
    a shingle of one item weighs as much as one of none, so only shared ones are listed."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "t"):
                hashes, first = word_hashes(text_column(part, "t"))
                own = [np.unique(_shingles(hashes[a:b], size)) for a, b in zip(first[:-1], first[1:]) if b > a]
                if own:
                    h, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    shared = rows.select("t").mapInArrow(held, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")) \
        .filter("n > 1").toArrow()
    total = max(1, rows.count())
    h = shared.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], 1.0 + np.log(total / shared.column("n").to_numpy()[order]), 1.0 + float(np.log(total))


def _blocks(items: DataFrame, id_col: str, text_col: str, max_items: int, max_words: int) -> Iterator[list]:
    """Items in the order of their ids, a bounded block at a time; the driver holds one block."""
    held, words = [], 0
    for r in _item_rows(items, id_col, text_col).orderBy("i", "t").toLocalIterator():
        n = len(r.t.split())
        if held and (len(held) >= max_items or words + n > max_words):
            yield held
            held, words = [], 0
        held.append((r.i, r.t))
        words += n
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE,
                 radius: int = RADIUS, max_items: int = BLOCK_ITEMS, max_words: int = BLOCK_WORDS,
                 short_runs: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of a document for every item it holds;
    ``n_words`` are those of the item.  ``short_runs``: items of fewer than ``size`` words also inside longer texts."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema} | \
        {"item_id": items.schema[item_id].dataType.simpleString()}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, similarity double, first_word bigint, n_words bigint"
    id_type = to_arrow_type(items.schema[item_id].dataType)
    out = spark.createDataFrame([], schema)
    # one set of weights for all blocks: a similarity does not depend on the block of the item
    weights = spark.sparkContext.broadcast(_shared_weights(_item_rows(items, item_id, item_text), size))
    for rows in _blocks(items, item_id, item_text, max_items, max_words):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, weights=weights) -> Iterator[pa.RecordBatch]:
            held = sent.value
            index = Index([r[0] for r in held], [r[1] for r in held], weights.value, size, radius)
            ids = pa.array(index.ids, id_type)
            for batch in batches:
                for part in row_blocks(batch):
                    hashes, first = word_hashes(text_column(part))
                    every = shingle_hashes(hashes, size)
                    hits = index.hits(every) if len(every) and len(index.known) else np.empty(0, np.int64)
                    row = np.searchsorted(first, hits, side="right") - 1
                    got = [(r, i, 1.0, p) for r, i, p in index.short_runs(hashes, first)] if short_runs else []
                    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size)) if not short_runs else row[:0]
                    for r in sorted({*np.unique(row).tolist(), *short.tolist()}):
                        a, b = first[r], first[r + 1]
                        own = _shingles(hashes[a:b], size)
                        found = index.hits(own) if len(index.known) else own[:0]
                        if len(found):
                            got += [(r, *m) for m in _matches(hashes[a:b], own, found, index, threshold)]
                    take = pa.array([g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), ids.take(pa.array([g[1] for g in got], pa.int64())),
                         pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64()),
                         pa.array([index.words[g[1]] for g in got], pa.int64())],
                        names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        out = out.unionByName(src.mapInArrow(run, schema))
    return out


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark, short_runs=True)
