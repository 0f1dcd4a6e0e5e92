"""Document quality: histogram gradient-boosted trees over document statistics.

Statistics are computed for whole texts, a block of documents at a time.  The trees are trained on a bounded sample of
labelled rows (``SAMPLE_ROWS``): features are cut into at most ``BINS`` quantile bins, every level of a tree is one
histogram of gradients, and the finished trees are perfect binary trees stored as flat arrays, so scoring a block is
``depth`` gathers per tree.

Defined results: NULL or empty text has all statistics 0 and gets the model's score for that; a document with several
labels counts with each of them; NULL labels are ignored; without any label, or with one class only, the score is the
share of label 1 (0.5 without labels).  Repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import FOLD, row_blocks, span_hashes, text_bytes, text_column, word_spans
from .frames import carried
from .html_extract import STOP_WORDS
from .langid import held_out

SAMPLE_ROWS = 20_000  # labelled rows the trees are fitted on: those with the smallest hash of their id
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.1
L2 = 1.0
MIN_LEAF = 20

_CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [32],
            "line": [10], "other_gap": [9, 11, 12, 13], "stop": [46], "comma": [44], "mark": [33, 63],
            "bar": [124], "symbol": b"#$%&*@^~=+<>/\\_", "quote": b"\"'()[]{}:;-`", "high": range(128, 192),
            "lead": range(192, 256)}
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
_N = len(_CLASSES) + 1

FEATURES = [*(f"share_{c}" for c in _CLASSES), "share_rest", "log_bytes", "log_words", "mean_word", "distinct_words",
            "stop_words", "log_lines", "mean_line", "repeated_lines", "capital_words", "ending_words", "long_words",
            "first_gap"]

_stop = sorted(STOP_WORDS)
_stop_buf = np.frombuffer("".join(_stop).encode(), np.uint8)
_stop_end = np.cumsum([len(w.encode()) for w in _stop])
_STOP = np.sort(span_hashes(_stop_buf, np.concatenate([[0], _stop_end[:-1]]), _stop_end))


def _distinct_per_text(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Matrix texts x FEATURES for the texts of one byte buffer."""
    n = len(off) - 1
    size = (off[1:] - off[:-1]).astype(np.float64)
    some = np.maximum(size, 1.0)
    owner = np.repeat(np.arange(n), off[1:] - off[:-1])
    shares = np.bincount(owner * _N + _CLASS[buf], minlength=n * _N).reshape(n, _N) / some[:, None]
    st, en, doc = word_spans(buf, off)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    wsome = np.maximum(words, 1.0)
    per = lambda x: np.bincount(doc, weights=x, minlength=n) / wsome
    h = span_hashes(buf, st, en)
    length = (en - st).astype(np.float64)
    # stop words are looked up without a closing mark
    last = buf[en - 1] if len(en) else np.empty(0, np.uint8)
    mark = (last == 46) | (last == 44) | (last == 33) | (last == 63)
    bare = span_hashes(buf, st, np.where(mark & (en - st > 1), en - 1, en))
    at = np.minimum(np.searchsorted(_STOP, bare), len(_STOP) - 1)
    # lines: spans between line feeds, bounded by the texts
    feed = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([off[:-1][size > 0], feed + 1]))
    starts = starts[starts < len(buf)]
    ends = np.minimum(np.concatenate([starts[1:], [len(buf)]]) if len(starts) else starts,
                      off[np.searchsorted(off, starts, side="right")] if len(starts) else starts)
    line_doc = np.searchsorted(off, starts, side="right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    lsome = np.maximum(lines, 1.0)
    line_kinds = _distinct_per_text(span_hashes(buf, starts, ends), line_doc, n)
    first = buf[st] if len(st) else np.empty(0, np.uint8)
    gaps = np.full(n, 0.0)
    if len(st):
        seen, where = np.unique(doc, return_index=True)
        gaps[seen] = length[where]
    return np.column_stack([
        shares, np.log1p(size), np.log1p(words), per(length), _distinct_per_text(h, doc, n) / wsome,
        per(_STOP[at] == bare), np.log1p(lines), size / lsome, 1.0 - line_kinds / lsome,
        per(FOLD[first] != first), per(mark), per(length > 12), gaps])


def _bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(col, q)) for col in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
        l2: float = L2, min_leaf: int = MIN_LEAF) -> dict[str, np.ndarray]:
    """Flat arrays of the boosted trees: ``feature`` and ``cut`` (trees x inner nodes), ``leaf`` (trees x leaves)."""
    rows, cols = x.shape
    inner, leaves = 2 ** depth - 1, 2 ** depth
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if rows else 0.5
    model = {"start": np.array([np.log(mean / (1 - mean))]), "feature": np.zeros((0, inner), np.int64),
             "cut": np.zeros((0, inner)), "leaf": np.zeros((0, leaves))}
    if rows == 0 or y.min() == y.max():
        return model
    edges = _bin_edges(x, bins)
    code = np.column_stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)])
    flat = code + np.arange(cols) * bins
    raw = np.full(rows, model["start"][0])
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, np.int64)  # position inside the level
        f_tree, c_tree = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width = 2 ** level
            key = (node[:, None] * (cols * bins) + flat).ravel()
            hist = [np.bincount(key, weights=np.repeat(w, cols), minlength=width * cols * bins)
                    .reshape(width, cols, bins) for w in (g, h, np.ones(rows))]
            left = [a.cumsum(axis=2) for a in hist]
            total = [a[:, :, -1:] for a in left]
            gain = (left[0] ** 2 / (left[1] + l2) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + l2)
                    - total[0] ** 2 / (total[1] + l2))
            gain[(left[2] < min_leaf) | (total[2] - left[2] < min_leaf)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f_best, b_best = best // bins, best % bins
            base = width - 1
            for k in np.flatnonzero(ok):
                if b_best[k] < len(edges[f_best[k]]):
                    f_tree[base + k], c_tree[base + k] = f_best[k], edges[f_best[k]][b_best[k]]
            node = 2 * node + (x[np.arange(rows), f_tree[base + node]] > c_tree[base + node])
        gs, hs = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
        value = -rate * gs / (hs + l2)
        raw += value[node]
        feature.append(f_tree), cut.append(c_tree), leaf.append(value)
    return model | {"feature": np.array(feature), "cut": np.array(cut), "leaf": np.array(leaf)}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every row of ``x``."""
    raw = np.full(len(x), model["start"][0])
    rows = np.arange(len(x))
    for f, c, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(leaf)))):
            node = 2 * node + 1 + (x[rows, f[node]] > c[node])
        raw += leaf[node - len(f)]
    return 1.0 / (1.0 + np.exp(-raw))


def _feature_rows(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    src, fixed, names = carried(docs, keep, __text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "__text"):
                x = statistics(*text_bytes(text_column(part, "__text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(list(x), pa.list_(pa.float64()))],
                                                 names=[*part.schema.names[:len(keep)], "stats"])

    return src.mapInArrow(run, f"{fixed}stats array<double>").select(*names, "stats")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
          label_col: str = "quality", text_col: str = "text", **options) -> dict[str, np.ndarray]:
    """Fit on at most ``sample_rows`` labelled rows (the bound of what reaches the driver)."""
    sample = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
              .orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body")).join(
        F.broadcast(sample), "__id")  # at most sample_rows rows
    got = _feature_rows(rows, ["__id", "__label"], "__body") \
        .orderBy(F.xxhash64("__id"), "__id", "__label", "stats").limit(sample_rows).collect()
    x = np.array([r.stats for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r[1] for r in got], dtype=np.float64), **options)


def score(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] | None = None,
          text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` plus ``score`` (0 to 1)."""
    keep = ["doc_id"] if keep is None else keep
    src, fixed, names = carried(docs, keep, __text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees x (inner nodes + leaves) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "__text"):
                x = statistics(*text_bytes(text_column(part, "__text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(predict(sent.value, x))],
                                                 names=[*part.schema.names[:len(keep)], "score"])

    return src.mapInArrow(run, f"{fixed}score double").select(*names, "score")


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.filter(~held_out(3, 1)))
    marked = docs.withColumn("__held", held_out(3, 1))
    return score(marked, model, ["doc_id", "__held"]).select(
        "doc_id", F.col("__held").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
