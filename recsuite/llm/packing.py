"""Packing token sequences by vector bin packing.

An example asks for tokens, for one segment, and for its loss-bearing tokens; a sequence has a limit for each.  A sequence is
filled by the dot-product heuristic: of all examples that fit into what is left of it, the one whose demand has the
largest weighted dot product with what is left goes next (weights: mean demand of the waiting examples, as parts of
the limits).  Examples of equal demand are one class, so a choice looks at classes, not at examples.

With ``cut`` an example may be spread over sequences: when none fits whole, the best one gives the part that fits, so
sequences end full.  A sequence that cannot be filled (segment limit, or nothing waits) is cut back to a power of two, a
length that needs no padding, and the rest waits for the next one.  Without ``cut`` examples stay whole; only one that
exceeds a limit by itself is cut into sequences of its own.

Every task packs its own rows: it reads, tokenizes, keeps a bounded pool of waiting examples and emits pieces, so
nothing is shuffled and no key can be hot.  A sequence's id holds its task's partition number, which is the same when
a task runs again.

Defined results: NULL or empty text has no ids but the end id; with ``end=None`` it has none and gives no piece.  Texts are
tokenized whole, however long; a text's ids are held at once.  Rows with equal or NULL ids are examples of their own.
Ties between classes go to more tokens, then to more loss, then to the class seen first; in a class the first come goes
first.  An empty table gives an empty result.  Other columns are carried only if listed in ``keep``, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried

POOL_TOKENS = 2 << 20     # waiting tokens and examples of a task
POOL_EXAMPLES = 50_000
FLUSH_TOKENS = 1 << 20    # pieces are emitted in batches of about so many tokens
TEXT_FILE = "byte_bpe_50k.json"
END = 1


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Piece(NamedTuple):
    example: int           # number of the example in its task
    start: int
    ids: np.ndarray
    loss: np.ndarray | None  # loss[i]: loss-bearing tokens before token i, and in all at the end; None: all tokens are


def _demand(p: Piece) -> tuple[int, int]:
    return len(p.ids), len(p.ids) if p.loss is None else int(p.loss[-1] - p.loss[0])


def _part(p: Piece, a: int, b: int) -> Piece:
    return Piece(p.example, p.start + a, p.ids[a:b], None if p.loss is None else p.loss[a:b + 1])


class Packer:
    """Waiting examples, and the sequences made of them."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.tokens = self.examples = 0
        self._class: dict[tuple[int, int], int] = {}
        self._waiting: list[deque[Piece]] = []
        self._demands = np.empty((0, 3))
        self._weights = np.ones(3)

    def add(self, p: Piece, first: bool = False) -> Iterator[list[Piece]]:
        """Take an example; parts that fill a sequence by themselves are sequences at once."""
        whole = p
        while _demand(p)[0] > self.limits.tokens or _demand(p)[1] > self.limits.loss:
            n = self._fitting(p, self.limits.tokens, self.limits.loss)
            yield [_part(p, 0, n)]
            p = _part(p, n, len(p.ids))
        if not len(p.ids):
            return
        if p is not whole:  # a view would hold all ids of the text
            p = p._replace(ids=p.ids.copy(), loss=None if p.loss is None else p.loss.copy())
        d = _demand(p)
        if d not in self._class:
            if len(self._waiting) == len(self._demands):
                self._demands = np.vstack([self._demands, np.zeros((max(64, len(self._demands)), 3))])
            self._demands[len(self._waiting)] = d[0], 1, d[1]
            self._class[d] = len(self._waiting)
            self._waiting.append(deque())
        queue = self._waiting[self._class[d]]
        (queue.appendleft if first else queue.append)(p)
        self.tokens, self.examples = self.tokens + d[0], self.examples + 1

    @staticmethod
    def _fitting(p: Piece, tokens: int, loss: int) -> int:
        """Longest part of ``p`` from its start within both bounds, one token at least."""
        by_loss = loss if p.loss is None else int(np.searchsorted(p.loss, p.loss[0] + loss, side="right")) - 1
        return max(1, min(len(p.ids), tokens, by_loss))

    def _tidy(self) -> None:
        """Forget empty classes and weigh anew."""
        held = [(k, q) for k, q in zip(self._class, self._waiting) if q]
        self._class = {k: i for i, (k, _) in enumerate(held)}
        self._waiting = [q for _, q in held]
        self._demands = np.array([[k[0], 1, k[1]] for k, _ in held], dtype=float).reshape(len(held), 3)
        if held:
            mean = np.average(self._demands, axis=0, weights=[len(q) for q in self._waiting])
            self._weights = mean / np.array(self.limits, dtype=float)

    def _best(self, left: np.ndarray, whole: bool) -> int:
        """Class with the largest dot product with what is left, of those that fit if ``whole``; -1 if none."""
        demands = self._demands[:len(self._waiting)]
        ok = self._open[:len(self._waiting)]
        if whole:
            ok = ok & (demands <= left).all(axis=1)
        if not ok.any():
            return -1
        limits = np.array(self.limits, dtype=float)
        score = np.where(ok, demands @ (self._weights * left / limits / limits), -1.0)
        top = np.flatnonzero(score == score.max())
        return int(top[np.lexsort((-demands[top, 2], -demands[top, 0]))[0]])

    def _take(self, c: int) -> Piece:
        p = self._waiting[c].popleft()
        self._open[c] = bool(self._waiting[c])
        self.tokens, self.examples = self.tokens - len(p.ids), self.examples - 1
        return p

    def _put_back(self, p: Piece) -> None:
        for _ in self.add(p, first=True):
            raise AssertionError("a part of an example fits")
        n = len(self._waiting)
        if len(self._open) < n:
            self._open = np.append(self._open, np.zeros(max(64, n), bool))
        self._open[self._class[_demand(p)]] = True

    def pack(self, low: int = 0) -> Iterator[list[Piece]]:
        """Sequences until at most ``low`` tokens wait."""
        self._tidy()
        self._open = np.ones(len(self._waiting), bool)
        while self.tokens > low:
            left, sequence = np.array(self.limits, dtype=float), []
            while left[0] > 0 and left[1] > 0 and self.tokens:
                c = self._best(left, whole=True)
                if c >= 0:
                    p = self._take(c)
                elif self.cut and left[2] > 0:
                    p = self._take(self._best(left, whole=False))
                    n = self._fitting(p, int(left[0]), int(left[2]))
                    self._put_back(_part(p, n, len(p.ids)))
                    p = _part(p, 0, n)
                else:
                    break
                sequence.append(p)
                left -= (len(p.ids), 1, _demand(p)[1])
            fill = sum(len(p.ids) for p in sequence)
            if self.cut and fill < self.limits.tokens:
                over = fill - (1 << (fill.bit_length() - 1))
                while over:
                    p = sequence.pop()
                    n = min(over, len(p.ids))
                    self._put_back(_part(p, len(p.ids) - n, len(p.ids)))
                    if n < len(p.ids):
                        sequence.append(_part(p, 0, len(p.ids) - n))
                    over -= n
            yield sequence


class Tokenizer:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file.

    Where ``ranks_agree``, tiktoken does the work with the file's own pieces and ids; texts it refuses (very long
    runs of white space) go to the library."""

    def __init__(self, path: str, fast: bool):
        from tokenizers import Tokenizer as Library

        self._library = Library.from_file(path)
        self._library.no_truncation(), self._library.no_padding()
        self._fast = None
        if fast:
            import tiktoken

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=piece_bytes(spec),
                                           special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the pattern's backtracking has a limit
                pass
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


# Fixed value: the word pattern of byte-level BPE files
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such a file: itself, or the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(spec: dict) -> dict[bytes, int]:
    own, added = _alphabet(), {t["content"] for t in spec["added_tokens"]}
    return {bytes(own[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}


def ranks_agree(path: str) -> bool:
    """Whether merging by ids gives what the file's merge list gives: plain byte-level pieces, ids in merge order, and
    every piece is what its own bytes merge to."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("post_processor") is None
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                "fuse_unk", "byte_fallback", "ignore_merges"))
             and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))
    if not plain:
        return False
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    ids = [vocab[a + b] for a, b in merges]
    if ids != sorted(ids) or len(set(ids)) != len(ids):
        return False
    rank = {m: i for i, m in enumerate(merges)}
    for a, b in merges:
        parts = list(a + b)
        while len(parts) > 1:
            low = min(((rank.get(m, len(rank)), i) for i, m in enumerate(zip(parts, parts[1:]))))
            if low[0] == len(rank):
                return False
            parts[low[1]:low[1] + 2] = [parts[low[1]] + parts[low[1] + 1]]
    return True


_loaded: dict[tuple[str, bool], Tokenizer] = {}


def tokenizer(path: str, fast: bool) -> Tokenizer:
    """One per worker process and file."""
    if (path, fast) not in _loaded:
        _loaded[path, fast] = Tokenizer(path, fast)
    return _loaded[path, fast]


Content = dict[str, tuple[str, pa.DataType, Callable[[np.ndarray], object]]]
IDS: Content = {"ids": ("array<bigint>", pa.list_(pa.int64()), lambda ids: ids.astype(np.int64))}
CRC: Content = {"ids_crc32": ("bigint", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))}


def _packed(src: DataFrame, fixed: str, names: list, examples: Callable, limits: Limits, cut: bool, content: Content,
            own: int) -> DataFrame:
    """Pieces of the examples that ``examples(batch)`` yields row by row as (ids, loss per token or None); the first
    columns of ``src`` (all but the last ``own``) are carried."""
    if min(limits) < 1:
        raise ValueError("a limit has to be one at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits, cut), TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}   # example -> (carried row, tokens, tokens not emitted yet)
        rows, size, count = [], 0, 0

        def emit(sequences):
            nonlocal number, size
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    row, total, rest = held.pop(p.example)
                    if rest > len(p.ids):
                        held[p.example] = row, total, rest - len(p.ids)
                    rows.append((row, p.start, len(p.ids), total, number, offset, p.ids))
                    offset += len(p.ids)
                number, size = number + 1, size + offset

        def flush():
            nonlocal size
            arrays = [pa.concat_arrays([r[0].column(i) for r in rows]) for i in range(rows[0][0].num_columns)]
            arrays += [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)]
            arrays += [pa.array([f(r[6]) for r in rows], kind) for _, kind, f in content.values()]
            out = pa.RecordBatch.from_arrays(arrays, names=[*[c for c in rows[0][0].schema.names], "start", "length",
                                                            "doc_tokens", "sequence_id", "offset", *content])
            rows.clear()
            size = 0
            return out

        for b in batches:
            carry = b.select(list(range(b.num_columns - own)))
            carry = carry.take(pa.array(np.arange(b.num_rows)))  # a slice would hold the batch with its texts
            for i, (ids, loss) in enumerate(examples(b)):
                before = None if loss is None else np.append(0, np.cumsum(loss))
                if len(ids):
                    held[count] = carry.slice(i, 1), len(ids), len(ids)
                    emit(packer.add(Piece(count, 0, ids, before)))
                    count += 1
                if packer.tokens > POOL_TOKENS or packer.examples > POOL_EXAMPLES:
                    emit(packer.pack(packer.tokens // 4))
                if size >= FLUSH_TOKENS or len(rows) >= POOL_EXAMPLES:
                    yield flush()
        emit(packer.pack())
        if rows:
            yield flush()

    kinds = "".join(f", {n} {k}" for n, (k, _, _) in content.items())
    out = src.mapInArrow(run, f"{fixed}start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint{kinds}")
    return out.select(*names, "start", "length", *content, "doc_tokens", "sequence_id", "offset")


def pack_texts(docs: DataFrame, path: Callable[[], str], keep: list[str], text_col: str = "text",
               limits: Limits = Limits(), cut: bool = True, end: int | None = END, content: Content = IDS) -> DataFrame:
    """One row per piece of a text's ids (``end`` added): the ``keep`` columns, start, length, the columns of
    ``content`` (made of the piece's ids), doc_tokens, sequence_id and offset.  ``path`` finds the tokenizer file on the machine
    that calls it.  All tokens bear loss."""
    src, fixed, names = carried(docs, keep, __text=text_col)
    fast, tail = ranks_agree(path()), np.array([] if end is None else [end], dtype=np.uint32)

    def examples(b):
        t = tokenizer(path(), fast)
        for text in b.column(b.num_columns - 1):
            yield np.concatenate([t.encode(text.as_py() or ""), tail]), None

    return _packed(src, fixed, names, examples, limits, cut, content, 1)


def pack_examples(examples: DataFrame, keep: list[str], ids_col: str = "ids", loss_col: str = "loss",
                  limits: Limits = Limits(), cut: bool = False, content: Content = IDS) -> DataFrame:
    """The same for examples that are tokenized already: ``ids_col`` holds their ids, ``loss_col`` one boolean per id (loss-bearing
    or not; NULL: all are).  NULL ids are no ids."""
    src, fixed, names = carried(examples, keep, __ids=ids_col, __loss=loss_col)

    def rows(b):
        n = b.num_columns
        for ids, loss in zip(b.column(n - 2), b.column(n - 1)):
            got = np.array(ids.as_py() or [], dtype=np.int64)
            mask = np.ones(len(got), bool) if loss.as_py() is None else np.array(loss.as_py(), dtype=bool)
            if len(mask) != len(got):
                raise ValueError("an example needs one loss mark per id")
            yield got, mask

    return _packed(src, fixed, names, rows, limits, cut, content, 2)


def op12_packing(docs: DataFrame, path: Callable[[], str]) -> DataFrame:
    """Pieces of every document; the digest of a piece stands for its ids."""
    return pack_texts(docs, path, ["doc_id"], content=CRC)
