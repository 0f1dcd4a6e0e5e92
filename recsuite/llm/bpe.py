"""BPE encoding and decoding with a public tokenizer file.

``encode``: texts are normalised and split into words inside the Spark tasks; every distinct word of the corpus is
encoded once, in the bucket it hashes to, and the ids are joined back to the words by their position in the chunk
(``exchange.round_trip``).  ``decode`` joins every id to its piece; the id table is the vocabulary file, whose size is
fixed, so each task holds it.

The tokenizer file has to split into words first and then work on bytes (a ``Split`` followed by ``ByteLevel``), as
the ``word_bpe`` file does; its path is a parameter.  Strings of special tokens inside a text become their ids, as in
the tokenizers library.

Defined results: NULL or empty text -> no ids, the empty text.  Ids outside the vocabulary decode to nothing.  Rows are
independent: repeated rows and repeated ids repeat; extra columns are carried only if listed in ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import row_blocks, span_hashes, spread, text_bytes
from .exchange import buckets_of, columns, from_bytes, pack, round_trip, unpack

WORD_FILE = "word_bpe_49k.json"

# Below this code point, where lower case stays below it, the fast splitter is used; the library normalises and splits
# the other texts.  U+0130 grows when
# lower-cased, so it goes to the library too.
_FAST_LIMIT = 0x180
_SLOW = re.compile(f"[^\x00-įı-{chr(_FAST_LIMIT - 1)}]")


def _char_class(prefix: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_FAST_LIMIT) if unicodedata.category(chr(c))[0] == prefix)


_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTERS, _NUMBERS = _char_class("L"), _char_class("N")
# Fixed value: the word pattern of the tokenizer file, written with explicit character sets
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"},
                                                                   "content": " "}, {"type": "Lowercase"}]}


class Splitter:
    """Words of a text, and ids of words, for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError("the tokenizer file does not split into words before its byte level")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have to be plain strings of the raw text")
        self.fast = spec["normalizer"] == _NORMALISER and steps[0]["pattern"] == {"Regex": _PATTERN}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        # splitting needs no vocabulary; the model for the ids is loaded where words are encoded
        bare = {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": [], "pre_tokenizer": steps[0],
                "post_processor": None, "truncation": None, "padding": None}
        self._words = Tokenizer.from_str(json.dumps(spec | bare))
        self._path, self._ids = path, None

    def _plain(self, text: str) -> list[str]:
        if self.fast and not _SLOW.search(text):
            return _FAST.findall(text.lower())
        n = self._words.normalizer
        return [w for w, _ in self._words.pre_tokenizer.pre_tokenize_str(n.normalize_str(text) if n else text)]

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        if self._ids is None:
            from tokenizers import Tokenizer

            self._ids = Tokenizer.from_file(self._path)
            self._ids.normalizer = None  # words are normalised and split already
            self._ids.pre_tokenizer = self._ids.pre_tokenizer[1]
            self._ids.no_truncation(), self._ids.no_padding()
        return [e.ids for e in self._ids.encode_batch_fast(words, add_special_tokens=False)]


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """One per worker process and file."""
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def _bucket(words: pa.Array, buckets: int) -> np.ndarray:
    buf, off = text_bytes(words.cast(pa.large_string()))
    return (span_hashes(buf, off[:-1], off[1:], fold=False) % np.uint64(buckets)).astype(np.int64)


def _distinct(blocks: list[pa.RecordBatch], split: Splitter, text_col: str) -> set[str]:
    words: set[str] = set()
    for block in blocks:
        for t in block.column(block.schema.get_field_index(text_col)):
            words.update(split.words(t.as_py() or ""))
    return words


def _dealt(words: set[str], buckets: int) -> tuple[pa.Array, list[tuple[int, slice]]]:
    """(words by bucket, ascending inside, [(bucket, its slice)])."""
    ordered = pa.array(words, pa.string())
    ordered = ordered.take(pc.sort_indices(ordered))
    where = _bucket(ordered, buckets)
    order = np.argsort(where, kind="stable")
    found, first = np.unique(where[order], return_index=True)
    return ordered.take(pa.array(order)), [(int(b), slice(i, j)) for b, i, j in
                                           zip(found, first, np.append(first[1:], len(order)))]


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, text_col: str = "text",
           columns_of: Callable[[pa.ListArray], dict[str, pa.Array]] | None = None,
           kinds: str = "ids array<int>") -> DataFrame:
    """``keep`` columns of ``docs`` plus ``ids`` (array of int), equal to the library's encoding of the whole text; or
    plus the columns ``kinds`` that ``columns_of`` derives from a block's ids, where the ids themselves need not leave
    the task."""
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text"), kinds])
    columns_of = columns_of or (lambda ids: {"ids": ids})
    names = [k.split()[0] for k in kinds.split(", ")]
    buckets = buckets_of(docs)

    def send(blocks):
        words, runs = _dealt(_distinct(blocks, splitter(tokenizer_path), "__text"), buckets)
        for b, s in runs:
            yield b, columns(word=words[s])

    def answer(payloads):
        lists = [from_bytes(p)[0].column(0) for p in payloads]
        distinct = pa.chunked_array(lists).combine_chunks().dictionary_encode()
        ids = splitter(tokenizer_path).encode_words(distinct.dictionary.to_pylist())
        size = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype=np.uint32)
        first = np.cumsum(size) - size
        out, at = [], 0
        codes = distinct.indices.to_numpy()
        for x in lists:
            own = codes[at:at + len(x)]
            at += len(x)
            n = size[own]
            out.append(pack(n.astype(np.uint32), flat[np.repeat(first[own], n) + spread(n)]))
        return out

    def finish(blocks, replies):
        split = splitter(tokenizer_path)
        words, runs = _dealt(_distinct(blocks, split, "__text"), buckets)
        if [b for b, _ in runs] != sorted(replies):
            raise RuntimeError("words of a chunk came back incomplete")
        number = {w: i for i, w in enumerate(words.to_pylist())}
        got = [unpack(replies[b]) for b, _ in runs]
        none = [np.empty(0, np.uint32)]
        size = np.concatenate([g[0] for g in got] or none).astype(np.int64)
        flat = np.concatenate([g[1] for g in got] or none)
        first = np.cumsum(size) - size
        for block in blocks:
            codes, ends = [], [0]
            for t in block.column(len(keep)):
                codes += [number[w] for w in split.words(t.as_py() or "")]
                ends.append(len(codes))
            own = np.array(codes, dtype=np.int64)
            n = size[own]
            tokens = flat[np.repeat(first[own], n) + spread(n)]
            offsets = np.concatenate([[0], np.cumsum(n)])[ends]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.astype(np.int32)))
            made = columns_of(lists)
            yield pa.RecordBatch.from_arrays([*block.columns[:len(keep)], *[made[n] for n in names]],
                                             names=[*block.schema.names[:len(keep)], *names])

    out = round_trip(src, "__text", send, answer, finish, schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *names)


class Pieces:
    """The id-to-piece table of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if tok.decoder is not None:
            raise ValueError("the tokenizer file has a decoder of its own")
        pieces = [tok.id_to_token(i) for i in range(max(tok.get_vocab(True).values(), default=-1) + 1)]
        self.size = len(pieces)
        self.piece = pa.array([*pieces, None], pa.string())  # the last stands for ids outside the vocabulary

    def decode(self, lists: pa.ListArray) -> pa.StringArray:
        """Join the ids of every list to their pieces, and those by one space; unknown ids have no piece."""
        ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < self.size)
        owner = pc.list_parent_indices(lists).to_numpy()
        got = self.piece.take(pa.array(np.where(known, ids, self.size)))
        valid = got.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[valid], minlength=len(lists)))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), got.filter(pa.array(valid))), " ")


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process and file."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def decode(encoded: DataFrame, tokenizer_path: str, keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """``keep`` columns of ``encoded`` plus ``decoded``: the pieces of the ids joined by one space, as the library
    decodes for a file without a decoder (special tokens are kept)."""
    keep = ["doc_id"] if keep is None else keep
    src = encoded.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__ids"),
                        "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = pc.fill_null(batch.column(len(keep)), pa.scalar([], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pieces(tokenizer_path).decode(lists)],
                                                 names=[*batch.schema.names[:len(keep)], "decoded"])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "decoded")


def encode_and_decode(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None,
                      text_col: str = "text") -> DataFrame:
    """``keep`` columns plus n_tokens, ids and decoded, with one Python step where the ids are joined back."""
    def both(ids: pa.ListArray) -> dict[str, pa.Array]:
        return {"n_tokens": pc.list_value_length(ids).cast(pa.int64()), "ids": ids,
                "decoded": pieces(tokenizer_path).decode(ids)}

    return encode(docs, tokenizer_path, keep, text_col, both, "n_tokens bigint, ids array<int>, decoded string")


def op2_bpe(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    def digests(ids: pa.ListArray) -> dict[str, pa.Array]:
        numbers = pc.binary_join(pc.cast(ids, pa.list_(pa.string())), " ")
        decoded = pieces(tokenizer_path).decode(ids)
        sha = lambda texts: pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts])
        return {"n_tokens": pc.list_value_length(ids).cast(pa.int64()), "ids_sha256": sha(numbers),
                "decoded_sha256": sha(decoded)}

    return encode(docs, tokenizer_path, columns_of=digests,
                  kinds="n_tokens bigint, ids_sha256 string, decoded_sha256 string")
