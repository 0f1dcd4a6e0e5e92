"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word is drawn from the restaurant of its context, the word before; all context restaurants share one parent (the
unigram restaurant), whose base gives ``UNKNOWN_SHARE`` to the one unknown word and the rest evenly to the known words.
Before the first word of a text stands the end of a text, so every token is the context of just one token and a
context has as many customers as its word.  Customers of the parent are the tables of its children.

All training tokens of the corpus are counted.  Words are dealt to buckets by hash; a bucket holds all pairs (word,
context) of its words: their customers, the words' customers and tables in the parent, and the tables of pairs with
several customers (a pair of one customer has one table).  The number of tables in a context's restaurant adds up over
buckets of words, so contexts are dealt to buckets of their own: in every sweep a bucket of words sends the tables of its
contexts there and gets their totals back.  Only contexts of pairs with several customers, and the bucket's own words,
take part in that; the pairs themselves are written once and stay where they are until texts are scored.

Given the totals the words are independent, so a sweep is one pass over the buckets: all customers of every pair are
re-seated at once by blocked Gibbs (the number of tables is drawn from its law given the customers and the weight of a
new table, context room times the parent's probability: the law that re-seating single customers leads to), the parent's
customers follow the tables and are re-seated likewise, and the totals are summed up for the next sweep.
A pair of any number of customers costs one draw.
Probabilities are averaged over the kept sweeps.

Discounts come from the counts of counts of the corpus.  Tokens: words (runs of non-gap bytes, A-Z folded) and one end
per text.  Words are told apart by 64 bits of a hash, and as contexts by its first 40.

Defined results: NULL, empty or blank text is one end token; a NULL id is in the training fold; repeated rows count as
often as they occur; without training rows every word is unknown.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, remove_folder
from .blocks import U64, span_hashes, text_bytes, text_column, word_spans
from .exchange import buckets_of, pack, release, round_trip, send_chunks, unpack
from .langid import held_out

HASH_BITS = 40     # of a context
_HASH = (1 << HASH_BITS) - 1
CONTEXT_BITS = 24  # number of a context, or of a word, in its bucket
_CONTEXT = U64((1 << CONTEXT_BITS) - 1)
_END = U64(0x2545F4914F6CDD1D)
STRENGTH = 1.0
UNKNOWN_SHARE = 0.5
SWEEPS = 4
BURN_IN = 1
SCANS = 2     # times all customers of a word are re-seated in a sweep
EXACT = 1024  # customers up to which the law of the tables is tabulated; beyond it is integrated
NODES = 64    # points of the integral
POINTS = 25   # table counts at which it is taken


def token_keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash of each token, text of each token), every text closed by its end; a token's context is the token before
    it, and the end before the first."""
    n = len(off) - 1
    st, en, doc = word_spans(buf, off)
    size = np.bincount(doc, minlength=n) + 1
    keys = np.full(len(st) + n, _END)
    is_word = np.ones(len(keys), bool)
    is_word[np.cumsum(size) - 1] = False
    keys[is_word] = span_hashes(buf, st, en)
    return keys, np.repeat(np.arange(n, dtype=np.int32), size)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, number of the value of every entry)."""
    coded = pa.array(x).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[coded.indices.to_numpy()]


def _runs(high: np.ndarray, buckets: int):
    """(bucket, slice) runs of ascending hashes, of which ``high`` are the first 32 bits."""
    b = (high.astype(np.uint64) * U64(buckets)) >> U64(32)
    found, first = np.unique(b, return_index=True)
    return [(int(x), slice(int(i), int(j))) for x, i, j in zip(found, first, np.append(first[1:], len(high)))]


def _word_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first pair of every word, number of the word of every pair)."""
    word = key >> U64(CONTEXT_BITS)
    new = np.ones(len(key), bool)
    new[1:] = word[1:] != word[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


# seating ----------------------------------------------------------------------------------------------------------
@lru_cache(4)
def _log_ways(discount: float) -> np.ndarray:
    """[c, t]: log of the generalised Stirling number, the weight of all seatings of ``c`` customers at ``t`` tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        out[c + 1, 1:c + 1] = out[c, 1:c + 1] + np.log(c - discount * t)
        out[c + 1, 1:c + 2] = np.logaddexp(out[c + 1, 1:c + 2], out[c, :c + 1])
    return out


def _tilt(log_mean, high: float, shape) -> np.ndarray:
    """Where ``log_mean(log u, u, log(1 - e ** -u))``, falling in u, crosses 0."""
    low, high = np.full(shape, -60.0), np.full(shape, np.log(high))
    for _ in range(45):
        mid = (low + high) / 2
        u = np.exp(mid)
        more = log_mean(u, np.log(-np.expm1(-u))) > 0
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return np.exp(low)


def _log_sum_of_sizes(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log P(``t`` independent Sibuya(``d``) sizes add up to ``c``): the coefficient of z ** c in (1 - (1 - z) ** d) ** t,
    integrated over a parabola (in -log z) through the saddle point.  It is the Stirling number times t! d ** t / c!."""
    target = np.log(t * d) - np.log(c)
    u0 = _tilt(lambda u, q: target + (d - 1) * q - u - np.log(-np.expm1(d * q)), 30.0, t.shape)
    u0 = np.maximum(u0, 2.0 / c)[:, None]
    c, t = c[:, None], t[:, None]
    width = np.minimum(np.pi / (2 * u0), np.maximum(7.0 / np.sqrt(c * u0 * (1 - d)), 4.5 / np.sqrt(c * u0)))
    turn = 1 + 1j * (np.arange(NODES) + 0.5) / NODES * width
    u = u0 * turn ** 2
    f = c * u + t * np.log1p(-np.exp(d * np.log(-np.expm1(-u))))
    top = f.real.max(axis=1, keepdims=True)
    # the constant term of the power integrates to 0: taken off where it is as large, so small results keep their digits
    one = (c * u0 < top + 3) & (u0 < 0.5)
    value = (np.exp(f - top) - np.where(one, np.exp(np.where(one, c * u - top, 0.0)), 0.0)) * turn
    total = value.real.sum(axis=1) * (2 * u0 * width)[:, 0] / NODES / np.pi
    return np.log(np.maximum(total, 1e-300)) + top[:, 0]


def _draw_many(c: np.ndarray, weight: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of entries of many customers, from the same law as the others: those of Poisson(weight / d) tables of
    Sibuya sizes that add up to ``c``."""
    rate = weight / d
    target = np.log(weight) - np.log(c)
    u = _tilt(lambda u, q: target + (d - 1) * q - u, 700.0, c.shape)
    middle = np.minimum(c, 1 - rate * np.expm1(d * np.log(-np.expm1(-u))))
    reach = 8 * np.sqrt(np.minimum(middle, c - middle + 4)) + 14
    first = np.maximum(1, np.floor(middle - reach)).astype(np.int64)
    last = np.minimum(c - 1, np.ceil(middle + reach)).astype(np.int64)
    # log(probability / t) is smooth in t: Chebyshev points carry it
    half = (last - first) / 2.0
    at = (first + half)[:, None] - half[:, None] * np.cos(np.pi * np.arange(POINTS) / (POINTS - 1))
    smooth = (_log_sum_of_sizes(np.repeat(c, POINTS), at.ravel(), d) - np.log(at.ravel())).reshape(at.shape)
    share = (-1.0) ** np.arange(POINTS)
    share[[0, -1]] /= 2
    out = np.empty(len(c), np.int64)
    for i in range(len(c)):
        t = np.arange(first[i], last[i] + 1, dtype=np.float64)
        apart = t[:, None] - at[i]
        part = share / np.where(np.abs(apart) < 1e-9, 1e-9, apart)
        log_t = np.log(t)
        f = (part @ smooth[i]) / part.sum(axis=1) + t * np.log(rate[i]) + log_t - np.cumsum(log_t)
        if last[i] == c[i] - 1:  # every customer alone: all sizes are 1, each with probability d
            f = np.append(f, c[i] * np.log(weight[i]) - log_t.sum() - np.log(c[i]))
        mass = np.cumsum(np.exp(f - f.max()))
        out[i] = first[i] + np.searchsorted(mass, rng.random() * mass[-1], side="right")
    return out


def draw_tables(c: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of ``c`` customers who are all seated anew, ``weight`` being that of a new table: a draw from the law that
    re-seating them one by one for ever would reach, weight ** t times the Stirling number of (c, t)."""
    t = np.ones(len(c), np.int64)
    ways, log_weight = _log_ways(discount), np.log(weight)
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2):np.searchsorted(c[order], EXACT, side="right")]
    sizes, first = np.unique(c[order], return_index=True)
    for n, i, j in zip(sizes.tolist(), first, np.append(first[1:], len(order))):
        tables = np.arange(1, n + 1)
        step = max(1, (1 << 20) // n)
        for at in range(i, j, step):
            part = order[at:min(at + step, j)]
            mass = ways[n, 1:n + 1] + log_weight[part, None] * tables
            mass = np.cumsum(np.exp(mass - mass.max(axis=1, keepdims=True)), axis=1)
            t[part] += (mass[:, :-1] <= (rng.random(len(part)) * mass[:, -1])[:, None]).sum(axis=1)
    hot = np.flatnonzero(c > EXACT)
    for i in range(0, len(hot), 64):
        t[hot[i:i + 64]] = _draw_many(c[hot[i:i + 64]], weight[hot[i:i + 64]], discount, rng)
    return t


def draw_sizes(c: np.ndarray, t: np.ndarray, discount: float, rng) -> np.ndarray:
    """Sizes of the tables, ``t`` of each entry in a row, that hold ``c`` customers."""
    share = rng.standard_gamma(1.0 - discount, int(t.sum())) + 1e-12
    owner = np.repeat(np.arange(len(c)), t)
    total = np.bincount(owner, weights=share, minlength=len(c))
    size = 1 + np.floor((c - t)[owner] * share / total[owner]).astype(np.int64)
    first = np.cumsum(t) - t
    rest = c - np.bincount(owner, weights=size, minlength=len(c)).astype(np.int64)
    size[first] += rest
    return size


def reseat(word: np.ndarray, context: np.ndarray, c: np.ndarray, m: np.ndarray, k: np.ndarray, ones,
           tables: np.ndarray, totals: dict, scans: int, rng):
    """One sweep over the words of a bucket: ``scans`` times all customers of every pair and then of every word in the
    parent are seated anew.  Returns the new (t, m, k).

    ``word``, ``context``, ``c``: numbers and customers of the pairs; ``m``, ``k``: customers and tables of the words in the
    parent; ``ones``: tables of each word in pairs of one customer that are not listed; ``tables``: tables per context."""
    d, d1 = totals["discount"], totals["parent_discount"]
    many = np.flatnonzero(c > 1)
    t = np.ones(len(c), np.int64)
    room = STRENGTH + d * tables[context[many]]
    upper = np.full(len(m), (STRENGTH + d1 * totals["K"]) * totals["base"])
    for _ in range(scans):
        t[many] = draw_tables(c[many], room * parent(m, k, totals, known=True)[word[many]], d, rng)
        # customers of the parent are the tables of the contexts
        m = np.bincount(word, weights=t, minlength=len(m)).astype(np.int64) + ones
        k = draw_tables(m, upper, d1, rng)
    return t, m, k


def sweep_words(key: np.ndarray, c: np.ndarray, t: np.ndarray, sizes: np.ndarray, m: np.ndarray, k: np.ndarray,
                upper: np.ndarray, tables: np.ndarray, totals: dict, scans: int, rng):
    """``reseat`` with sizes of the tables: returns the new (t, sizes, m, k, upper).  ``sizes`` are those of the pairs
    with several customers, ``upper`` those in the parent; no later sweep depends on them, so the job keeps none."""
    context = (key & _CONTEXT).astype(np.int64)
    t, m, k = reseat(_word_of(key)[1], context, c, m, k, 0, tables, totals, scans, rng)
    many = c > 1
    return (t, draw_sizes(c[many], t[many], totals["discount"], rng), m, k,
            draw_sizes(m, k, totals["parent_discount"], rng))


def parent(m: np.ndarray, k: np.ndarray, totals: dict, known: bool) -> np.ndarray:
    """Parent's probability of words with ``m`` customers at ``k`` tables."""
    base = totals["base"] if known else totals["unknown"]
    d1 = totals["parent_discount"]
    return (m - d1 * k + (STRENGTH + d1 * totals["K"]) * base) / (STRENGTH + totals["M"])


# jobs -------------------------------------------------------------------------------------------------------------
# Rows of a step: to bucket ``dest`` from bucket ``src``.  ``sums`` are set for WORDS only.
ROWS = "kind int, dest int, src int, payload binary, sums array<bigint>"
PAIRS, WORDS, CONTEXTS, ASK, TABLES = range(5)
CONTEXT_SHARE = 8  # buckets of words to a bucket of contexts, so the messages between them stay few
SUMS = 8           # words, customers and tables of the parent, customers, pairs of 1 and of 2, words of 1 and of 2


def _rows(rows: list[tuple]) -> pa.Table:
    kind, dest, src, payload, sums = zip(*rows) if rows else [()] * 5
    return pa.table({"kind": pa.array(kind, pa.int32()), "dest": pa.array(dest, pa.int32()), "src": pa.array(src, pa.int32()),
                     "payload": pa.array(payload, pa.binary()), "sums": pa.array(sums, pa.list_(pa.int64()))})


def _of(rows: pa.Table, kind: int, raw: str = "payload") -> list[tuple[int, list[np.ndarray]]]:
    """(source, arrays) of the rows of a kind, by source."""
    rows = rows.filter(pc.equal(rows["kind"], kind)).sort_by("src")
    return [(s.as_py(), unpack(p.as_buffer())) for s, p in zip(rows["src"], rows[raw])]


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _chunk_pairs(blocks, text_col: str):
    """Per block (block, text of each token), the chunk's ascending word hashes, the word of every token, the distinct pairs
    as (word, context) numbers in ascending order, and the pair of every token."""
    parts = [(b, *token_keys(*text_bytes(text_column(b, text_col)))) for b in blocks]
    words, word = _distinct(np.concatenate([p[1] for p in parts]))
    parts = [(b, text) for b, _, text in parts]
    code = word.astype(np.int64) * len(words)
    code[1:] += word[:-1]
    code[0] += np.searchsorted(words, _END)
    pairs, pair = _distinct(code)
    return parts, words, word, *np.divmod(pairs, len(words)), pair


def _cut(words: np.ndarray, pair_word: np.ndarray, buckets: int):
    """(bucket, slice of its words, slice of their pairs)."""
    for b, s in _runs(words >> U64(32), buckets):
        i, j = np.searchsorted(pair_word, [s.start, s.stop])
        yield b, s, slice(int(i), int(j))


def _asked(words: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, s: slice, p: slice) -> list[np.ndarray]:
    """A bucket's part of a chunk: words, and pairs as (number of the word, hash of the context)."""
    hashes = (words >> U64(64 - HASH_BITS)).astype(np.int64)
    return [_steps(words[s]), _steps(((pair_word[p] - s.start) << HASH_BITS) | hashes[pair_context[p]])]


def _told(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, number of the word and hash of the context of every pair), the reverse of ``_asked``."""
    pairs = np.cumsum(arrays[1], dtype=np.int64)
    return np.cumsum(arrays[0], dtype=np.uint64), pairs >> HASH_BITS, pairs & _HASH


def _word_state(words, count, ones, asks, key, c, m, k, samples) -> bytes:
    return pack(_steps(words), *[_small(x) for x in (count, ones)], _steps(asks), _steps(key),
                *[_small(x) for x in (c, m, k)], *[_small(x) for s in samples for x in s])


def _load(arrays: list[np.ndarray]):
    """([words, customers, tables in pairs of one customer, contexts asked for, pairs of several customers, their customers,
    customers and tables in the parent], samples: [tables of the pairs, customers, tables in the parent, tables in the
    words' own restaurants])."""
    ints = [x.astype(np.int64) for x in arrays]
    head = [np.cumsum(arrays[0], dtype=np.uint64), *ints[1:3], np.cumsum(ints[3]), np.cumsum(arrays[4], dtype=np.uint64),
            *ints[5:8]]
    return head, [ints[i:i + 4] for i in range(8, len(ints), 4)]


def _ask(bucket: int, asks: np.ndarray, n: np.ndarray, groups: int, kind: int = ASK) -> list[tuple]:
    return [(kind, g, bucket, pack(_steps(asks[s]), _small(n[s])), None) for g, s in _runs(asks >> (HASH_BITS - 32), groups)]


def _answered(words: np.ndarray, asks: np.ndarray, replies: list) -> tuple[np.ndarray, np.ndarray]:
    """(tables of each context that was asked for, tables in the words' own restaurants)."""
    tables = np.concatenate([r[0] for _, r in replies]).astype(np.int64)
    if len(tables) != len(asks):
        raise RuntimeError("a bucket of contexts did not answer")
    return tables, tables[np.searchsorted(asks, (words >> U64(64 - HASH_BITS)).astype(np.int64))]


def _count(docs: DataFrame) -> DataFrame:
    """Every bucket of words before the first sweep, each pair at one table, and what it sends to the contexts."""
    buckets = buckets_of(docs)
    groups = -(-buckets // CONTEXT_SHARE)

    def send(blocks):
        _, words, _, pair_word, pair_context, pair = _chunk_pairs(blocks, "__text")
        n = np.bincount(pair)
        for b, s, p in _cut(words, pair_word, buckets):
            yield b, pack(*_asked(words, pair_word, pair_context, s, p), _small(n[p]))

    def gather(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        got = [unpack(x.as_buffer()) for x in rows["payload"]]
        told = [_told(g) for g in got]
        words = np.unique(np.concatenate([w for w, _, _ in told]))
        pairs, where = _distinct(np.concatenate([(np.searchsorted(words, w)[i] << HASH_BITS) | u for w, i, u in told]))
        c = np.bincount(where, weights=np.concatenate([g[2] for g in got])).astype(np.int64)
        word, context = pairs >> HASH_BITS, pairs & _HASH
        one, many = c == 1, c > 1
        own = (words >> U64(64 - HASH_BITS)).astype(np.int64)
        asks = np.unique(np.append(context[many], own))
        if max(len(words), len(asks)) >> CONTEXT_BITS:
            raise ValueError("too many words for a bucket: raise spark.sql.shuffle.partitions")
        at = np.searchsorted(asks, context[many])
        key = (word[many].astype(np.uint64) << U64(CONTEXT_BITS)) | at.astype(np.uint64)
        count = np.bincount(word, weights=c).astype(np.int64)
        m, k = np.bincount(word), np.ones(len(words), np.int64)
        state = _word_state(words, count, np.bincount(word[one], minlength=len(words)), asks, key, c[many], m, k, [])
        sums = [len(words), len(c), len(words), int(c.sum()), int(one.sum()), int((c == 2).sum()),
                int((count == 1).sum()), int((count == 2).sum())]
        all_contexts, of = np.unique(np.append(context[one], asks), return_inverse=True)
        ones = np.bincount(of[:int(one.sum())], minlength=len(all_contexts))
        return _rows([(PAIRS, bucket, bucket, pack(_steps(pairs), _small(c)), None), (WORDS, bucket, bucket, state, sums),
                      *_ask(bucket, all_contexts, ones, groups, CONTEXTS),
                      *_ask(bucket, asks, np.bincount(at, minlength=len(asks)), groups)])

    return send_chunks(docs, "__text", send).groupBy("bucket").applyInArrow(gather, ROWS)


def _contexts(rows: pa.Table) -> pa.Table:
    """The contexts of a bucket, with their tables in pairs of one customer."""
    got = [(np.cumsum(a[0]), a[1]) for _, a in _of(rows, CONTEXTS)]
    hashes, of = _distinct(np.concatenate([g[0] for g in got]))
    ones = np.bincount(of, weights=np.concatenate([g[1] for g in got])).astype(np.int64)
    dest = rows["dest"][0].as_py()
    return _rows([(CONTEXTS, dest, dest, pack(_steps(hashes), _small(ones)), None)])


def _add_up(rows: pa.Table) -> pa.Table:
    """The tables of the contexts of a bucket, for the buckets of words that ask."""
    (g, (hashes, tables)), = _of(rows, CONTEXTS)
    hashes, tables = np.cumsum(hashes), tables.astype(np.int64)
    asks = [(b, np.searchsorted(hashes, np.cumsum(a[0])), a[1].astype(np.int64)) for b, a in _of(rows, ASK)]
    for _, at, n in asks:  # no context twice in a message
        tables[at] += n
    return _rows([(TABLES, b, g, pack(_small(tables[at])), None) for b, at, _ in asks])


def _totals(rows: DataFrame) -> dict:
    """Sums over the buckets: a few numbers, whatever the corpus."""
    row = rows.filter(F.col("kind") == WORDS).agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(SUMS)]).first()
    v, m, k, n, pairs1, pairs2, words1, words2 = [float(x or 0) for x in row]
    from_counts = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    return {"V": v, "M": m, "K": k, "N": n, "discount": from_counts(pairs1, pairs2),
            "parent_discount": from_counts(words1, words2),
            "base": (1 - UNKNOWN_SHARE) / v if v else 0.0, "unknown": UNKNOWN_SHARE if v else 1.0}


def _sweep(words: DataFrame, replies: DataFrame, totals: dict, number: int, keep: bool, scans: int, groups: int,
           seed: int) -> DataFrame:
    sent = words.sparkSession.sparkContext.broadcast(totals)

    def run(rows: pa.Table) -> pa.Table:
        (bucket, arrays), = _of(rows, WORDS)
        (own, count, ones, asks, key, c, m, k), samples = _load(arrays)
        tables, restaurants = _answered(own, asks, _of(rows, TABLES))
        if samples:
            samples[-1].append(restaurants)  # of the sweep before
        word, context = (key >> U64(CONTEXT_BITS)).astype(np.int64), (key & _CONTEXT).astype(np.int64)
        rng = np.random.default_rng([seed, number, bucket])
        t, m, k = reseat(word, context, c, m, k, ones, tables, sent.value, scans, rng)
        samples = samples + [[t, m, k]] if keep else samples
        sums = rows.filter(pc.equal(rows["kind"], WORDS))["sums"][0].as_py()
        return _rows([(WORDS, bucket, bucket, _word_state(own, count, ones, asks, key, c, m, k, samples),
                       [len(m), int(m.sum()), int(k.sum()), *sums[3:]]),
                      *_ask(bucket, asks, np.bincount(context, weights=t, minlength=len(asks)).astype(np.int64), groups)])

    return words.unionByName(replies).groupBy("dest").applyInArrow(run, ROWS)


def train(docs: DataFrame, text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, scans: int = SCANS,
          seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """(state with the kept seatings, totals of each kept sweep) learned from every text of ``docs``."""
    if not 0 <= burn_in < sweeps:
        raise ValueError("some sweep has to be kept")
    spark = docs.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/seating-{uuid.uuid4().hex}"
    groups = -(-buckets_of(docs) // CONTEXT_SHARE)

    def table(df: DataFrame, step) -> DataFrame:
        df.write.partitionBy("kind").option("compression", "none").parquet(f"{root}/{step}")  # packed already
        return spark.read.schema(ROWS).parquet(f"{root}/{step}")

    def only(df: DataFrame, kind: int) -> DataFrame:
        return df.filter(F.col("kind") == kind).select("kind", "dest", "src", "payload", "sums")

    def restaurants(state: DataFrame) -> DataFrame:
        return contexts.unionByName(only(state, ASK)).groupBy("dest").applyInArrow(_add_up, ROWS)

    state = first = table(_count(docs.select(F.col(text_col).alias("__text"))), 0)
    contexts = only(table(only(first, CONTEXTS).groupBy("dest").applyInArrow(_contexts, ROWS), "contexts"), CONTEXTS)
    release(spark)
    totals, kept = _totals(state), []
    for step in range(1, sweeps + 1):
        state = table(_sweep(only(state, WORDS), restaurants(state), totals, step, step > burn_in, scans, groups, seed), step)
        fixed = {n: totals[n] for n in ("discount", "parent_discount")}
        totals = _totals(state) | fixed
        if step > burn_in:
            kept.append(totals)
        # the step before is read no more, but for the pairs
        for old in [f"{step - 1}"] if step > 1 else [f"0/kind={kind}" for kind in (WORDS, CONTEXTS, ASK)]:
            remove_folder(spark, f"{root}/{old}")
        release(spark)
    parts = only(first, PAIRS).unionByName(only(state, WORDS)).unionByName(restaurants(state))
    return parts.select(F.col("dest").alias("bucket"), "kind", "src", F.col("payload").alias("state")), kept


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the ascending ``values``, whether it is there) of every wanted one; place 0 where it is not."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    there = values[at] == wanted
    return np.where(there, at, 0), there


def _take(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return x[at] if len(x) else np.zeros(len(at), np.int64)


def score(docs: DataFrame, state: DataFrame, kept: list[dict], keep: list[str] | None = None,
          text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` plus n_tokens, n_known, log_counts (sum of log10(count + 0.5)) and score (log10 of
    the text's averaged predictive probability)."""
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text"))
    fixed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    sent = docs.sparkSession.sparkContext.broadcast(kept)
    buckets = buckets_of(docs)

    def send(blocks):
        _, words, _, pair_word, pair_context, _ = _chunk_pairs(blocks, "__text")
        for b, s, p in _cut(words, pair_word, buckets):
            yield b, pack(*_asked(words, pair_word, pair_context, s, p))

    def answer(payloads, known):
        """Per word its customers, those of its restaurant, and of each sample customers and tables in the parent and tables of
        its restaurant; per pair its customers; per pair of several customers its tables of each sample."""
        none = np.empty(0, np.int64)
        words, count, size, pairs, c, samples = none.astype(np.uint64), none, none, none, none, [[none] * 4] * len(sent.value)
        if known is not None:
            (_, packed), = _of(known, PAIRS, "state")
            pairs, c = np.cumsum(packed[0]), packed[1].astype(np.int64)
            (words, count, _, asks, *_), samples = _load(_of(known, WORDS, "state")[0][1])
            samples[-1].append(_answered(words, asks, _of(known, TABLES, "state"))[1])
            own = np.unique(words >> U64(64 - HASH_BITS), return_inverse=True)[1]
            size = np.bincount(own, weights=count).astype(np.int64)[own]  # words of equal hash share a restaurant
        many = np.cumsum(c > 1) - 1
        out = []
        for p in payloads:
            asked, word, context = _told(unpack(p))
            at, there = _find(words, asked)
            key = (at[word] << HASH_BITS) | context
            pair, seen = _find(pairs, key)
            seen &= there[word]
            customers = np.where(seen, _take(c, pair), 0)
            several = many[pair[customers > 1]]
            out.append(pack(*[_small(np.where(there, _take(x, at), 0)) for x in
                              (count, size, *[x for s in samples for x in s[1:]])],
                            _small(customers), *[_small(s[0][several]) for s in samples]))
        return out

    def finish(blocks, replies):
        parts, words, word, pair_word, pair_context, pair = _chunk_pairs(blocks, "__text")
        n = len(sent.value)
        per_word = np.zeros((2 + 3 * n, len(words)), np.int64)
        prob = np.zeros(len(pair_word))  # at first what the pair's own customers add, over all samples
        for b, s, p in _cut(words, pair_word, buckets):
            got = unpack(replies[b])
            for i in range(len(per_word)):
                per_word[i, s] = got[i]
            c = got[len(per_word)]
            prob[p] = n * c.astype(np.float64)
            for i, totals in enumerate(sent.value):
                tables = (c > 0).astype(np.float64)
                tables[c > 1] = got[len(per_word) + 1 + i]
                prob[p] -= totals["discount"] * tables
        count, size = per_word[:2]
        for i, totals in enumerate(sent.value):
            m, k, restaurant = per_word[2 + 3 * i:5 + 3 * i]
            up = np.where(count > 0, parent(m, k, totals, known=True), parent(np.zeros(1), np.zeros(1), totals, known=False))
            prob += (STRENGTH + totals["discount"] * restaurant)[pair_context] * up[pair_word]
        prob /= (STRENGTH + size)[pair_context]
        logp, log_count = np.log10(prob / n)[pair], np.log10(count + 0.5)[word]
        is_known = (count > 0)[word]
        begin = 0
        for b, text in parts:
            own = slice(begin, begin + len(text))
            begin += len(text)
            per = lambda x: np.bincount(text, weights=x[own], minlength=b.num_rows)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(np.bincount(text, minlength=b.num_rows).astype(np.int64)),
                 pa.array(per(is_known).astype(np.int64)), pa.array(per(log_count)), pa.array(per(logp))],
                names=[*b.schema.names[:len(keep)], "n_tokens", "n_known", "log_counts", "score"])

    out = round_trip(src, "__text", send, answer, finish, f"{fixed}, n_tokens bigint, n_known bigint, "
                     "log_counts double, score double", state=state)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", "log_counts",
                      "score")


def op4_lm_scoring(docs: DataFrame) -> DataFrame:
    out = held_out(5, 1)
    state, kept = train(docs.filter(~out))
    n, v = kept[-1]["N"], kept[-1]["V"]
    scored = score(docs.withColumn("__held", out), state, kept, ["doc_id", "__held"])
    return scored.select(
        "doc_id", F.col("__held").alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
