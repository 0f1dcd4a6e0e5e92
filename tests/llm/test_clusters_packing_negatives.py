"""Centroid clustering, packing and hard negatives against brute force, with odd rows and clashing column names."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, q string, id string, slot string, v int"


def vector_rows(n, dims=64, seed=5, hot=0):
    """Random vectors with many ties, repeated rows, a vector that fills ``hot`` rows, and rows that take no part."""
    rnd = np.random.default_rng(seed)
    pool = np.round(rnd.normal(0, 0.3, (n, dims)), 1)
    rows = [(i, [float(x) for x in pool[i if i % 5 else 0]], int(rnd.integers(0, 10)), "a", "b", "c", "d", 1) for i in range(n)]
    rows += [(n + i, [float(x) for x in pool[1]], i % 3, "a", None, "c", "d", 1) for i in range(hot)]
    rows += [rows[7], rows[7], rows[min(n - 1, 100)]]
    pad = ("x", "y", "z", "w", None)
    bad = [(900_001, None, 1), (900_002, [], 1), (900_003, [1.0] * (dims - 1), 1), (900_004, [1.0] * (dims - 1) + [None], 2),
           (900_005, [float("nan")] * dims, 3), (900_006, [float("inf")] + [0.0] * (dims - 1), 3), (900_007, [0.5] * (dims + 1), 4)]
    return rows + [b + pad for b in bad]


def integers(v, scale):
    return np.floor(np.array(v, dtype=np.float32).astype(np.float64) * scale).astype(np.int64)


# 11 ---------------------------------------------------------------------------------------------------------------
def plain_clusters(rows, k, rounds, scale=1024, dims=64):
    kept = [(i, integers(v, scale)) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [q for _, q in order[:k]]
    q = np.array([v for _, v in kept]).reshape(len(kept), dims)

    def assign():
        d = np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        best, _ = assign()
        for c in range(len(centroids)):
            if (best == c).any():
                centroids[c] = np.array([int(s) // int((best == c).sum()) for s in q[best == c].sum(axis=0)])
    best, far = assign()
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return sorted((-1 if kept[i][0] is None else kept[i][0], int(best[i]), int(far[i]), int(far[best == best[i]].sum()), int(far.sum()), sha[best[i]])
                  for i in range(len(kept)))


@pytest.mark.parametrize("n, hot", [(300, 150), (40, 0), (5, 0)])
def test_clusters_equal_brute_force(make, n, hot):
    from recsuite.llm.clusters import op11_centroids
    rows = vector_rows(n if n > 10 else 11, hot=hot)
    if n <= 10:
        rows = rows[:n] + rows[-7:]
    rows += [(None, rows[1][1], None, "a", "b", "c", "d", 2)]
    got = op11_centroids(make(rows, VECTORS, 4))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain_clusters(rows, 8, 10)


def test_clusters_of_nothing(make):
    from recsuite.llm.clusters import op11_centroids
    assert op11_centroids(make([], VECTORS)).count() == 0
    assert op11_centroids(make(vector_rows(11)[-7:], VECTORS)).count() == 0


@pytest.mark.parametrize("pivots", [1, 2, 6, 30])
def test_simplex_bounds_hold_and_filter(pivots):
    from recsuite.llm.clusters import Simplex, nearest, squared
    rnd = np.random.default_rng(pivots)
    groups = rnd.normal(0, 500, (12, 16))
    q = np.floor(groups[rnd.integers(0, 12, 600)] + rnd.normal(0, 30, (600, 16))).astype(np.int64)
    q[50:60] = q[0]                      # equal to a pivot
    centroids = np.floor(groups[:8]).astype(np.int64)
    simplex = Simplex(np.vstack([q[:pivots], q[:1]]))   # the last pivot lies in the others' plane
    assert len(simplex.pivots) <= min(pivots, 17)
    low, high = simplex.bounds(simplex.distances(q), simplex.distances(centroids))
    true = np.stack([squared(q, c) for c in centroids], axis=1)
    assert (low <= true).all() and (true <= high).all()
    best, far, made = nearest(q, simplex.distances(q), centroids, simplex, exact=True)
    assert (best == true.argmin(axis=1)).all() and (far == true.min(axis=1)).all()
    if pivots == 30:
        assert made < 0.6 * true.size


def test_clusters_leave_no_scratch(spark, make):
    import os

    from recsuite.llm.clusters import op11_centroids
    from recsuite.session import ensure_checkpoint_dir
    rows = make(vector_rows(40), VECTORS)
    op11_centroids(rows).count()
    root = ensure_checkpoint_dir(spark).removeprefix("file://")
    assert not [f for f in os.listdir(root) if f.startswith("clusters-")]


# 13 ---------------------------------------------------------------------------------------------------------------
def plain_negatives(rows, scale=256, positives=5, negatives=10):
    kept = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(integers(v, scale).tolist())) for i, v, label, *_ in rows
            if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, q in kept:
        if i % 100:
            continue
        score = {(same, r, sum(x * y for x, y in zip(q, p))) for r, l, p in kept if r != i and len(p) == len(q)
                 for same in [l == label]}
        by = lambda s: sorted((x[1:] for x in score if x[0] == s), key=lambda x: (-x[1], x[0]))
        for p, ps in by(True)[:positives]:
            window = [(n, ns) for n, ns in by(False) if 30 * ps <= 100 * ns <= 90 * ps][:negatives]
            out += [(i, p, k + 1, n, ps, ns) for k, (n, ns) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [1, 3])
def test_negatives_equal_brute_force(make, blocks):
    from pyspark.sql import functions as F

    from recsuite.llm import negatives as N
    rows = vector_rows(420, dims=12, hot=200)
    rows += [(100 * i, [0.4] * 12, i % 10, "a", "b", "c", "d", 1) for i in range(3)]      # a second anchor of the same id
    rows += [(None, [0.4] * 12, 1, "a", "b", "c", "d", 1), (200, [0.4] * 12, None, "a", "b", "c", "d", 1),
             (300, [0.4] * 9, 2, "a", "b", "c", "d", 1), (301, [0.4] * 9, 2, "a", "b", "c", "d", 1),
             (302, [0.2] * 9, 3, "a", "b", "c", "d", 1)]
    table = make(rows, VECTORS, 5)
    if blocks == 1:
        got = N.op13_hard_negatives(table)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert dict(got.dtypes)["rank"] == "int"
    else:
        label = F.col("label").cast("bigint")
        plain = table.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
                             .alias("label"), F.col("embedding").alias("v"))
        got = N.mine(plain, plain.filter("id % 100 = 0"), block_anchors=5)
    expected = plain_negatives(rows)
    assert len(expected) > 100 and sorted(tuple(r) for r in got.collect()) == expected


def test_negatives_of_nothing(make):
    from recsuite.llm.negatives import op13_hard_negatives
    assert op13_hard_negatives(make([], VECTORS)).count() == 0
    assert op13_hard_negatives(make(vector_rows(11)[1:9], VECTORS)).count() == 0  # no anchor


def test_best_keeps_distinct_entries():
    from recsuite.llm.negatives import Best
    rnd = np.random.default_rng(2)
    best, seen = Best(4, 3), [set() for _ in range(4)]
    for _ in range(30):
        n = int(rnd.integers(0, 40))
        g, s, i = rnd.integers(0, 4, n), rnd.integers(-5, 6, n), rnd.integers(0, 9, n)
        best.offer(g, s, i)
        for a, b, c in zip(g, s, i):
            seen[a].add((-int(b), int(c)))
    group, score, ids = best.entries()
    for a in range(4):
        assert [(-s, i) for s, i in zip(score[group == a].tolist(), ids[group == a].tolist())] == sorted(seen[a])[:3]


def test_products_are_exact_beyond_floating_point():
    from recsuite.llm.negatives import products
    a = np.array([[2**27 + 1, 3]], dtype=np.int64)
    assert products(a, a).tolist() == [[(2**27 + 1) ** 2 + 9]]
    with pytest.raises(ValueError):
        products(a << 3, a)


# 12 ---------------------------------------------------------------------------------------------------------------
DOCS = "doc_id bigint, text string, offset string, length int, `start.at` string"


def packed(df):
    """Rows by sequence, after the rules that hold for every packing."""
    by = defaultdict(list)
    for r in df.collect():
        by[r.sequence_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert all(r.length > 0 for r in rows)
    return by


def test_packing_equals_the_library(make, odd_texts):
    from tokenizers import Tokenizer

    from recsuite.llm.entry import byte_tokenizer
    from recsuite.llm.packing import op12_packing
    tok = Tokenizer.from_file(byte_tokenizer())
    texts = [*odd_texts, "a <|endoftext|> b", " " * 300_000 + "x", "de la " * 30_000, *["same words here"] * 400, "1"]
    texts += [f"{i} " * (i % 700) for i in range(300)]
    docs = make([(i, t, "o", i, "s") for i, t in enumerate(texts)] + [(None, "no id", "o", 1, "s"), (3, "again", "o", 1, "s")], DOCS, 4)
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in enumerate(texts)}
    got = op12_packing(docs, byte_tokenizer)
    sequences = packed(got)
    pieces = defaultdict(list)
    for rows in sequences.values():
        fill = sum(r.length for r in rows)
        assert fill == 2048 or fill & (fill - 1) == 0 and fill < 2048
        assert len(rows) <= 256
        for r in rows:
            pieces[r.doc_id].append(r)
    assert set(pieces) == {*ids, None}
    for i, rows in pieces.items():
        rows.sort(key=lambda r: r.start)
        if i in (None, 3):
            continue
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) == len(ids[i]) == rows[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[i][r.start:r.start + r.length].tobytes()) for r in rows)
    assert sum(r.doc_tokens for r in pieces[3] if r.start == 0) == len(ids[3]) + len(tok.encode("again").ids) + 1
    short = [s for s in sequences.values() if sum(r.length for r in s) < 2048]
    assert len(short) <= 4 * 11 + len(texts) / 256 + 1
    assert op12_packing(docs.limit(0), byte_tokenizer).count() == 0


def test_packing_of_examples_keeps_them_whole(make):
    from recsuite.llm.packing import Limits, pack_examples
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(500):
        n = int(rnd.integers(1, 90))
        rows.append((i, [int(x) for x in rnd.integers(0, 9, n)], [bool(x) for x in rnd.random(n) < rnd.random()] if i % 4 else None, "x"))
    rows += [(500, None, None, "x"), (501, [], [], "x"), (502, list(range(300)), None, "x")]
    df = make(rows, "k bigint, ids array<bigint>, loss array<boolean>, start string", 2)
    limits = Limits(tokens=128, segments=3, loss=60)
    got = packed(pack_examples(df, ["k"], limits=limits))
    loss = {r[0]: r[2] if r[2] is not None else [True] * len(r[1] or []) for r in rows}
    seen = defaultdict(list)
    for s in got.values():
        assert sum(r.length for r in s) <= 128 and len(s) <= 3
        assert sum(sum(loss[r.k][r.start:r.start + r.length]) for r in s) <= 60
        for r in s:
            seen[r.k].append(r)
            assert r.ids == rows[r.k][1][r.start:r.start + r.length]
    assert set(seen) == {*range(500), 502}
    fits = [i for i in seen if len(rows[i][1]) <= 128 and sum(loss[i]) <= 60]
    assert all(len(seen[i]) == 1 for i in fits) and len(fits) > 400
    for i, pieces in seen.items():
        assert sorted(x for r in pieces for x in range(r.start, r.start + r.length)) == list(range(len(rows[i][1])))


def test_packer_equals_the_plain_heuristic():
    """The classes change nothing: each place goes to the best waiting example."""
    from recsuite.llm.packing import Limits, Packer, Piece
    rnd = np.random.default_rng(9)
    limits = Limits(100, 4, 50)
    sizes = [(int(n), int(rnd.integers(0, min(n, 50) + 1))) for n in rnd.integers(1, 60, 120)]
    packer = Packer(limits, cut=False)
    for i, (n, loss) in enumerate(sizes):
        assert not list(packer.add(Piece(i, 0, np.arange(n), np.minimum(np.arange(n + 1), loss))))
    got = [[sizes[p.example] for p in s] for s in packer.pack()]

    waiting, expected = list(sizes), []
    weight = np.mean([[n, 1, loss] for n, loss in waiting], axis=0) / limits
    while waiting:
        left, own = np.array(limits, dtype=float), []
        while True:
            fit = [d for d in waiting if d[0] <= left[0] and left[1] >= 1 and d[1] <= left[2]]
            if not fit:
                break
            score = lambda d: float(np.dot([d[0], 1, d[1]], weight * left / limits / limits))
            best = max(fit, key=lambda d: (round(score(d), 12), d[0], d[1]))
            waiting.remove(best)
            own.append(best)
            left -= (best[0], 1, best[1])
        expected.append(own)
    assert got == expected
    assert sum(n for n, _ in sizes) / (len(got) * 100) > 0.8 or sum(x for _, x in sizes) / (len(got) * 50) > 0.8


def test_tokenizer_equals_the_library_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from recsuite.llm.entry import byte_tokenizer
    from recsuite.llm.packing import ranks_agree, tokenizer
    path = byte_tokenizer()
    assert ranks_agree(path)
    mine, library = tokenizer(path, True), Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text() | st.text(alphabet="ab 's\n\t<|endoftext|>1é日️"))
    def same(text):
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids

    same()
    long = "x" * 200_000 + " " * 1_500_000 + "é\n"
    assert mine.encode(long).tolist() == library.encode(long, add_special_tokens=False).ids
