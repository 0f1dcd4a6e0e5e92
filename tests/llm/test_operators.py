"""Every operator against a brute-force version on small tables, and its defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text))


@pytest.fixture(scope="module")
def odd(make, odd_texts):
    rows = [row(i, t) for i, t in enumerate(odd_texts)] + [row(None, "no id"), row(3, "word"), (50, "x", None, None, None)]
    return make(rows, DOCS)


@pytest.fixture(scope="module")
def empty(make):
    return make([], DOCS)


@pytest.fixture(scope="module")
def corpus(make):
    """Invented documents with exact copies, near copies, shared passages and a chain of edits."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefgh é", k=rnd.randrange(1, 7))).strip() or "q" for _ in range(300)]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    passage = say(40)
    texts = [say(rnd.randrange(1, 160)) for _ in range(60)]
    texts += [texts[5]] * 12 + [texts[6].upper()] * 2
    base = say(120).split()
    for i in range(40):  # near copies, each with its own edit
        w = list(base)
        w[rnd.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    chain = say(200).split()
    for i in range(30):  # neighbours are alike, the ends are not
        chain[5 * i:5 * i + 3] = [f"c{i}a", f"c{i}b", f"c{i}c"]
        texts.append(" ".join(chain))
    texts += [f"{say(10)}\n{passage}\n{say(12)}" for _ in range(25)]
    rnd.shuffle(texts)
    return make([row(7 * i + 3, t, ["en", "de"][i % 2]) for i, t in enumerate(texts)], DOCS, 4)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 ----------------------------------------------------------------------------------------------------------------
PROSE = "The people of the town said that it was the best of all the days they had seen and that more would come. "


def test_html_keeps_the_article_only():
    from recsuite.llm.html_extract import extract
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header>
      <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">{PROSE}</div>
      <aside>{PROSE}</aside><article><h1>Head &amp; line</h1><p>{PROSE}<b>bold</b><br>more&nbsp;text<p>Short.
      <script>var a = "</p>";</script><p>wxyz | wxyzz | wxyzzz | wxyzzzz | wxyzzzzz | wxyzzzzzz | wxyzzzzzzz | wxyzzzz</article>
      <div id="comments"><p>{PROSE}</p></div><form><p>{PROSE}</p></form><footer>&copy; {PROSE}</footer><!-- {PROSE} --></body>"""
    got = extract(page)
    assert got == ("Head & line " + PROSE + "bold more text Short. wxyz | wxyzz | wxyzzz | wxyzzzz | wxyzzzzz | wxyzzzzzz"
                   " | wxyzzzzzzz | wxyzzzz")


def test_html_without_article_uses_density_and_neighbours():
    from recsuite.llm.html_extract import extract
    links = "<ul>" + "".join(f"<li><a href=/{i}>Some longer link number {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"<body>{links}<p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p>{links}<p>© 2020</p></body>"
    assert extract(page) == f"{PROSE}Short one. {PROSE}".strip()


def test_html_odd_pages(spark, make):
    from recsuite.llm.html_extract import op1_html_extraction
    cases = {1: None, 2: "", 3: "<p", 4: "<!-- open", 5: "plain &lt;text&gt; only", 6: "<script>x", 7: "a < b",
             8: "<article><p>" + "the of and " * 40000}
    pages = make([(i, "u", h) for i, h in cases.items()] + [(9, None, None), (9, None, None)],
                 "page_id bigint, url string, html string")
    got = {r.page_id: r for r in op1_html_extraction(pages).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, 6, 9)] == [""] * 6
    assert got[5].text == "plain <text> only" and got[7].text == "a < b"
    assert got[8].n_chars == len("the of and " * 40000) - 1 and op1_html_extraction(pages).count() == 10
    assert op1_html_extraction(pages.limit(0)).count() == 0


# 2 ----------------------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(corpus, odd, empty):
    from tokenizers import Tokenizer

    from recsuite.llm.bpe import op2_bpe
    from recsuite.llm.entry import word_tokenizer
    tok = Tokenizer.from_file(word_tokenizer())
    for df in (corpus, odd):
        expected = Counter()
        for i, t in texts_of(df):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            decoded = tok.decode(ids, skip_special_tokens=False)
            expected[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256(decoded.encode()).hexdigest())] += 1
        assert Counter(map(tuple, op2_bpe(df, word_tokenizer()).collect())) == expected
    assert op2_bpe(empty, word_tokenizer()).count() == 0


def test_bpe_splitter_equals_the_library_on_any_text():
    from tokenizers import Tokenizer

    from recsuite.llm.bpe import Splitter
    from recsuite.llm.entry import word_tokenizer
    split, tok = Splitter(word_tokenizer()), Tokenizer.from_file(word_tokenizer())
    rnd = random.Random(3)
    pool = [chr(c) for c in range(1, 0x400)] + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", " ", "é", "가",
                                                "가", " ", "​", "🙂", "ﬁ", "½", "İ", "　"]
    for _ in range(4000):
        t = "".join(rnd.choices(pool, k=rnd.randrange(30)))
        got = [i for x in split.encode_words(split.words(t)) for i in x] if split.words(t) else []
        assert got == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_decode_drops_unknown_ids(spark):
    from recsuite.llm.bpe import decode
    from recsuite.llm.entry import word_tokenizer
    df = spark.createDataFrame([(1, [320, 99999999, -1, 49407]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode(df, word_tokenizer()).collect()}
    assert got[1].endswith(" <|endoftext|>") and got[1].count(" ") == 1 and got[2] == got[3] == ""


# 3 ----------------------------------------------------------------------------------------------------------------
def test_top_k_equals_brute_force(make):
    from recsuite.llm.topk import op3_top_k
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 64))
    v[50:200] = v[7]  # one very common vector
    v[200:260] = v[8] + rng.normal(size=(60, 64)) * 0.3
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(None, v[0].tolist(), 0), (1000, None, 0), (1020, [], 0), (1040, [None] * 64, 0), (20, v[20].tolist(), 0)]
    df = make(rows, "vec_id bigint, embedding array<double>, label int")
    code = np.packbits(v > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    got = defaultdict(list)
    for r in op3_top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    assert set(got) == {i for i in range(400) if i % 20 == 0}
    for q, found in got.items():
        d = np.bitwise_count(code ^ code[q])
        assert found == [(int(d[j]), int(j)) for j in np.lexsort((np.arange(400), d)) if j != q][:10]
    few = op3_top_k(make(rows[:4], "vec_id bigint, embedding array<double>, label int")).collect()
    assert len(few) == 3
    assert op3_top_k(df.limit(0)).count() == 0


# 4 ----------------------------------------------------------------------------------------------------------------
def brute_base(pairs):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in pairs if not out(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    return Counter((i, out(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n,
                    round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 6))
                   for i, t in pairs)


def test_lm_counts_equal_brute_force_and_model_beats_them(corpus, odd, empty):
    from recsuite.llm.pylm import op4_lm_scoring
    for df in (corpus, odd):
        got = op4_lm_scoring(df).collect()
        mine = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
        assert mine == brute_base(texts_of(df))
        assert all(r.score < 0 for r in got)
        held = [r for r in got if r.held_out]
        if df is corpus:
            assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert op4_lm_scoring(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    from recsuite.llm import pylm
    rng = np.random.default_rng(0)
    key = np.unique((rng.integers(1, 60, 400).astype(np.uint64) << np.uint64(40 + pylm.CONTEXT_BITS - 7))
                    | rng.integers(0, 5, 400).astype(np.uint64))
    first, word = pylm._word_of(key)
    c = rng.integers(1, 30, len(key))
    t = np.ones(len(key), np.int64)
    m, k = np.diff(np.append(first, len(key))), np.ones(len(first), np.int64)
    sizes = upper = np.empty(0, np.int64)
    context = (key & np.uint64(127)).astype(int)
    for step in range(5):
        totals = {"V": len(m), "M": m.sum(), "K": k.sum(), "discount": 0.6, "parent_discount": 0.4,
                  "base": 0.5 / len(m), "unknown": 0.5}
        tables = np.bincount(context, weights=t, minlength=128)
        t, sizes, m, k, upper = pylm.sweep_words(key, c, t, sizes, m, k, upper, tables, totals, 3, rng)
        many = c > 1
        assert (t >= 1).all() and (t <= c).all() and sizes.sum() == c[many].sum() and len(sizes) == t[many].sum()
        assert (m == np.bincount(word, weights=t)).all() and upper.sum() == m.sum() and len(upper) == k.sum()
    totals |= {"M": m.sum(), "K": k.sum()}
    up = pylm.parent(m, k, totals, True)
    unknown = pylm.parent(np.zeros(1), np.zeros(1), totals, False)[0]
    assert abs(up.sum() + unknown - 1) < 1e-9
    tables, size = np.bincount(context, weights=t), np.bincount(context, weights=c)
    for x in range(5):
        own = (c - 0.6 * t)[context == x].sum()
        assert abs((own + (1 + 0.6 * tables[x]) * (up.sum() + unknown)) / (1 + size[x]) - 1) < 1e-9


# 5 ----------------------------------------------------------------------------------------------------------------
def brute_components(pairs):
    sets, parent_of = [], {}
    for i, t in pairs:
        w = words(t)
        sets.append(frozenset(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        parent_of[i] = i

    def root(i):
        while parent_of[i] != i:
            i = parent_of[i]
        return i
    for x, (i, _) in enumerate(pairs):
        for y in range(x):
            j = pairs[y][0]
            if None not in (i, j) and sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((root(i), root(j)))
                parent_of[b] = a
    return Counter((i, len(s), root(i), i is None or root(i) == i) for (i, _), s in zip(pairs, sets))


@pytest.mark.parametrize("short_list", [16, 2])
def test_near_duplicates_equal_brute_force(corpus, odd, empty, short_list):
    from recsuite.llm.neardup import near_duplicates
    for df in (corpus, odd):
        assert Counter(map(tuple, near_duplicates(df, short_list=short_list).collect())) == brute_components(texts_of(df))
    assert near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    from recsuite.llm.components import components
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {2000: 2000, 2001: 2000}


# 6 ----------------------------------------------------------------------------------------------------------------
def test_language_id(spark, odd, empty):
    from recsuite.llm.langid import op6_language_id
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op6_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows} == {True}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    got = op6_language_id(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} <= {"en", "und"}
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert op6_language_id(empty).count() == 0


# 7 ----------------------------------------------------------------------------------------------------------------
def test_license_scan_equals_brute_force(make, odd, empty):
    from recsuite.llm import license
    mit = license.TEMPLATES["MIT"]
    texts = [f"intro\n\n{mit}\n\nend", mit.replace("software", "programme"), "Released under the MIT Licence",
             "x\nAll rights reserved.\ny", "all rights", "Licensed under CC BY-NC 4.0.", mit.upper().replace("\n", " ")]
    df = make([row(i, t) for i, t in enumerate(texts)], DOCS)
    got = defaultdict(dict)
    for r in license.op7_license_scan(df).collect():
        got[r.doc_id][r.template] = r.dice
    for i, t in enumerate(texts):
        expected = {}
        for name, template in license.TEMPLATES.items():
            b = license.bigrams(license.words(template))
            best = max((2 * len(license.bigrams(w) & b) / (len(license.bigrams(w)) + len(b))
                        for *_, p in license.pieces(t) if (w := license.words(p))), default=0)
            if best >= license.THRESHOLD:
                expected[name] = best
        assert got[i] == expected, i
    assert got[0]["MIT"] == 1.0 and "MIT" in got[6] and not got[4]
    assert license.op7_license_scan(odd).count() == 0 and license.op7_license_scan(empty).count() == 0


# 8 ----------------------------------------------------------------------------------------------------------------
def test_decontamination_equals_brute_force(make, odd, empty):
    from recsuite.llm import decontam as d
    rnd = random.Random(4)
    say = lambda n: " ".join("".join(rnd.choices("abcdeé", k=4)) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([20, 35, 50, 12, 5, 3, 40])] + [(90, None), (91, ""), (None, "x y")]
    bench = make(items, "item_id bigint, text string")
    cut = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    edited = items[2][1].split()
    edited[1] = "changed"
    texts = [f"{say(30)} {items[0][1].upper()}! {say(9)}", f"{say(3)}\n{items[1][1].replace(' ', ', ')}",
             f"{say(8)} {' '.join(edited)} {say(8)}", cut(6, 0, 20), f"{cut(6, 0, 38)} {say(5)}", items[4][1], items[5][1],
             f"{say(2)} {items[5][1]}", f"{items[3][1]} {items[3][1]}", say(200), None, "", f"{items[4][1]} {say(50)}"]
    docs = make([row(i, t) for i, t in enumerate(texts)], DOCS)
    weights = d._weights([x for x in items if None not in x], d.SHINGLE)
    import pyarrow as pa
    shingles = lambda w: Counter(d._shingles(w, d.SHINGLE).tolist())
    expected = {}
    for i, t in enumerate(texts):
        w, _ = d.word_hashes(pa.array([t or ""], pa.large_string()))
        for j, item in items:
            v, _ = d.word_hashes(pa.array([item or ""], pa.large_string()))
            if not len(v) or j is None or len(v) < d.SHINGLE and len(v) != len(w):
                continue
            best = 0.0
            for s in range(len(w) - len(v) + 1):
                a, b = shingles(w[s:s + len(v)]), shingles(v)
                weigh = lambda c: sum(weights.get(h, weights[None]) * n for h, n in c.items())
                best = max(best, weigh(a & b) / weigh(a | b))
            if best >= d.THRESHOLD:
                expected[(i, j)] = round(best, 9)
    for size in (d.BLOCK_ITEMS, 2):
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in d.contaminated(docs, bench, max_items=size).collect()}
        if size == d.BLOCK_ITEMS:
            assert got == expected
        assert set(got) >= {(0, 0), (1, 1), (5, 4), (6, 5), (8, 3), (12, 4)} and not {k for k in got if k[0] in (9, 10, 11)}
    assert d.op8_decontamination(odd, bench).count() == 0 and d.op8_decontamination(empty, bench).count() == 0
    assert d.op8_decontamination(docs, bench.limit(0)).count() == 0


# 9 ----------------------------------------------------------------------------------------------------------------
def brute_repeats(pairs, span=50):
    first = {}
    for i, t in pairs:
        raw = (t or "").encode()
        for p in range(len(raw) - span + 1) if i is not None else ():
            s = raw[p:p + span]
            first[s] = min(i, first.get(s, i))
    out = Counter()
    for i, t in pairs:
        raw = (t or "").encode()
        covered = set()
        for p in range(len(raw) - span + 1) if i is not None else ():
            if first[raw[p:p + span]] < i:
                covered.update(range(p, p + span))
        kept = bytes(b for p, b in enumerate(raw) if p not in covered)
        runs = sum(p in covered and p - 1 not in covered for p in range(len(raw)))
        out[(i, len(raw), len(covered), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffix_dedup_equals_brute_force(corpus, odd, empty, make):
    from recsuite.llm.suffix import op9_suffix_dedup
    rnd = random.Random(8)
    bits = ["".join(rnd.choices("ab", k=rnd.randrange(30, 140))) for _ in range(12)]
    tricky = ["".join(rnd.choices(bits, k=rnd.randrange(1, 5))) for _ in range(60)] + ["a" * n for n in (49, 50, 51, 400)]
    tight = make([row(rnd.randrange(50), t) for t in tricky], DOCS)
    for df in (corpus, odd, tight):
        assert Counter(map(tuple, op9_suffix_dedup(df).collect())) == brute_repeats(texts_of(df))
    assert op9_suffix_dedup(empty).count() == 0


# 10 ---------------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark, odd, empty, make):
    from recsuite.llm.quality import op10_quality
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = op10_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    for few in (labels, labels.limit(0), make([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")):
        got = op10_quality(odd, few).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert op10_quality(empty, labels).count() == 0


def test_flat_trees_equal_a_walk():
    from recsuite.llm.quality import fit, predict
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = fit(x, y, trees=12, depth=3)
    raw = np.full(len(x), m["start"][0])
    for f, c, leaf in zip(m["feature"], m["cut"], m["leaf"]):
        for r in range(len(x)):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[r, f[node]] > c[node])
            raw[r] += leaf[node - len(f)]
    assert np.allclose(predict(m, x), 1 / (1 + np.exp(-raw))) and ((predict(m, x) > 0.5) == y).mean() > 0.9


# pipeline ---------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, odd, corpus, empty):
    import corpus_pipeline as p
    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "suffix_dedup", "decontamination", "bpe"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        for df in (odd, corpus, empty):
            assert stage(spark, df, sf).columns == df.columns
    kept = {r.doc_id for r in p.near_duplicates(spark, corpus, sf).collect()}
    assert kept == {i for i, _, root, keep in brute_components(texts_of(corpus)) if keep}
    cut = {r.doc_id: r for r in p.suffix_dedup(spark, corpus, sf).collect()}
    for i, n, removed, *_ in brute_repeats(texts_of(corpus)):
        if removed == 0:
            assert len(cut[i].text.encode()) == n
    assert all(r.n_chars == len(r.text) for r in cut.values())
    out = p.run(spark, sf)
    assert 0 < out.count() <= docs.count() and {"doc_id", "ids", "decoded"} <= set(out.columns)


def test_extra_columns_with_clashing_names(make):
    from pyspark.sql import functions as F

    import corpus_pipeline as p
    from recsuite.llm import entry
    docs = make([row(i, f"the house number {i} of the street and the town " * 4) for i in range(12)], DOCS)
    names = ["score", "rejected", "lang_pred", "n", "kept", "spans", "ids", "set_a", "__text", "rep", "v", "stats", "held_out"]
    wide = docs.withColumns({c: F.lit(1) for c in names})
    for name, stage in p.STAGES[:-1]:
        assert stage(docs.sparkSession, wide, "/root/testdata/sf0.001").columns == wide.columns, name
    from recsuite.llm import bpe, langid, license, neardup, pylm, suffix
    for op in (langid.op6_language_id, neardup.op5_near_duplicates, suffix.op9_suffix_dedup, license.op7_license_scan,
               pylm.op4_lm_scoring, lambda d: bpe.op2_bpe(d, entry.word_tokenizer())):
        assert sorted(map(str, op(wide).collect())) == sorted(map(str, op(docs).collect()))
