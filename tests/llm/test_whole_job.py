"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text))


# 4 ----------------------------------------------------------------------------------------------------------------
def plain_tables(c, weight, d, rounds, rng):
    """Numbers of tables while single customers leave and sit down again."""
    tables, found = [c], []
    for step in range(rounds * c):
        at = rng.choice(len(tables), p=np.array(tables) / c)
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
        p = np.array([*[n - d for n in tables], weight])
        to = rng.choice(len(p), p=p / p.sum())
        if to == len(tables):
            tables.append(0)
        tables[to] += 1
        if step > 20 * c:
            found.append(len(tables))
    return np.array(found)


@pytest.mark.parametrize("exact", [1024, 16])
def test_lm_tables_equal_a_plain_sampler(exact, monkeypatch):
    from recsuite.llm import pylm
    monkeypatch.setattr(pylm, "EXACT", exact)  # the table of the law, and the integral beyond it
    rng = np.random.default_rng(5)
    for c, weight in ((40, 0.3), (60, 4.0), (25, 60.0)):
        plain = plain_tables(c, weight, 0.6, 700, rng)
        mine = pylm.draw_tables(np.full(20000, c), np.full(20000, weight), 0.6, rng)
        assert abs(plain.mean() - mine.mean()) < 0.15 * max(1, plain.std()), (c, weight)
        assert abs(plain.std() - mine.std()) < 0.15 * max(0.5, plain.std()), (c, weight)


def test_lm_hot_pairs_are_seated_anew():
    from recsuite.llm import pylm
    ways, n = pylm._log_ways(0.7), np.arange(1, 1001)
    rng = np.random.default_rng(6)
    for weight in (0.2, 50.0, 2000.0, 1e6):
        p = ways[1000, 1:1001] + n * np.log(weight)
        p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
        mean = (p * n).sum()
        mine = pylm._draw_many(np.full(3000, 1000), np.full(3000, weight), 0.7, rng)
        assert abs(mine.mean() - mean) < 0.1 * max(1.0, np.sqrt((p * n ** 2).sum() - mean ** 2)), weight
    # a million customers: Poisson(weight / discount) tables and one more, whatever the count before
    mine = pylm.draw_tables(np.full(300, 10 ** 9), np.full(300, 7.0), 0.7, rng)
    assert abs(mine.mean() - 11) < 1


# 7 ----------------------------------------------------------------------------------------------------------------
def test_license_in_its_usual_layout_inside_a_document():
    from recsuite.llm import license
    scanner = license.Scanner(license.TEMPLATES, license.THRESHOLD)
    mit = license.TEMPLATES["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("Software.\nTHE", "Software.\n\nTHE")
    assert mit.count("\n\n") == 2
    text = f"A tale of İzmir.\n\nIt goes on\n\n{mit}\n\nHere it ends."
    (name, dice, kind, start, length), = scanner.scan(text)
    assert (name, dice, kind) == ("MIT", 1.0, "window") and text[start:start + length + 1] == mit
    spelt = mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    text = f"x y {spelt} {'thus it goes ' * 50}"
    (name, dice, _, start, length), = scanner.scan(text)
    assert (name, dice) == ("MIT", 1.0) and text[start:start + length + 1] == spelt
    # mid-line, and not at all where a fifth of it is gone
    assert [m[0] for m in scanner.scan("page 3 | All rights reserved. | page 4")] == ["All rights reserved"]
    assert not scanner.scan("\n\n".join(["word", " ".join(license.TEMPLATES["MIT"].split()[:110]), "word"]))


def test_license_templates_are_whole():
    from recsuite.llm import license
    scanner = license.Scanner(license.TEMPLATES, license.THRESHOLD)
    for name, end in (("BSD-3-Clause", "POSSIBILITY OF SUCH DAMAGE."), ("GPL-3.0-or-later", "gnu.org/licenses/>.")):
        assert license.TEMPLATES[name].endswith(end)
        numbered = "Copyright (c) 2020, A Person\n\n" + license.TEMPLATES[name] + "\n\nfoo()\n"
        assert name in [m[0] for m in scanner.scan(numbered)]


def test_license_windows_equal_brute_force():
    import random

    from recsuite.llm import license
    rnd = random.Random(3)
    templates = {"a": " ".join(f"w{i % 17}" for i in range(30)), "b": "p q r s t u v w x y z"}
    scanner = license.Scanner(templates, 0.8)
    found = 0
    for _ in range(300):
        w = [v for _ in range(3) for v in [*rnd.choices("abc", k=rnd.randrange(3)), *rnd.choice(list(templates.values())).split()]
             if rnd.random() > 0.04]
        got = {name: dice for name, dice, *_ in scanner.windows(w)}
        for name, t in templates.items():
            other = license.bigrams(t.split())
            best = max(2 * len(g & other) / (len(g) + len(other)) for i in range(len(w) - 1)
                       for j in range(i + 2, min(len(w), i + scanner.longest[name] + 1) + 1)
                       for g in [license.bigrams(w[i:j])])
            assert abs(got.get(name, 0) - (best if best >= 0.8 else 0)) < 1e-9, (name, w)
            found += best >= 0.8
    assert found > 100


# 8 ----------------------------------------------------------------------------------------------------------------
def test_decontamination_finds_shortened_items_and_short_items(make):
    from recsuite.llm import decontam
    item = [f"word{i}" for i in range(40)]
    bench = make([(1, " ".join(item)), (2, "Short item, here"), (3, "one")], "item_id bigint, text string")
    texts = [" ".join(item[:38]), " ".join(item[:25]), "a short ITEM here and there", "short item", "here short item",
             "short", "item here", "short item here", "it is one", " ".join(item[1:])]
    docs = make([row(i, t) for i, t in enumerate(texts)], DOCS, 1)  # neighbours: no run crosses a text's end
    got = {(r.doc_id, r.item_id): (round(r.similarity, 3), r.first_word) for r in
           decontam.op8_decontamination(docs, bench).collect()}
    assert got == {(0, 1): (0.944, 0), (2, 2): (1.0, 1), (7, 2): (1.0, 0), (8, 3): (1.0, 2), (9, 1): (0.972, 0)}


def test_decontamination_does_not_depend_on_the_blocks(make):
    from recsuite.llm import decontam
    template = "please read the following story and answer the question below it"
    items = [(i, f"{template} " + " ".join(f"i{i}w{j}" for j in range(14))) for i in range(30)]
    bench = make(items, "item_id bigint, text string")
    texts = [f"so {t.replace(f'i{i}w{i % 14}', 'other')} end" for i, t in items[:15]] + \
        [" ".join(t.split()[4:]) + f" x{i} y z z" for i, t in items[15:]]
    docs = make([row(i, t) for i, t in enumerate(texts)], DOCS)
    one, two, seven = [{(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in
                        decontam.contaminated(docs, bench, max_items=n, threshold=0.5).collect()} for n in (1000, 2, 7)]
    assert one and one == two == seven


# 6 ----------------------------------------------------------------------------------------------------------------
def test_language_of_a_long_text_is_that_of_the_whole_text():
    import random

    from recsuite.llm import langid
    rnd = random.Random(8)

    def speaker(letters):
        vocabulary = ["".join(rnd.choices(letters, k=rnd.randrange(2, 9))) for _ in range(3000)]
        return lambda n: " ".join(rnd.choices(vocabulary, k=n))

    a, b = speaker("abcdefghijk"), speaker("hijklmnopqrst")
    comps = langid._compressors({"a": (1, a(20000).encode()[:langid.DICT_BYTES]), "b": (1, b(20000).encode()[:langid.DICT_BYTES])})
    text = a(25000) + " " + b(200000)
    assert len(text) > 1_200_000
    assert langid.classify(a(25000), comps)[0] == "a" and langid.classify(b(50), comps)[0] == "b"
    assert langid.classify(text, comps)[0] == "b"
    short = b(60)
    assert langid.classify(short, comps)[2] == langid.classify(short.upper(), comps)[2] > 0


# 3 ----------------------------------------------------------------------------------------------------------------
def test_top_k_does_not_cut_vectors(make):
    from recsuite.llm.topk import codes, op3_top_k
    schema = "vec_id bigint, embedding array<double>, label int"
    one = {r.id: r.code for r in codes(make([(1, [1.0] * 64, 0), (2, [-1.0, 1.0], 0)], schema)).collect()}
    assert one == {1: [-1], 2: [2]}
    two = {r.id: r.code for r in codes(make([(1, [1.0] * 65, 0), (2, [-1.0, 1.0], 0)], schema)).collect()}
    assert two == {1: [-1, 1], 2: [2, 0]}
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 150))
    v[60:90] = v[3] + rng.normal(size=(30, 150)) * 0.5
    v[90:, 64:] = v[5, 64:]                     # these differ in the first word alone
    got = {}
    for r in op3_top_k(make([(i, x.tolist(), 0) for i, x in enumerate(v)] + [(999, v[5, :70].tolist(), 0)], schema)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    ids, bits = [*range(120), 999], np.vstack([v > 0, np.append(v[5, :70] > 0, np.zeros(80, bool))])
    for q in range(0, 120, 20):
        d = (bits != bits[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        assert sorted(got[q]) == [(k + 1, int(d[j]), ids[j]) for k, j in enumerate(order)]


def _docs(make, texts, start=0):
    return make([(start + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_lm_contexts_are_words(make):
    """Words of the same last two bytes predict their own followers."""
    from recsuite.llm import pylm
    train = _docs(make, ["xab left one", "yab right two"] * 30)
    state, kept = pylm.train(train)
    got = [r.score for r in pylm.score(_docs(make, ["xab left one", "xab right two", "yab right two", "yab left one"]), state,
                                       kept).orderBy("doc_id").collect()]
    assert got[0] > got[1] + 0.5 and got[2] > got[3] + 0.5


def test_lm_score_equals_plain_model_of_the_kept_seatings(spark, make):
    """The scores are those of the kept tables, read out pair by pair, and every context's probabilities add up to 1."""
    import random
    from collections import Counter
    from math import log10

    from recsuite.llm import pylm
    rnd = random.Random(3)
    names = [f"w{i}" for i in range(40)]
    texts = [" ".join(names[int(40 * rnd.random() ** 3)] for _ in range(rnd.randrange(0, 40))) for _ in range(80)]
    state, kept = pylm.train(_docs(make, texts))
    state = state.localCheckpoint()
    end = int(pylm._END)
    hashes = {w: int(pylm.token_keys(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
              for w in [*names, "new"]}
    pairs = Counter()
    for t in texts:
        line = [hashes[w] for w in t.split()] + [end]
        pairs.update(zip(line, [end, *line]))
    samples = [{"t": {}, "m": {}, "k": {}, "T": {}} for _ in kept]
    seen = {}
    rows = state.collect()
    for b in {r.bucket for r in rows}:
        def arrays(kind):
            return [pylm.unpack(r.state) for r in sorted(rows, key=lambda r: r.src) if r.bucket == b and r.kind == kind]
        (packed,), ((own, count, _, asks, *_), found) = arrays(pylm.PAIRS), pylm._load(arrays(pylm.WORDS)[0])
        found[-1].append(pylm._answered(own, asks, [(0, a) for a in arrays(pylm.TABLES)])[1])
        code, c = np.cumsum(packed[0]), packed[1].astype(int)
        keys = [(int(own[x >> pylm.HASH_BITS]), int(x & pylm._HASH)) for x in code]
        seen |= dict(zip(keys, c.tolist()))
        for s, (t, m, k, tables) in zip(samples, found):
            several = iter(t.tolist())
            s["t"] |= {key: next(several) if n > 1 else 1 for key, n in zip(keys, c)}
            s["m"] |= dict(zip(own.tolist(), m.tolist()))
            s["k"] |= dict(zip(own.tolist(), k.tolist()))
            s["T"] |= dict(zip(own.tolist(), tables.tolist()))
    short = lambda h: h >> (64 - pylm.HASH_BITS)
    assert seen == {(w, short(u)): n for (w, u), n in pairs.items()}
    size = Counter()
    for (w, u), n in pairs.items():
        size[u] += n
    for s, totals in zip(samples, kept):
        for u in size:
            assert s["T"][u] == sum(t for (_, x), t in s["t"].items() if x == short(u))
        for w in s["m"]:
            assert s["m"][w] == sum(t for (x, _), t in s["t"].items() if x == w) and 1 <= s["k"][w] <= s["m"][w]
        assert totals["M"] == sum(s["m"].values()) and totals["K"] == sum(s["k"].values())

    def probability(w, u):
        total = 0.0
        for s, g in zip(samples, kept):
            base = g["base"] if w in s["m"] else g["unknown"]
            up = (s["m"].get(w, 0) - g["parent_discount"] * s["k"].get(w, 0) + (1 + g["parent_discount"] * g["K"]) * base) / (1 + g["M"])
            own = seen.get((w, short(u)), 0) - g["discount"] * s["t"].get((w, short(u)), 0)
            total += (own + (1 + g["discount"] * s["T"].get(u, 0)) * up) / (1 + size.get(u, 0))
        return total / len(kept)

    for u in size:
        assert abs(sum(probability(w, u) for w in [*samples[0]["m"], hashes["new"]]) - 1) < 1e-9
    asked = [*texts[:20], "w0 w1 new w2 new new", "", None]
    got = pylm.score(_docs(make, asked), state, kept).orderBy("doc_id").collect()
    for r, t in zip(got, asked):
        line = [hashes[w] for w in (t or "").split()] + [end]
        assert abs(r.score - sum(log10(probability(w, u)) for w, u in zip(line, [end, *line]))) < 1e-9


def test_language_id_stage_sends_texts_once_in_bounded_batches(spark, make, monkeypatch):
    """40 MB of texts in one file: no batch that a worker gets holds more than the bound and a row, a text in it once."""
    import corpus_pipeline as p
    from recsuite.session import BATCH_BYTES
    most, kind, sent = BATCH_BYTES + (1 << 20), type(spark.range(1)), []
    plain = kind.mapInArrow

    def watched(self, func, schema, *args):
        def run(batches):
            def small():
                for b in batches:
                    if b.nbytes > most:
                        raise ValueError(f"a batch of {b.nbytes} bytes")
                    yield b
            return func(small())
        sent.append(self)
        return plain(self, run, schema, *args)

    line = "the people of the town said that it was the best of all the days they had seen and more would come "
    rows = [(i, (line if i % 2 else line[::-1]) * 500, "ab"[i % 2], "web", 500 * len(line)) for i in range(800)]
    docs = make(rows, "doc_id long, text string, lang string, source string, n_chars long", 1)
    monkeypatch.setattr(kind, "mapInArrow", watched)
    out = p.language_id(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.selectExpr("doc_id", "crc32(cast(text as binary))", "lang", "n_chars").collect())) == \
        sorted(map(tuple, docs.selectExpr("doc_id", "crc32(cast(text as binary))", "lang", "n_chars").collect()))
    assert [len(x.columns) for x in sent] == [len(docs.columns)]
