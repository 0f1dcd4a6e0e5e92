"""Inputs that once gave a wrong result, and generated pages against the text they were made of."""

import random
import time

import pytest

PROSE = "The people of the town said that it was the best of all the days they had seen and that more would come."


def test_html_names_inside_the_article():
    from recsuite.llm.html_extract import extract
    page = (f'<article><div class="post-header"><h1>The Title</h1></div><p>{PROSE}</p><p class="share-story">{PROSE}</p>'
            f'<div class="reader-comments"><p>{PROSE}</p></div><div class="ad-slot">{PROSE}</div></article>')
    assert extract(page) == f"The Title {PROSE} {PROSE}"


def test_html_quote_that_stays_open():
    from recsuite.llm.html_extract import extract
    assert extract(f'<article><p>{PROSE}</p><p title="x>{PROSE}</p></article>') == f"{PROSE} {PROSE}"


def test_html_stray_end_tags_take_linear_time():
    from recsuite.llm.html_extract import extract
    spent = []
    for n in (20_000, 80_000):
        start = time.process_time()
        extract("<b>" * n + "</i>" * n)
        spent.append(time.process_time() - start)
    assert spent[1] < 12 * max(spent[0], 0.02)


def test_html_of_generated_pages():
    """Pages are put together from an article that is known and parts that are none."""
    from recsuite.llm.html_extract import extract
    rnd = random.Random(8)
    stop = "the of and to in that it was for on with as he is his at by they be this had not".split()
    word = lambda: rnd.choice(stop) if rnd.random() < 0.5 else "".join(rnd.choices("abcdefghilmnorstu", k=rnd.randrange(3, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    parts = [lambda: f"<nav><ul><li><a href=/>{say(2)}</a></li></ul></nav>", lambda: f"<aside><p>{say(30)}</p></aside>",
             lambda: f'<div class="cookie-notice"><p>{say(20)}</p></div>', lambda: f"<footer>&copy; {say(25)}</footer>",
             lambda: f"<form><label>{say(3)}</label></form>", lambda: f"<script>if (a < b) {{ '{say(9)}' }}</script>",
             lambda: f"<style>p > a {{ }} /* {say(4)} */</style>", lambda: f'<section id="comments"><p>{say(30)}</p></section>',
             lambda: f"<!-- {say(12)} -->"]
    for _ in range(150):
        wanted, inner = [], []
        for k in range(rnd.randrange(1, 9)):
            text = say(rnd.randrange(25, 60))
            wanted.append(" ".join(f"{text} & {text[:5]}".split()))
            spaced = text.replace(" ", rnd.choice([" ", "\n  ", "\t"]))
            bold = spaced.split(" ", 1)
            spaced = f"<b>{bold[0]}</b> {bold[1]}" if len(bold) == 2 else spaced
            inner.append(f"<p>{spaced} &amp; {text[:5]}" + rnd.choice(["</p>", ""]))
            if rnd.random() < 0.3:
                inner.append(rnd.choice(parts[1:])())
        around = [p() for p in rnd.choices(parts, k=6)]
        page = "<html><head><title>x</title></head><body>" + "".join(around[:3]) + "<article>" + "\n".join(inner) + "</article>" \
            + "".join(around[3:]) + rnd.choice(["</body></html>", "", "<p"])
        assert extract(page) == " ".join(wanted)


def test_language_of_text_without_a_letter(make):
    from recsuite.llm.langid import op6_language_id
    rows = [(i, "der und die das ist nicht " * 4 + str(i) if i % 2 else "the and of that is not it " * 4 + str(i), ["en", "de"][i % 2])
            for i in range(60)]
    rows += [(100, "²", "en"), (101, "½ ³ ₄", "en"), (102, "１２", "en"), (103, "Ⅷ ☃", None), (104, "ª", None), (105, "日", None)]
    got = {r.doc_id: r for r in op6_language_id(make(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102, 103))
    assert all(got[i].lang_pred in ("en", "de") for i in (104, 105))


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_license_windows_in_long_runs_of_hits(threshold):
    from recsuite.llm.license import Scanner, words

    def plain(s, w):
        other, g = s.sets["T"], list(zip(w, w[1:]))
        return max((2 * len(set(g[i:j]) & other) / (len(set(g[i:j])) + len(other)) for i in range(len(g))
                    for j in range(i + 1, min(len(g), i + s.longest["T"]) + 1)), default=0)

    s = Scanner({"T": "a b c a d"}, 0.9)
    for r in range(1, 25):
        got = list(s.windows(words("x " + "a b c " * r + "a d y z")))
        assert got[0][1] == 1.0
    rnd = random.Random(threshold)
    for _ in range(700):
        s = Scanner({"T": " ".join(rnd.choices("abcd", k=rnd.randrange(3, 9)))}, threshold)
        w = rnd.choices("abcdxy", weights=[4, 4, 4, 4, 1, 1], k=rnd.randrange(2, 60))
        best = plain(s, w)
        got = list(s.windows(w))
        assert [x[1] for x in got] == ([best] if best >= threshold else [])


def test_license_versions_are_told_apart():
    from recsuite.llm import license as LI
    s = LI.Scanner(LI.TEMPLATES, LI.THRESHOLD)
    for v in ("2.0", "3.0"):
        got = [m[0] for m in s.scan("x y\n\n" + LI.TEMPLATES[f"GPL-{v}-or-later"] + "\n\nfoo bar")]
        assert got == [f"GPL-{v}-or-later", f"GPL-{v}-or-later (short)"]
    both = LI.TEMPLATES["GPL-2.0-or-later"] + "\n\n" + "other words " * 50 + "\n\n" + LI.TEMPLATES["GPL-3.0-or-later"]
    assert {m[0][:7] for m in s.scan(both)} == {"GPL-2.0", "GPL-3.0"}


def test_pipeline_stages_stand_dotted_column_names(make):
    import corpus_pipeline as p
    rows = [(i, f"the house number {i} of the street and the town " * 4, "en", "s", 10, i) for i in range(8)]
    docs = make(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, plain int").withColumnRenamed("plain", "a.b")
    for name, stage in p.STAGES[:-1]:
        got = stage(docs.sparkSession, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns and got.count() <= 8, name
