"""Main-text extraction from raw HTML by two-pass block rules.

The page is cut into blocks at block-level tags.  Pass 1 decides what it can from the block alone: link density,
length and the share of stop words make a block good, bad or undecided (short, or long without stop words inside the
article element).  Pass 2 gives every undecided block the label of its nearest decided neighbour: of the neighbours
before and after it, equal labels win at once, otherwise the nearer one, and at equal distance the good one.  Undecided
blocks inside an ``<article>`` / ``<main>`` look at neighbours inside it only.

Text inside navigation, headers outside the article, footers, asides, forms, scripts, styles and elements whose class,
id or role names such a part (menu, sidebar, advert, notice, comments, ...) is bad by markup.  Inside the article a name
counts less: see ``_part_class``.

Defined results: NULL or empty HTML, or no good block -> the empty text.  HTML without markup is one block.  Unclosed
tags, comments and a cut-off tag at the end are tolerated; pages are independent, so repeated rows repeat.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import row_blocks
from .frames import carried

# Frequent function words of the languages the corpus is written in.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in
into is it its just may more most no not of on one only or other our out she so some such than that the their them then
there these they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer eines er
es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von
vor war was wenn wer wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais me ne nous on ou où par
pas plus pour qu que qui sa se ses son sont sur un une vous
al algo ante antes como con contra cuando de del desde donde el ella ellas ellos en entre era es esta este estos fue ha
hay la las le les lo los más me mi muy ni no nos o para pero por porque que quien se ser si sin sobre son su sus también
te tiene todo tu un una uno y ya
""".split())

# Elements that start a new block, elements whose content is never text, parts that are not the article.
BLOCK_TAGS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol
optgroup option p pre section select summary table tbody td template tfoot th thead title tr ul""".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object noembed noframes".split())
PART_TAGS = frozenset("nav header footer aside form button select menu dialog head".split())
MAIN_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p li dt dd option".split())
PART_NAMES = frozenset("""ad ads advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment
comments consent cookie cookies disclaimer disqus footer form gdpr header login masthead menu menubar modal nav navbar
navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies
respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar
widget widgets""".split())
FOREIGN_NAMES = frozenset("""ad ads advert advertisement advertising adverts comment comments cookie cookies newsletter promo promoted
related recommended sidebar social sponsor sponsored subscribe widget""".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)  # a quote that stays open: up to the next >
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
                   re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, 0, None

LENGTH_LOW = 70       # characters under which a block is short
STOPWORDS_LOW = 0.15  # share of stop words under which a block is no prose
LINKS_HIGH = 0.4      # share of characters inside links over which a block is no prose


def _part_class(token: str) -> bool:
    """Whether a class or id inside the article names a part: by its last word (reader-comments, but not share-story; a header
    there is a headline), or by a first word that names foreign matter (ad-slot)."""
    found = _NAME.findall(token)
    return bool(found) and (found[-1] in PART_NAMES and found[-1] != "header" or found[0] in FOREIGN_NAMES)


def _names_part(attrs: str, inside: bool) -> bool:
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in PART_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and (any(map(_part_class, value.split())) if inside else
                                        PART_NAMES.intersection(_NAME.findall(value))):
            return True
    return False


class _Page:
    """Blocks of one page: [text pieces, characters inside links, bad by markup, inside the article]."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, float, bool, bool]] = []
        self.stack: list[tuple[str, bool]] = []  # open elements: (tag, starts a part that is not the article)
        self.held: Counter = Counter()  # open elements by tag
        self.parts = self.links = self.mains = 0
        self.pieces: list[str] = []
        self.linked = 0
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if not m:
                break
            self._text(source[at:m.start()])
            at = m.end()
            end_tag, tag, attrs = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if end_tag:
                self._close(tag)
            else:
                self._open(tag, attrs or "")
                if tag in RAW_TAGS and not (attrs or "").endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(tag)
        self._text(source[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append(raw)
            if self.links:
                self.linked += len(raw)

    def _flush(self) -> None:
        text = " ".join(_html.unescape("".join(self.pieces)).split())
        if text:
            self.blocks.append((text, min(1.0, self.linked / len(text)), self.parts > 0, self.mains > 0))
        self.pieces, self.linked = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
            if self.stack and self.stack[-1][0] in CLOSED_BY_BLOCK and tag != "br":
                self._pop()
        if tag in VOID_TAGS or attrs.endswith("/"):
            return
        part = tag in PART_TAGS and not (tag == "header" and self.mains) or tag not in ("html", "body", *MAIN_TAGS) \
            and bool(attrs) and _names_part(attrs, self.mains > 0)
        self.stack.append((tag, part))
        self.held[tag] += 1
        self.parts += part
        self.links += tag == "a"
        self.mains += tag in MAIN_TAGS

    def _pop(self) -> None:
        tag, part = self.stack.pop()
        self.held[tag] -= 1
        self.parts -= part
        self.links -= tag == "a"
        self.mains -= tag in MAIN_TAGS

    def _close(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        if self.held[tag]:
            while True:
                last = self.stack[-1][0]
                self._pop()
                if last == tag:
                    break


def _decide(text: str, links: float, part: bool, inside: bool):
    if part or links > LINKS_HIGH:
        return BAD
    if len(text) < LENGTH_LOW:
        return OPEN if inside or "©" not in text else BAD
    words = _WORD.findall(text.lower())
    if words and sum(w in STOP_WORDS for w in words) >= STOPWORDS_LOW * len(words):
        return GOOD
    return OPEN if inside else BAD


def _inherit(labels: list, near: list[bool]) -> list[bool]:
    """Label of the nearest decided neighbour for the undecided ones (near: may be looked at)."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = (i, labels[i]) if near[i] and labels[i] is not OPEN else last
        before[i] = last
    last = None
    for i in reversed(range(n)):
        last = (i, labels[i]) if near[i] and labels[i] is not OPEN else last
        after[i] = last
    out = []
    for i, label in enumerate(labels):
        if label is OPEN:
            b, a = before[i], after[i]
            if b and a:
                label = b[1] if b[1] == a[1] or i - b[0] < a[0] - i else a[1] if a[0] - i < i - b[0] else GOOD
            else:
                label = (b or a or (i, BAD))[1]
        out.append(label == GOOD)
    return out


def extract(source: str | None) -> str:
    """Main text of one page: good blocks in page order, joined by one space."""
    if not source:
        return ""
    blocks = _Page(source).blocks
    labels = [_decide(*b) for b in blocks]
    inside = [b[3] and not b[2] for b in blocks]
    # the article decides among itself; it is good where none of its blocks is decided
    own = [(lab if ins else OPEN) for lab, ins in zip(labels, inside)]
    if any(inside):
        within = _inherit(own, inside) if any(x is GOOD for x in own) else \
            [ins and lab is not BAD for lab, ins in zip(labels, inside)]
        keep = [w and ins for w, ins in zip(within, inside)]
    else:
        keep = _inherit(labels, [True] * len(blocks))
        if not any(x is GOOD for x in labels) and not any(x is BAD for x in labels):
            keep = [True] * len(blocks)  # nothing but undecided blocks: a bare page of short text
    return " ".join(b[0] for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """``keep`` columns of ``pages`` plus ``text`` and ``n_chars`` (code points)."""
    keep = ["page_id", "url"] if keep is None else keep
    src, fixed, names = carried(pages, keep, __html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "__html"):
                texts = [extract(h.as_py()) for h in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[*part.schema.names[:len(keep)], "text", "n_chars"])

    return src.mapInArrow(run, f"{fixed}text string, n_chars bigint").select(*names, "text", "n_chars")


def op1_html_extraction(pages: DataFrame) -> DataFrame:
    return extract_pages(pages)
