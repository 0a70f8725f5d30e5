"""Main text of HTML pages by a minimum cut over their blocks.

A page is cut into blocks of text. A linear classifier over each block's surroundings and text gives the
cost of calling it content or boilerplate; these costs are the capacities of its edges to the two
terminals. Neighbouring blocks and blocks of the same parent are tied by smoothness edges that weigh the
more the more of the page's tree they share. A maximum flow then finds the cheapest labelling; the blocks
that stay connected to the content terminal are the text.

Where a block stands counts by the closest element that says anything: its tag, its role, the names in its
class and id (by their share, not by one word), and for a form how much of it is fields. An element that
holds most of the page's text and its headline says nothing, whatever it is called, and ``main`` always
wins. Short blocks in plain elements are left to their neighbours. The weights of the classifier are fixed
and listed below: no page labels exist to fit them on.

Defined cases: null and empty pages, and pages without content blocks, give an empty string; a page without
any element is all text; text outside any block element is a block; unclosed elements end with their parent,
an unclosed head or title where the body's first element or text begins; unknown references stay as they
are; very long pages are read whole, in time and memory that grow with their length; repeated rows give
equal texts; an empty table gives no rows; other columns pass through, but for one named as the new one,
which it replaces.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from topicloom.llm.common import table
from topicloom.llm.registry import query

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
option p pre search section summary table tbody td tfoot th thead tr ul""".split())
SILENT_TAGS = frozenset("""script style noscript template head title iframe object svg math canvas audio video
select datalist textarea button""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAK_TAGS = frozenset("br hr img".split())
PARAGRAPH_TAGS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
# An open element that the start of another one ends.
ENDS = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HEAD_TAGS = frozenset("head title meta link base script style noscript template".split())
FIELD_TAGS = frozenset("input select textarea button".split())

NEVER_TAGS = frozenset("nav aside footer menu dialog search".split())
NEVER_ROLES = frozenset("""navigation banner contentinfo complementary search form alert alertdialog dialog menu
menubar toolbar""".split())
PAGE_WORDS = frozenset("""ad ads advert advertisement advertising adsense adsbygoogle sponsor sponsored promo
promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup
subscription share sharing social follow sidebar sidenav aside menu nav navbar navigation breadcrumb
breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies
discussion related recommended recommendations widget login register search pagination pager copyright
legal disclaimer skip tags tagcloud hidden outbrain taboola""".split())
TEXT_WORDS = frozenset("""article content main post entry story body text prose""".split())
# What follows one of these in a name tells what a page has, not what an element is.
STATE_WORDS = frozenset("has with without no not is show".split())

# Weights of the classifier; positive speaks for content. The first four tell where a block stands.
IN_NEVER = -7.0
IN_PAGE_NAME = -7.0
IN_TEXT_NAME = 2.5
IN_ARTICLE = 4.0
IN_FORM = -7.0
FIELD_CHARS = 200  # characters a form has for each field before it counts as a form in part only
IN_LABEL = -6.0
ALL_LINKS = -4.0
LONG_TEXT = 1.5
SENTENCE = 0.8
SHORT_TEXT = -0.4
COPYRIGHT = -2.0
PARAGRAPH = 0.7  # also headings, quotes and preformatted text
# Smoothness between neighbours, per shared level of the tree, and between blocks of one parent.
NEIGHBOUR = 0.25
SIBLING = 0.5
MAX_SHARED = 4

_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[a-z]+")
_HUMP = re.compile("([a-z])([A-Z])")
_TITLE_END = re.compile("</title", re.IGNORECASE)


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    hides: bool = False  # by its tag, role or state
    page_names: int = 0
    text_names: int = 0
    link: bool = False
    label: bool = False
    silent: bool = False
    main: bool = False
    # What it holds, known at the end of the page.
    chars: int = 0  # outside links
    headline: int = 0  # of these, in h1
    fields: int = 0
    article: bool = False
    lean: float = 0.0


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    labelled: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


class Blocks(HTMLParser):
    """Blocks of text of a page and its elements, both in order."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, 0)
        self.elements = [self.top]
        self.found: list[Block] = []
        self.block: Block | None = None
        self.open: Counter[str] = Counter()
        self.title_ends = len(_TITLE_END.findall(page))
        self.feed(page)
        self.close()

    def _pop(self):
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def _ended_by(self, tag: str) -> bool:
        open_tag = self.top.tag
        if open_tag == "title":
            return not self.title_ends and (tag in BLOCK_TAGS or tag in HEAD_TAGS or tag == "body")
        if open_tag == "head":
            return tag not in HEAD_TAGS
        return tag in ENDS.get(open_tag, ())

    def handle_starttag(self, tag, attrs):
        while self.top.parent is not None and self._ended_by(tag):
            self._pop()
            self.block = None
        if tag in BLOCK_TAGS:
            # A paragraph ends where a block begins, also when an inline element is still open in it.
            element = self.top
            while element.parent is not None and element.tag not in BLOCK_TAGS:
                element = element.parent
            if element.tag == "p":
                while self.top is not element.parent:
                    self._pop()
            self.block = None
        if tag in BREAK_TAGS and self.block:
            self.block.parts.append(" ")
        attrs = dict(attrs)
        if tag in FIELD_TAGS and attrs.get("type") != "hidden":
            self.top.fields += 1
        if tag not in VOID_TAGS:
            self.top = self._element(tag, attrs)
            self.elements.append(self.top)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.title_ends -= 1
        if not self.open[tag]:
            if tag in BLOCK_TAGS:
                self.block = None
            return
        element = self.top
        while element.tag != tag:
            # The end of an inline element does not reach beyond the block it is in.
            if tag not in BLOCK_TAGS and element.tag in BLOCK_TAGS:
                return
            element = element.parent
        while self.top is not element.parent:
            self._pop()
        if tag in BLOCK_TAGS:
            self.block = None

    def handle_data(self, data):
        if self.top.tag == "head" and not data.isspace():
            self._pop()
        if self.top.silent:
            return
        if self.block is None:
            if data.isspace():
                return
            holder = self.top
            while holder.parent is not None and holder.tag not in BLOCK_TAGS:
                holder = holder.parent
            self.block = Block(holder)
            self.found.append(self.block)
        self.block.parts.append(data)
        size = len(data.strip())
        if self.top.link:
            self.block.linked += size
        else:
            self.top.chars += size
            if self.block.element.tag == "h1":
                self.top.headline += size
        if self.top.label:
            self.block.labelled += size

    def _element(self, tag: str, attrs: dict) -> Element:
        up = self.top
        role = attrs.get("role")
        made = Element(tag, up, up.depth + 1, link=up.link or tag == "a", label=up.label or tag in ("label", "legend"),
                       silent=up.silent or tag in SILENT_TAGS)
        made.main = tag == "main" or role == "main"
        made.article = tag == "article" or role == "article"
        made.hides = (tag in NEVER_TAGS or tag == "header" or role in NEVER_ROLES or "hidden" in attrs
                      or attrs.get("aria-hidden") == "true"
                      or "display:none" in (attrs.get("style") or "").replace(" ", "").lower())
        if tag not in ("html", "body"):
            for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
                page, text = name_kind(name)
                made.page_names += page
                made.text_names += text
        return made


def name_kind(name: str) -> tuple[bool, bool]:
    """Whether a class or id names a part of the page around the text, and whether it names the text."""
    words = []
    for word in _NAME_PARTS.findall(_HUMP.sub(r"\1 \2", name).lower()):
        if word in STATE_WORDS:
            break
        words.append(word)
    text = not TEXT_WORDS.isdisjoint(words)
    page = PAGE_WORDS.intersection(words)
    # The header of an article is its headline.
    if text and page == {"header"}:
        page = frozenset()
    return bool(page), text and not page


def place(elements: list[Element]) -> None:
    """Set what each element holds and how it leans: log odds that text standing in it is content."""
    own_article = [x.article for x in elements]
    for x in reversed(elements[1:]):
        x.parent.chars += x.chars
        x.parent.headline += x.headline
        x.parent.fields += x.fields
        x.parent.article |= x.article
    total = elements[0].chars
    outside = [True] * len(elements)  # in nothing that is boilerplate by name or tag
    at = {id(x): k for k, x in enumerate(elements)}
    for k, x in enumerate(elements[1:], 1):
        outside[k] = outside[at[id(x.parent)]] and not x.hides and not x.page_names
    free_article = any(a and o for a, o in zip(own_article, outside))
    in_article = [False] * len(elements)
    for k, x in enumerate(elements[1:], 1):
        up = at[id(x.parent)]
        in_article[k] = in_article[up] or own_article[k] or x.main
        most = 2 * (x.chars - x.headline) >= total > 0
        found_article = x.article and not x.hides and (x.tag == "form" or not free_article)
        holds_text = most and (x.headline > 0 or found_article)
        lean = x.parent.lean
        hides = x.hides and not (x.tag == "header" and in_article[k] and lean >= 0)
        share = x.page_names / max(1, x.page_names + x.text_names)
        if holds_text:
            hides, share = False, 0.0
        if hides:
            lean = min(lean, IN_NEVER)
        elif lean < 0 and not x.main:
            lean = min(lean, share * IN_PAGE_NAME)
        elif (own_article[k] or x.main) and share < 1:
            lean = IN_ARTICLE
        elif share:
            lean = share * IN_PAGE_NAME + (1 - share) * IN_TEXT_NAME
        elif x.text_names:
            lean = max(lean, IN_TEXT_NAME)
        if x.tag == "form" and not holds_text:
            part = min(1.0, FIELD_CHARS * max(1, x.fields) / max(1, x.chars))
            lean = (1 - part) * lean + part * min(lean, IN_FORM)
        x.lean = lean


def content_score(block: Block, text: str) -> float:
    """Log odds that a block is content."""
    at = block.element
    score = at.lean + ALL_LINKS * min(1.0, block.linked / len(text)) + IN_LABEL * min(1.0, block.labelled / len(text))
    if len(text) >= 200:
        score += LONG_TEXT
    elif len(text) < 25 and at.lean <= 0:
        score += SHORT_TEXT
    if text[-1] in ".!?…。\"'”":
        score += SENTENCE
    if "©" in text or "all rights reserved" in text.lower():
        score += COPYRIGHT
    if at.tag in PARAGRAPH_TAGS:
        score += PARAGRAPH
    return score


def shared_levels(a: Element, b: Element) -> int:
    """Depth of the closest common ancestor."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, and the next block of the same parent."""
    edges, latest = [], {}
    for k, block in enumerate(blocks):
        if k:
            levels = min(MAX_SHARED, shared_levels(blocks[k - 1].element, block.element))
            edges.append((k - 1, k, NEIGHBOUR * levels))
        parent = id(block.element.parent or block.element)
        if parent in latest:
            edges.append((latest[parent], k, SIBLING))
        latest[parent] = k
    return edges


def minimum_cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source.

    ``net`` is the capacity from the source (positive) or to the sink (negative) of each node, ``edges``
    are undirected. Maximum flow by blocking flows over shortest ways.
    """
    n = len(net)
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, weight in edges:
        near[a].append(len(to))
        to.append(b)
        room.append(weight)
        near[b].append(len(to))
        to.append(a)
        room.append(weight)
    give = [max(0.0, x) for x in net]
    take = [max(0.0, -x) for x in net]
    while True:
        level = [-1] * n
        queue = [v for v in range(n) if give[v] > 1e-12]
        for v in queue:
            level[v] = 0
        ends = False
        for v in queue:
            ends = ends or take[v] > 1e-12
            for e in near[v]:
                w = to[e]
                if level[w] < 0 and room[e] > 1e-12:
                    level[w] = level[v] + 1
                    queue.append(w)
        if not ends:
            return [x >= 0 for x in level]
        turn = [0] * n
        for source in range(n):
            while give[source] > 1e-12:
                way, v = [], source
                while take[v] <= 1e-12:
                    while turn[v] < len(near[v]):
                        e = near[v][turn[v]]
                        if room[e] > 1e-12 and level[to[e]] == level[v] + 1:
                            break
                        turn[v] += 1
                    else:
                        if not way:
                            v = -1
                            break
                        e = way.pop()  # a dead end: never again in this phase
                        v = to[e ^ 1]
                        turn[v] += 1
                        continue
                    way.append(e)
                    v = to[e]
                if v < 0:
                    break
                flow = min([give[source], take[v], *(room[e] for e in way)])
                give[source] -= flow
                take[v] -= flow
                for e in way:
                    room[e] -= flow
                    room[e ^ 1] += flow


def labels(page: str) -> tuple[list[str], list[bool], list[bool]]:
    """Texts of a page's blocks, whether the cut calls each content, and whether the classifier alone would."""
    parser = Blocks(page)
    blocks = [(b, t) for b in parser.found if (t := b.text())]
    texts = [t for _, t in blocks]
    if len(parser.elements) == 1:
        return texts, [True] * len(texts), [True] * len(texts)
    place(parser.elements)
    net = [content_score(b, t) for b, t in blocks]
    return texts, minimum_cut(net, ties([b for b, _ in blocks])), [x >= 0 for x in net]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    texts, content, _ = labels(page)
    return " ".join(t for t, keep in zip(texts, content) if keep)


@F.pandas_udf(StringType())
def _extract(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in pages], dtype=object)


def add_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """All rows and columns plus the main text."""
    return pages.withColumn(into, _extract(F.col(html).cast("string")))


@query("op7_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return add_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
