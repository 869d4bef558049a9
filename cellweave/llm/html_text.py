"""HTML extraction (operator 7): minimum-cut labelling of a page's text blocks.

A page is cut into blocks at block-level tags.  A classifier gives every block log-odds of being content, from the
elements it stands in, their names, its links and its length; they become capacities to the two terminals.  Neighbouring
blocks, and blocks that follow each other in the same element, are joined by smoothness edges that grow with the part of the
DOM path they share.  Log-odds and edges are of one size, so a block that looks odd by itself (a paragraph that is one link,
a short line) goes with its neighbours, and a group of odd blocks does not.  The minimum cut labels the page: content is what
stays on the source's side.

Blocks whose own capacity exceeds all their edges keep their side in every minimum cut, so only the others enter the
max-flow; pages are independent of each other and nothing is shuffled.  A page takes time in proportion to its length, however
deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import pieces, read_table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag whose attributes hold no angle: most of them.  It ends before the next one begins, so trying it costs no more than that.
_SIMPLE = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_IN_TAG = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content is no text of the page, read up to their own end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "xmp", "noembed", "noframes"}
#: Elements without text of the page; ``head`` ends at the first element of the body.
SKIPPED = {"head", "title", "svg", "canvas", "audio", "video", "select", "button", "datalist", "dialog"}
IN_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template", "html"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Start tags that end an open element of the same group, as far as the nearest of the stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
#: Parts of class names and ids that tell what is not the article.
BOILERPLATE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie",
    "cookies", "copyright", "discussion", "disqus", "dropdown", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay",
    "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "teaser", "toolbar", "widget",
}
#: Those that tell it in a compound name, too, and for an article inside.
FIRM_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "gdpr",
    "login", "modal", "newsletter", "pagination", "popup", "promo", "related", "replies", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "teaser",
}
CONTENT_NAMES = {"article", "articlebody", "content", "entry", "post", "story", "text", "prose", "maincontent", "body"}
#: Elements of the text itself: their names are weak evidence; those of headings, mostly anchors, are none.
TEXTUAL = {"p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption", "summary"}

#: Log-odds of the classifier: of where a block stands ...
IN_ARTICLE, IN_CONTENT, UNMARKED, OUTSIDE = 2.0, 1.5, 1.6, -2.0
BOILERPLATE, COMPOUND_NAME, WEAK_NAME = -6.0, -2.5, -1.0
#: ... and of its text, and their bound.
HEADING, WORDS_HALF, PER_LOG_WORD, LINKED, SENTENCE = 0.5, 12, 0.6, -2.5, 0.3
SHORTEST, LONGEST, FIRMEST = -1.5, 1.5, 6.0
#: Smoothness between neighbours, times the shared part of their DOM paths; between followers in one element; and what is left of
#: either where one of the two blocks is marked as boilerplate and the other is not.
ADJACENT, PROXIMATE, UNLIKE = 1.5, 1.0, 0.25


#: A piece of a page: the text before a tag, the tag's name (empty at the end, and for comments and the like), whether it closes,
#: and its attributes as they stand.
Markup = tuple[str, str, bool, str]


def markup_of(page: str) -> Iterator[Markup]:
    """The page's tags in order with the texts before them, in time in proportion to its length.

    What begins like a tag and never ends is text.  Quotes in a tag hold what is inside together; once a quote does not end where a
    tag could still end behind it, quotes count as ordinary characters for the rest of the page, so that none is
    searched for again and again.  The content of elements in ``RAW`` is left out, with their end tags.
    """
    last_end = page.rfind(">")
    careful, at, begin = True, 0, 0
    while True:
        low = page.find("<", at)
        m = _SIMPLE.match(page, low) if low >= 0 else None
        if m is not None:
            slash, tag, attributes = m.groups()
            tag = tag.lower()
            yield page[begin:low], tag, slash != "", attributes
            at = begin = m.end()
            if not slash and tag in RAW:
                m = _raw_end(tag).search(page, at)
                at = begin = m.end() if m else len(page)
            continue
        if low < 0 or low > last_end and not page.startswith("<!--", low):
            yield page[begin:], "", False, ""
            return
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            yield page[begin:low], "", False, ""
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        if page[low + 1 : low + 2] in ("!", "?"):
            yield page[begin:low], "", False, ""
            at = begin = page.find(">", low) + 1
            continue
        closing = page.startswith("/", low + 1)
        name = _NAME.match(page, low + 1 + closing)
        if name is None:
            at = low + 1
            continue
        end = -1
        if careful:
            place = name.end()
            while (m := _IN_TAG.search(page, place)) is not None:
                if m[0] == ">":
                    end = m.start()
                    break
                place = page.find(m[0], m.end()) + 1
                if not place:
                    break
            careful = end >= 0
        if end < 0:
            end = page.find(">", name.end())
        tag = name[0].lower()
        yield page[begin:low], tag, closing, page[name.end() : end]
        at = begin = end + 1
        if tag in RAW and not closing:
            m = _raw_end(tag).search(page, at)
            at = begin = m.end() if m else len(page)


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*+>", re.I)


class Block(NamedTuple):
    text: str
    score: float
    parent: int  # number of the element around the block's own
    depth: int  # of the block's element
    shared: int  # elements shared with the block before
    marked: bool  # stands in an element that is marked as boilerplate


class _Element(NamedTuple):
    tag: str
    number: int
    place: float  # IN_ARTICLE, IN_CONTENT or 0
    marks: float  # log-odds of what marks it as boilerplate
    skipped: bool = False
    header: bool = False  # of an article: its headings stay
    firm: bool = False  # what makes it boilerplate holds for an article inside, too
    linked: bool = False
    heading: bool = False
    compound: int = 0  # outermost element around it that a part of its name marks


def _attributes(raw: str) -> tuple[list[str], str, bool]:
    """Class names and ids, role, and whether the element is hidden."""
    names: list[str] = []
    role, hidden = "", False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            role = value.strip()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, role, hidden


def _named(tag: str, names: list[str]) -> tuple[float, bool]:
    """Log-odds of an element's names, and whether they hold for an article inside."""
    if tag in HEADINGS:
        return 0.0, False
    parts = {x for name in names for x in re.split(r"[^a-z0-9]+", name)}
    whole, firm, some = BOILERPLATE_NAMES.intersection(names), parts & FIRM_NAMES, parts & BOILERPLATE_NAMES
    if not some:
        return 0.0, False
    if tag in TEXTUAL:
        return WEAK_NAME, False
    if whole:
        return BOILERPLATE, bool(whole & FIRM_NAMES)
    # A part of a name says what something is about as often as what it is.
    return (COMPOUND_NAME, False) if firm else (WEAK_NAME, False)


def _element(tag: str, attributes: str, number: int, up: _Element) -> _Element:
    names, role, hidden = _attributes(attributes) if attributes.strip(" /") else ([], "", False)
    place, marks, header, firm = up.place, up.marks, up.header, up.firm
    if tag == "main" or role == "main":
        place, marks, firm, header = IN_ARTICLE, 0.0, False, False
    elif tag == "article" or role == "article":
        if not firm:
            place, marks = IN_ARTICLE, 0.0
    elif tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES:
        marks += BOILERPLATE
        firm = firm or tag != "form"
    elif tag == "header":
        if place == IN_ARTICLE and not marks:
            header = True
        else:
            marks += BOILERPLATE
            firm = True
    compound = up.compound
    if names and tag not in ("html", "body", "main"):
        own, holds = _named(tag, names)
        if own == COMPOUND_NAME and tag != "article":
            own, compound = (0.0, compound) if compound else (own, number)
        if tag == "article" and not holds:
            own = 0.0
        marks += own
        firm = firm or holds
        if not own and not marks and not place and CONTENT_NAMES.intersection(x for name in names for x in re.split(r"[^a-z0-9]+", name)):
            place = IN_CONTENT
    return _Element(tag, number, place, marks, up.skipped or hidden or tag in SKIPPED, header, firm, up.linked or tag == "a", up.heading or tag in HEADINGS, compound)


def blocks_of(page: str | Iterable[Markup]) -> list[Block]:
    """The non-empty text blocks of a page, or of its markup, in order, with their classifier scores (log-odds of content)."""
    found: list[tuple[str, _Element, float, int, int, int]] = []
    stack = [_Element("", 0, 0.0, 0.0)]
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    linked = number = 0
    low = 1  # the least depth since the block before

    def close(depth: int) -> None:
        nonlocal low
        for e in stack[depth:]:
            is_open[e.tag] -= 1
        del stack[depth:]
        low = min(low, depth)

    def flush() -> None:
        nonlocal linked, low
        text = " ".join("".join(parts).split())
        parts.clear()
        linked_part, linked = linked, 0
        if text:
            found.append((text, stack[-1], min(1.0, linked_part / len(text)), stack[-2].number if len(stack) > 1 else 0, len(stack), low))
            low = len(stack)

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].skipped:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].linked:
                linked += len(text.strip())

    for before, tag, closing, attributes in markup_of(page) if isinstance(page, str) else page:
        if before:
            add(before)
        if not tag:
            continue
        if is_open["head"] and not closing and tag not in IN_HEAD:
            close(next(i for i, e in enumerate(stack) if e.tag == "head"))
        if tag in RAW:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if parts and tag in BLOCK:
            flush()
        if closing:
            if is_open[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:  # an open paragraph, with what it left open, ends here
            while len(stack) > 1 and (stack[-1].tag == "p" or tag == "p" and stack[-1].tag not in BLOCK and is_open["p"]):
                close(len(stack) - 1)
        if tag in IMPLIED and any(is_open[x] for x in IMPLIED[tag][0]):
            ended, stops = IMPLIED[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in stops:
                    break
                if stack[depth].tag in ended:
                    close(depth)
                    break
        number += 1
        stack.append(_element(tag, attributes, number, stack[-1]))
        is_open[tag] += 1
    flush()
    # Where something is marked as the article, what stands outside of it and has no mark is not.
    plain = OUTSIDE if any(e.place and not e.marks for _, e, *_ in found) else UNMARKED
    # What holds half of the text is the page's subject, whatever a part of its name says.
    sizes: Counter[int] = Counter()
    for text, e, *_ in found:
        sizes[e.compound] += len(text) if e.marks > BOILERPLATE else 0
    most = sum(sizes.values()) / 2
    found = [(text, e._replace(marks=e.marks - COMPOUND_NAME) if e.compound and sizes[e.compound] >= most else e, *rest) for text, e, *rest in found]
    return [Block(text, _score(text, e, links, plain), parent, depth, shared, e.marks <= COMPOUND_NAME) for text, e, links, parent, depth, shared in found]


@lru_cache(maxsize=10_000)
def _resolved(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:
        return target


class PageHead:
    """A page's ``title`` and the targets of its ``links`` in order: character references decoded, relative ones resolved against the page's
    base.  Comments, scripts and other attributes (``data-href``) have none.  Known once all of ``watch`` is taken."""

    def __init__(self, url: str):
        self.base, self.links, self.title = url, [], None

    def watch(self, marks: Iterable[Markup]) -> Iterator[Markup]:
        """The marks, looked at as they pass."""
        inside = False
        for mark in marks:
            tag = mark[1]
            if inside:
                self.title += mark[0]
            if tag == "title":
                if self.title is None and not mark[2]:
                    self.title, inside = "", True
                elif mark[2]:
                    inside = False
            elif tag in ("a", "area", "base") and not mark[2]:
                target = next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(mark[3]) if m[1].lower() == "href"), None)
                if target is not None:
                    found = _resolved(self.base, entities.unescape(target).strip())
                    if tag == "base":
                        self.base = found
                    else:
                        self.links.append(found)
            yield mark
        if self.title is not None:
            self.title = " ".join(entities.unescape(self.title).split())


def _score(text: str, element: _Element, links: float, plain: float) -> float:
    """A block's log-odds of being content."""
    score = (element.place or plain) + element.marks + LINKED * links
    score += max(SHORTEST, min(LONGEST, PER_LOG_WORD * math.log((text.count(" ") + 1) / WORDS_HALF)))
    if text[-1] in ".!?…。\"'”":
        score += SENTENCE
    if element.heading:
        score += HEADING
    elif element.header:
        score += BOILERPLATE
    return max(-FIRMEST, min(FIRMEST, score))


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, and successive blocks right below one element."""
    out = []
    last: dict[int, int] = {}
    like = lambda a, b: 1.0 if a.marked == b.marked else UNLIKE
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, ADJACENT * like(blocks[i - 1], block) * block.shared / max(blocks[i - 1].depth, block.depth)))
        if last.get(block.parent, i - 1) != i - 1:
            out.append((last[block.parent], i, PROXIMATE * like(blocks[last[block.parent]], block)))
        last[block.parent] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the scores cut off plus the edges cut; true is the source's side (positive scores).

    Ties go to the sink's side as far as they can.
    """
    n = len(scores)
    around = [0.0] * n
    for a, b, w in edges:
        around[a] += w
        around[b] += w
    label: list[bool | None] = [s > 0 if abs(s) > around[i] else None for i, s in enumerate(scores)]
    if None not in label:
        return label  # type: ignore[return-value]
    # Max-flow over what is open; a settled neighbour adds its edge to a terminal.
    free = {i: k for k, i in enumerate(i for i in range(n) if label[i] is None)}
    source, sink = len(free), len(free) + 1
    graph: list[dict[int, float]] = [{} for _ in range(len(free) + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a][b] = graph[a].get(b, 0.0) + there
        graph[b][a] = graph[b].get(a, 0.0) + back

    for i, k in free.items():
        join(source, k, max(0.0, scores[i]), 0.0)
        join(k, sink, max(0.0, -scores[i]), 0.0)
    for a, b, w in edges:
        if a in free and b in free:
            join(free[a], free[b], w, w)
        elif a in free or b in free:
            inside, outside = (free[a], b) if a in free else (free[b], a)
            if label[outside]:
                join(source, inside, w, 0.0)
            else:
                join(inside, sink, w, 0.0)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, room in graph[u].items():
                if room > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        arcs = [list(x) for x in graph]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(graph[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    graph[a][b] -= flow
                    graph[b][a] = graph[b].get(a, 0.0) + flow
                path = [source]
                continue
            while arcs[u] and not (graph[u].get(arcs[u][-1], 0.0) > 1e-9 and level.get(arcs[u][-1], -1) == level[u] + 1):
                arcs[u].pop()
            if arcs[u]:
                path.append(arcs[u][-1])
            else:
                level[u] = -1
                path.pop()
    reached, queue = {source}, deque([source])
    while queue:
        u = queue.popleft()
        for v, room in graph[u].items():
            if room > 1e-9 and v not in reached:
                reached.add(v)
                queue.append(v)
    return [x if x is not None else free[i] in reached for i, x in enumerate(label)]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    keep = minimum_cut([b.score for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns with ``text`` and ``n_chars`` (code points) for every row.

    Null and empty pages, and pages without content, give an empty text.  Of an article's own header the headings stay.
    Unclosed and misplaced tags are read as browsers do for paragraphs, lists, tables and the head, else up to the enclosing
    element's end.  Pages of any length are taken whole.  Repeated rows are extracted each; an empty table gives an empty
    result.  Columns to ``keep`` that are named ``text`` or ``n_chars`` would clash with the result's and are refused.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are columns of the result")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "_html"):
            texts = [main_text(x) for x in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])

    narrow = df.select(*keep, df[html_col].alias("_html"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_html")
    return narrow.mapInArrow(extract, f"{types}, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
