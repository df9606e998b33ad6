"""Main text of web pages by tree scoring.

A page becomes a tree of elements (open paragraphs, list items and table cells close where HTML
lets them). Boilerplate elements are dropped by tag, role or name; a name counts if all of its parts say so
(``share-buttons``, not ``share-price``), and within an article it never drops a paragraph. Each paragraph passes
points for its length and commas to its parent and, halved, to its grandparent; a container's points are
discounted by its share of link text. The best container is kept, widened to the outermost article
or main element around it, with those siblings that earned points of their own, headings and bare text, if
less than LINK_SHARE of it is link text, and the headings before it beside its ancestors. Containers of the same make
(the same tags above them) with COUSIN_SHARE of its points are parts of the same story and kept too. Inside
of what is kept, containers of links go, but for lists within the prose: with a paragraph after them, or led in by a colon
or by a heading that announces sources. The blocks, in page order, are the text: character
references decoded, white space within a block one space, blocks joined by a newline.

Odd input: null or empty html, or a page without text: empty text. Broken markup: what can't be a
tag is text, an open comment or script runs to the end. Repeated rows and null ids: each row for
itself. Empty table: empty result. Very long pages take memory in proportion to one page. Other
columns are kept, result columns replace ones of the same name.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_NAME = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PARAGRAPH = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6 figcaption".split())
#: A start tag closes an open element of these, up to the boundary.
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BOUNDS = frozenset("ul ol dl table article main body section".split())
_DROPPED_TAGS = frozenset("head nav footer aside form button select menu dialog object audio video canvas input".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
# Parts of class names and ids. An element goes if all parts of one of its names are listed and one is in the first set.
_DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice banner popup modal newsletter subscribe share sharing social "
    "related recommended comment comments disqus respond pagination pager toolbar login signup copyright legal disclaimer imprint tagline".split()
)
_QUALIFIERS = frozenset(
    "site page main top bottom left right primary secondary global box bar area wrap wrapper container block section list item items widget "
    "inner outer slot unit content text links link buttons button icons icon form posts post articles article stories reader readers user "
    "users us our the and on of for by in policy info message overlay module panel header head title count thread".split()
)
#: Names that say so only outside of an article, where they are sections of it as often.
_OUTER_NAMES = frozenset("header discussion discussions replies responses reactions feedback conversation".split())
#: Headings after which a list of links is part of the text.
_SOURCES = frozenset("references sources notes footnotes citations bibliography literature quellen literatur einzelnachweise références sources notes referencias fuentes bibliografía".split())
_NOTICE = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)
_KEPT_TAGS = frozenset("html body article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: From this share of link text on, a container holds links rather than text.
LINK_SHARE = 0.5
#: Share of the best container's points from which on one of the same make is a part of its story.
COUSIN_SHARE = 0.2


class _Element:
    __slots__ = ("tag", "parent", "parts", "score", "most", "chars", "links", "own", "rest", "rest_links", "cited")

    def __init__(self, tag: str, parent: _Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.parts: list[str | _Element] = []
        self.score, self.chars, self.links, self.own = 0.0, 0, 0, 0
        self.most, self.cited = 0.0, False  # the best score within; whether links here are part of the prose
        self.rest, self.rest_links = 0, 0  # chars and links without containers of links below


def _dropped(tag: str, attributes: str, open_tags: list[str]) -> bool:
    if tag in _DROPPED_TAGS:
        return True
    inside = "article" in open_tags or "main" in open_tags
    if tag == "header" and not inside:
        return True
    if not attributes or tag in _KEPT_TAGS:
        return False
    for name, *values in _NAME.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" and not value or name.lower() == "aria-hidden" and value == "true":
            return True
        if name.lower() == "role" and value in _DROPPED_ROLES:
            return True
        if name.lower() in ("class", "id") and not (inside and tag in _PARAGRAPH) and any(_says_so(x, inside) for x in value.split()):
            return True
    return False


def _says_so(name: str, inside: bool) -> bool:
    """Whether a class name or id names boilerplate."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    strong = _DROPPED_NAMES if inside else _DROPPED_NAMES | _OUTER_NAMES
    return any(x in strong for x in parts) and all(x in strong or x in _QUALIFIERS for x in parts)


def parse(page: str) -> _Element:
    """The tree of a page without what is dropped."""
    root = _Element("html", None)
    here, skipped, at = root, 0, 0  # skipped: depth within a dropped element
    skip_tag = ""
    for m in _TOKEN.finditer(page):
        if m.start() > at and not skipped:
            here.parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        closing = m.group(2)
        if skipped:
            # only the same tag opens or closes what is skipped
            if tag == skip_tag:
                skipped += -1 if closing else 1
            continue
        if closing:
            node = here
            while node.parent is not None and node.tag != tag and (tag in _BLOCK or node.tag not in _BLOCK):
                node = node.parent
            if node.tag == tag and node.parent is not None:
                here = node.parent
            continue
        attributes = m.group(4)
        if tag in _VOID:
            if tag in ("br", "wbr"):
                here.parts.append(" " if tag == "br" else "")
            elif tag == "hr":
                here.parts.append(_Element("hr", here))
            continue
        if tag in _BLOCK:
            node = here
            ends = _CLOSES.get(tag, ())
            found = None
            while node.parent is not None and node.tag not in _BOUNDS:
                if node.tag == "p" or node.tag in ends:
                    found = node
                node = node.parent
            if found is not None:
                here = found.parent
        open_tags, node = [], here
        while node is not None:
            open_tags.append(node.tag)
            node = node.parent
        if _dropped(tag, attributes, open_tags):
            if not attributes.rstrip().endswith("/"):
                skipped, skip_tag = 1, tag
            continue
        if attributes.endswith("/"):
            continue
        child = _Element(tag, here)
        here.parts.append(child)
        here = child
    if at < len(page) and not skipped:
        here.parts.append(page[at:])
    return root


def _walk(root: _Element) -> list[_Element]:
    """Elements in page order, without recursion (trees can be deep)."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in reversed(node.parts) if not isinstance(x, str))
    return order


def _of_links(node: _Element) -> bool:
    return node.rest_links >= LINK_SHARE * node.rest


def _goes(node: _Element) -> bool:
    """Whether an element is a container of links that the text can do without."""
    return not node.cited and node.tag in _BLOCK and node.tag not in _PARAGRAPH and node.tag not in _HEADINGS and _of_links(node)


def _text(node: _Element) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        parts.append(x if isinstance(x, str) else "")
        todo.extend([] if isinstance(x, str) else reversed(x.parts))
    return html.unescape("".join(parts)).strip()


def _mark_cited(node: _Element) -> None:
    """Marks lists below an element that stand within its prose; ``chars`` and ``links`` are known."""
    below = [x for x in node.parts if not isinstance(x, str) and x.tag in _BLOCK and x.chars]
    prose = [x.tag in _PARAGRAPH and x.tag not in _HEADINGS and 2 * x.links < x.chars for x in below]
    for k, x in enumerate(below):
        if x.tag not in ("ul", "ol", "dl") or not k:
            continue
        before = below[k - 1]
        if prose[k - 1] and (k + 1 < len(below) and prose[k + 1] or _text(before).endswith(":")):
            x.cited = True
        elif before.tag in _HEADINGS and _SOURCES & set(re.findall(r"[^\W\d_]+", _text(before).lower())):
            x.cited = True


def blocks(root: _Element, path: frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks below an element, in page order, without containers of links; those whose id is in ``path`` stay."""
    found: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            found.append(text)
        line.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag in _BLOCK:
            end()
            if x is not root and id(x) not in path and _goes(x):
                continue
            todo.append(None)
            todo.extend(reversed(x.parts))
        else:
            todo.extend(reversed(x.parts))
    end()
    return found


def _beside(node: _Element) -> list[_Element]:
    """An element and its siblings that belong to it; text and inline elements between blocks are one piece."""
    kept, run = [], _Element("div", None)
    for x in [*node.parent.parts, None]:
        if isinstance(x, str):
            run.parts.append(x)
            run.rest += len(x) - sum(map(x.count, " \n\t"))
        elif x is not None and x is not node and x.tag not in _BLOCK:
            run.parts.append(x)
            run.rest += x.rest
            run.rest_links += x.rest_links
        else:
            if run.rest and not _of_links(run):
                kept.append(run)
            run = _Element("div", None)
            if x is not None and (x is node or x.rest and _belongs(x)):
                kept.append(x)
    return kept


def _belongs(x: _Element) -> bool:
    """Whether an element beside the best container is part of the text: a heading, a paragraph, or what earned points."""
    if x.tag in _HEADINGS:
        return True
    if _of_links(x) or not (x.tag in _PARAGRAPH or x.most > 0):
        return False
    return not (x.rest < 200 and _NOTICE.match(_text(x)))


def best_containers(root: _Element) -> tuple[list[_Element], frozenset[int]]:
    """The container with the most points and what belongs to it, in page order, and the ids of the best one and its ancestors."""
    order = _walk(root)
    commas = {}
    for node in reversed(order):  # children before parents
        text = "".join(x for x in node.parts if isinstance(x, str))
        node.own = len(text) - text.count(" ")
        node.chars = node.own + sum(x.chars for x in node.parts if not isinstance(x, str))
        node.links = node.chars if node.tag == "a" else sum(x.links for x in node.parts if not isinstance(x, str))
        _mark_cited(node)
        below = [x for x in node.parts if not isinstance(x, str) and not _goes(x)]
        node.rest = node.own + sum(x.rest for x in below)
        node.rest_links = node.rest if node.tag == "a" else sum(x.rest_links for x in below)
        commas[id(node)] = text.count(",") + sum(commas[id(x)] for x in node.parts if not isinstance(x, str) and x.tag not in _BLOCK)
    for node in order:
        if node.chars and (node.tag in _PARAGRAPH or node.tag in _BLOCK and node.own > 80) and node.parent is not None:
            points = (1 + commas[id(node)] + min(3.0, node.chars / 100)) * (1 - node.links / node.chars)
            if node.tag not in _PARAGRAPH:
                node.score += points
            node.parent.score += points
            if node.parent.parent is not None:
                node.parent.parent.score += points / 2
    for node in reversed(order):
        if node.chars:
            node.score *= 1 - node.links / node.chars
        node.most = max([node.score, *(x.most for x in node.parts if not isinstance(x, str))])
    best = max(order, key=lambda n: n.score)
    if best.score <= 0:
        best = next((n for n in order if n.tag in ("article", "main")), None)
        if best is None:
            return [root], frozenset(map(id, order))
    path, wide, node = set(), best, best
    while node is not None:
        path.add(id(node))
        if node.tag in ("article", "main"):
            wide = node
        node = node.parent
    if wide.parent is None:
        return [wide], frozenset(path)
    kept, node = _beside(wide), wide.parent
    while node.parent is not None:
        before = []
        for x in node.parent.parts:
            if x is node:
                break
            if not isinstance(x, str) and x.tag in _HEADINGS:
                before.append(x)
        kept = before + kept if before else kept
        node = node.parent
    return _with_cousins(order, best, kept), frozenset(path)


def _make(node: _Element) -> tuple[str, ...]:
    tags = []
    while node is not None:
        tags.append(node.tag)
        node = node.parent
    return tuple(tags)


def _with_cousins(order: list[_Element], best: _Element, kept: list[_Element]) -> list[_Element]:
    """``kept`` and the other containers of the best one's make that have a share of its points, in page order."""
    have = set(map(id, kept))
    make, more = _make(best), []
    for node in order:
        if node.tag == best.tag and node.score >= COUSIN_SHARE * best.score and not _of_links(node) and _make(node) == make:
            above = node
            while above is not None and id(above) not in have:
                above = above.parent
            if above is None:
                have.add(id(node))
                more.append(node)
    if not more:
        return kept
    place = {id(x): k for k, x in enumerate(order)}

    def first(x: _Element) -> int:
        """Place of an element, or of what a run of text and inline elements stands before."""
        return place[id(x)] if id(x) in place else -1

    at, where = -1, []
    for x in kept:  # a run keeps its place after the element before it
        at = max(at, first(x))
        where.append((at, x))
    return [x for _, x in sorted([*where, *((place[id(x)], x) for x in more)], key=lambda w: w[0])]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    kept, path = best_containers(parse(page))
    return "\n".join(line for node in kept for line in blocks(node, path))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if none) and ``n_chars`` (its code points)."""
    fields = [f for f in pages.schema.fields if f.name not in ("text", "n_chars")]

    def run(batches):
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(column))
            texts = [main_text(x.as_py()) for x in source]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "n_chars")]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [n for n, _ in kept] + ["text", "n_chars"],
            )

    return pages.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
