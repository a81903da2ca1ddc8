"""The main text of web pages: a scored tree of blocks.

A page's markup is read once into a tree of block elements; text that no block boundary divides is one paragraph. Each
paragraph earns points for its length and its commas, less by the share of its text that lies in links, and passes
them to its ancestors: all to its container, half to the next, a third, a quarter and so on from there. A container's
points are multiplied where its name or class says article, and by the share of its text outside of links. The
best container is kept, or the article or main element around it; without one it grows to those of its
ancestors below the body that have a fifth more of good text. Then siblings with a fifth of its points, or of plain sentences, join it.

What is no part of an article earns nothing and is left out: menus, headers (but for headings of an article), footers,
sidebars, notices, adverts, forms, scripts, styles, hidden elements and reader comments, by element, role, class and id;
and in what is kept, lists of nothing but links. Where classes and ids would leave nothing, they don't count; where
forms would leave nothing, they stay.

Defined results: a null or empty page, and one without text, has an empty text; markup that ends in the middle, is wrongly
nested or not closed is read about as browsers do; white space is what str.split takes for it, a no-break space and `<br>` included; of
equal containers the first is kept; rows that repeat are rows of their own; pages are worked one after the other, whole,
whatever their length; an empty table gives an empty one; an input column with the name of a new one is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomspan.llm.text import chunks

# Names of HTML elements
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())  #: what they hold is no markup
UNSEEN = RAW | frozenset("audio button canvas datalist head map math noscript object picture progress select svg template video".split())
OUTSIDE = frozenset("aside dialog footer header menu nav search".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search status tablist toolbar tooltip".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = ("td", "th")
ROWS = ("tr", *CELLS)
#: the open elements that a start tag ends, and those that bound the search for them
ENDED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}
ENDED |= dict.fromkeys(CELLS, (CELLS, ("table",))) | {"tr": (ROWS, ("table",))} | dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", *ROWS), ("table",)))
KEEPS_P = frozenset("option tbody td tfoot th thead tr".split())  #: blocks that don't end a paragraph
#: words of classes and ids that name what is no article; each also stands for its plural
OUTSIDE_NAMES = frozenset(
    "ad adbox advert advertisement advertising adsbygoogle adslot adunit alert banner breadcrumb captcha comment commentlist consent cookie cookiebar dialog discussion disqus feedback "
    "footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain pager pagination paywall popover popup promo promotion "
    "recommendation recommended related reply respond response share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription taboola teaser toolbar "
    "tooltip topbar trending widget".split()
)
ENDINGS = ("advert", "banner", "comment", "footer", "menu", "nav", "navbar", "popup", "sidebar")  #: topnav, usercomments
OF_ARTICLES = frozenset("ad advert advertisement comment promo recommended related reply response sponsored teaser".split())  #: what also names an article that is none
ARTICLE_NAMES = frozenset("article articlebody blog body content entry hentry main page post story text".split())
NEGATED = frozenset("no not has have with without is".split())  #: has-sidebar is no sidebar
#: how far outside an element is
NAMED, IN_FORM, ELSEWHERE, INVISIBLE = 1, 2, 3, 4

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<=[\s\"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?![^\s=>/])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
COMMAS = re.compile("[,،、，;；]")


def _words(value: str) -> list[list[str]]:
    """The words of each name of a class or id, in lower case and without plural; names that say no, has or with are left out."""
    found = [[w.lower().removesuffix("s") for w in WORDS.findall(name)] for name in value.split()]
    return [[*words, "".join(words)] for words in found if words and not NEGATED.intersection([*words, words[0] + "s"])]


class Node:
    """A block element, or another that is left out, and the text below it that counts."""

    __slots__ = ("article", "blocks", "factor", "linked", "links", "name", "own", "out", "points", "raw", "size", "up")

    def __init__(self, name: str, up: Node | None, attributes: str = "") -> None:
        self.name, self.up = name, up
        self.points = self.raw = 0.0  # passed on by paragraphs; of all paragraphs below
        self.size = self.linked = self.links = 0
        self.blocks = False  # whether blocks stand in it
        self.own, self.article, self.factor = INVISIBLE if name in UNSEEN else ELSEWHERE if name in OUTSIDE else IN_FORM if name in ("form", "fieldset") else 0, name in ("article", "main"), 1.0
        if attributes and not attributes.isspace():
            self._look(attributes)
        if self.article:
            self.factor = 1.5
        self.out = max(self.own, up.out) if up else 0
        if name in HEADINGS and self.own == 0 and self.out and self._heads_article():
            self.out = 0

    def _look(self, attributes: str) -> None:
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
        role = set(found.get("role", "").lower().split())
        self.article |= bool(role & {"main", "article"}) or "articlebody" in found.get("itemprop", "").lower()
        names = _words(html.unescape(found.get("class", "") + " " + found.get("id", "")))
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDING.search(html.unescape(found.get("style", ""))):
            self.own = INVISIBLE
        elif role & OUTSIDE_ROLES:
            self.own = max(self.own, ELSEWHERE)
        elif self.article:
            self.own = max(self.own, NAMED if any(words[0] in OF_ARTICLES for words in names) else 0)
        elif any(w in OUTSIDE_NAMES or w.endswith(ENDINGS) for words in names for w in words if w != "header" or self.name not in HEADINGS):
            self.own = max(self.own, NAMED)
        elif any(w in ARTICLE_NAMES for words in names for w in words):
            self.factor = 1.25

    def _heads_article(self) -> bool:
        """Whether a heading lies outside only by a header of an article."""
        node, outside = self.up, 0
        while node and node.out:
            outside += node.own > 0
            last, node = node, node.up
        return outside == 1 and (last.name == "header" or last.own == NAMED) and any(n.article for n in ancestors(node))


def ancestors(node: Node | None) -> Iterator[Node]:
    """A node and those around it, from the inside out."""
    while node:
        yield node
        node = node.up


class Paragraph:
    """A run of text without a block boundary in it."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked

    @property
    def points(self) -> float:
        length = len(self.text)
        return (min(length / 25, 1.0) + len(COMMAS.findall(self.text)) + min(length / 100, 3.0)) * (1 - self.share)

    @property
    def share(self) -> float:
        return min(1.0, self.linked / len(self.text))


class Page:
    """The paragraphs of a page in order, and the tree that they stand in. Body and html are its root."""

    def __init__(self, source: str) -> None:
        self.nodes, self.paragraphs = [Node("html", None)], []
        self._open = self.nodes[:]
        self._text: list[str] = []
        self._linked: list[str] = []
        self._link: Node | None = None  # the block in which a link was opened
        at = 0
        for token in iter(lambda: TOKEN.search(source, at), None):
            self._add(source[at : token.start()])
            at, name = token.end(), (token["name"] or "").lower()
            if token["end"]:
                self._end(name)
            elif name in RAW:
                self._boundary(name)
                end = CLOSING[name].search(source, at)
                at = end.start() if end else len(source)
            elif name:
                self._start(name, token["more"])
        self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        if text and self._open[-1].out < INVISIBLE:
            self._text.append(text)
            if self._link:
                self._linked.append(text)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split()) if self._text else ""
        if text:
            linked = len(" ".join(html.unescape("".join(self._linked)).split())) if self._linked else 0
            self.paragraphs.append(Paragraph(self._open[-1], text, linked))
        self._text, self._linked = [], []

    def _boundary(self, name: str) -> None:
        """Some elements that aren't seen still divide words."""
        if name in ("iframe", "textarea"):
            self._add(" ")

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._add(" ")
        elif name == "a":
            self._link = self._open[-1]
            self._link.links += 1
        elif name in ("html", "body"):
            self._close(("head",), ())
        elif name in BLOCKS:
            self._flush()
            if name not in KEEPS_P:
                self._close(("p",), ("table", "caption", *CELLS))
            if name in ENDED:
                self._close(*ENDED[name])
            elif name in HEADINGS and self._open[-1].name in HEADINGS:
                self._close((self._open[-1].name,), ())
            if name != "hr":
                self._open[-1].blocks = True
                self._push(Node(name, self._open[-1], attributes))
        elif name not in VOID and not attributes.endswith("/"):
            node = Node(name, self._open[-1], attributes) if attributes or name in UNSEEN else None
            if node and node.own:
                self._flush() if node.own != INVISIBLE else None
                self._push(node)

    def _push(self, node: Node) -> None:
        self.nodes.append(node)
        self._open.append(node)

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = None
        if name in BLOCKS:
            self._flush()
        if name not in ("html", "body"):
            self._close((name,), ("table",) if name in ("caption", "tbody", "thead", "tfoot", *ROWS) else () if name in ("table", *UNSEEN) else ("table", "caption", *CELLS))

    def _close(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """End the outermost open element of these names within the innermost of bounds, and what is open in it."""
        last = 0
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i].name
            if name in names:
                last = i
                if len(names) == 1:
                    break
            elif name in bounds or (len(names) == 1 and name in BLOCKS and names[0] not in BLOCKS and names[0] not in UNSEEN):
                break
        if last:
            if self._open[-1].out < INVISIBLE:
                self._flush()
            if self._link in self._open[last:]:
                self._link = None
            del self._open[last:]


def main_text(source: str) -> str:
    """The article of a page's markup: its blocks in page order, with an empty line between."""
    page = Page(source)
    parts: list[Paragraph] = []
    for most in (NAMED, IN_FORM, ELSEWHERE):
        parts = parts or [p for p in page.paragraphs if p.node.out < most]
    if not parts:
        return ""
    for p in parts:
        points = p.points
        inner = p.node if p.node.blocks or not p.node.up else p.node.up
        for i, node in enumerate(ancestors(inner)):
            node.points += points / (i + 1)
        for node in ancestors(p.node):
            node.raw += points
            node.size += len(p.text)
            node.linked += p.linked
    for node in reversed(page.nodes):
        if node.up:
            node.up.links += node.links
    best = max((n for n in page.nodes if n.size), key=lambda n: n.points * n.factor * (1 - n.linked / n.size))
    around = [n for n in ancestors(best) if n.article]
    if around:
        best = next((n for n in around if n.name == "article"), around[-1])
    else:
        for node in ancestors(best):
            best = node if node.up and node.raw >= 1.2 * best.raw else best
    kept = []
    for p in parts:
        way = list(ancestors(p.node))
        if best in way:
            inside = way[: way.index(best)]
        elif best.up in way:
            inside = way[: way.index(best.up)]
            plain = not inside or (len(inside) == 1 and not inside[0].blocks)
            if not (plain and _sentences(p)) and not (inside and inside[-1].raw >= max(2.0, best.raw / 5)):
                continue
        else:
            continue
        if not any(n.links >= 3 and n.linked >= 0.8 * n.size for n in inside):
            kept.append(p.text)
    return "\n\n".join(kept)


def _sentences(p: Paragraph) -> bool:
    """Whether a paragraph beside the best container reads as text: long with few links, or a sentence without any; or is a heading."""
    if p.node.name in HEADINGS:
        return p.linked == 0
    return p.share < 0.25 if len(p.text) > 80 else p.linked == 0 and p.text.endswith((".", "!", "?", "。"))


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """pages with text, the article of each whole page, and n_chars, its code points. Columns of these names are replaced."""
    pages = pages.select(*(c for c in pages.columns if c not in {text, "n_chars"} or c == source))
    schema = StructType([*(f for f in pages.schema.fields if f.name not in (text, "n_chars")), StructField(text, StringType()), StructField("n_chars", LongType())])
    at = pages.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column=source):
            found = [main_text(x) if x else "" for x in batch.column(at).to_pylist()]
            kept = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in (text, "n_chars")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], schema.names)

    return pages.mapInArrow(run, schema)
