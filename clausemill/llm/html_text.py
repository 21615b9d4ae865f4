"""Main text of web pages by composite text density.

Every DOM node gets its characters, tags, link characters and link tags.  Its
composite density is the characters a tag, damped by a logarithm whose base grows
with the share of link text (Sun, Song and Liao, "DOM based content extraction
via text density", 2011).  A node's density sum adds its children's densities.  The
node of the largest sum is the core of the article, and the smallest density on its
path up to body is the threshold that other content has to reach.

An <article> or <main> around the core, or one with half of the text, is the article
as a whole.  Elsewhere the subtree grows from the core to its parents, as long as what
they add is content: headings, or paragraphs and the like that reach the threshold and
are not mostly links.  So the parts of a text that is cut into sections or columns stay
together in page order, and of what was added only blocks of links go.

The whole page is parsed into a tree first, with the end tags that HTML lets authors
omit.  Scripts, styles and the like never enter it.  Navigation, asides, forms and
elements whose class, id or role names boilerplate or reader comments are then taken
out, unless they hold the article: the largest <article> or <main> that is no comment
or, on pages without one, more than half of the text with a main heading or several
paragraphs.  So a class such as ``has-sidebar`` on a wrapper, a form around the page
or a <nav> that is never closed costs nothing.  Inside an <article> or <main> a name
counts only if it has no other words than such as name boilerplate, and never on a
heading: ``ad-box`` goes, ``tracking-a-storm`` stays.  Densities are computed on what is
left.

Defined results: null or empty html gives an empty text; broken or cut markup is
closed at the end; a page whose body has no text gives an empty text; of equal
density sums the longer text counts, and of equal lengths the first in page order;
repeated rows pass through one for one; columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
OUTSIDE = frozenset("head script style noscript template iframe object svg canvas button select option textarea input label title map audio video".split())
#: Elements that are never part of an article, but may be left open or wrapped around one.
STRUCTURAL = frozenset("nav footer aside form dialog menu".split())
#: Elements whose edges separate blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that can hold text; a line break is a tag of its block.
NODES = BLOCKS - {"br", "hr"}
#: An opening tag closes these when they are still open, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body article section div main ul ol dl table tbody thead tfoot td th blockquote aside nav header footer form figure details".split())
#: Words in class, id and role that name boilerplate, and those that name what readers wrote.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs consent contentinfo cookie cookies copyright disclaimer"
    " dropdown footer form gdpr header hidden login masthead menu menus modal nav navbar navigation navlinks newsletter notice notices notification overlay pager pagination paywall popup"
    " promo promoted promotion recommend recommended recommendations related search share sharing sidebar signup skip skyscraper social sponsor sponsored sponsors"
    " subscribe subscription tagcloud tags toolbar topbar tracking widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus feedback remark remarks replies reply respond responses review reviews".split())
#: Words that make a name say something about another element, as in has-sidebar, and words that make a header the article's own.
ABOUT = frozenset("has no not with without is show open closed enabled disabled on off".split())
CONTENT = frozenset("article content entry main post story section".split())
#: Words that say no more about an element than its place or form.
FORM = frozenset(
    "area bar block body bottom box btn button buttons card cell col column container fixed float global group hd holder inner item items js left line link links list mini module new"
    " outer page pane panel right row site slot small sticky title top unit wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the text of an article.
TEXTUAL = HEADINGS | frozenset("p blockquote pre li dd td figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s=>/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+)>",
    re.S,
)
_ALONE = re.compile(r"(?<!=)(?:^|[\s\"'])/\s*\Z")
_CUT = re.compile(r"<[!/a-zA-Z][^>]*\Z")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


class _Node:
    __slots__ = ("chars", "children", "density", "kind", "link_chars", "link_tags", "loose", "own", "parent", "parts", "sure", "sum", "tag", "tags", "textual")

    def __init__(self, tag: str, parent: _Node | None, kind: str = "", sure: bool = True):
        self.tag, self.parent, self.kind, self.sure = tag, parent, kind, sure
        self.children: list[_Node] = []
        self.parts: list[str | _Node] = []  # texts and child nodes in page order
        self.chars = self.own = self.tags = self.link_chars = self.link_tags = self.textual = 0
        self.density = self.sum = 0.0


def _kind(tag: str, attributes: str) -> tuple[str, bool]:
    """What an element's tag and names say it is: boilerplate, comments, hidden, or nothing; and whether they say nothing else."""
    found, sure = ("boilerplate", True) if tag in STRUCTURAL else ("", False)
    for m in _NAMED.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "hidden", True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "hidden", True
            continue
        for token in html.unescape(value).split():
            parts = set(_PARTS.findall(_CAMEL.sub(" ", token).lower()))
            if parts & ABOUT or parts & CONTENT and "header" in parts:
                continue
            only = parts <= BOILERPLATE | COMMENTS | FORM
            if tag in ("article", "main", "h1"):  # never boilerplate; an article may be what a reader wrote
                if tag == "article" and only and parts & COMMENTS:
                    return "comments", True
            elif parts & COMMENTS:
                if only or found != "comments":
                    found, sure = "comments", only
            elif parts & BOILERPLATE and found != "comments":
                found, sure = "boilerplate", sure or only
    return found, sure


def _closed(node: _Node, tags: frozenset | set, stops: frozenset) -> _Node:
    """Where the page goes on once the nearest open element of ``tags`` is closed, if there is one below the stops."""
    up = node
    while up.parent and up.tag not in tags and up.tag not in stops:
        up = up.parent
    return up.parent if up.tag in tags and up.parent else node


def parse(page: str) -> _Node:
    """The DOM of a page, without the elements whose content is never text."""
    root = node = _Node("html", None)
    at, skip, depth = 0, "", 0  # skip: the element being left out and its nesting
    articles = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        text, at = page[at : m.start()], m.end()
        if text and not skip:
            node.parts.append(html.unescape(text))
        if m[3] is None:
            if m[1] and not skip:
                node.parts.append(m[1])
            continue
        tag, closing, alone = m[3].lower(), bool(m[2]), bool(m[4]) and bool(_ALONE.search(m[4]))
        if not closing and tag in RAW:  # jump over content that is not markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skip and (tag in BLOCKS or tag == "body") and skip in ("option", "label", "head"):  # their end tags may be missing
            skip = ""
        if skip:
            if tag == skip:
                depth += -1 if closing else 0 if alone else 1
                if not depth:
                    skip = ""
            continue
        if closing:
            up = node
            while up.parent and up.tag != tag and not (up.tag in CONTAINERS and tag not in CONTAINERS):
                up = up.parent
            if up.tag == tag and up.parent:
                while node is not up.parent:
                    articles -= node.tag in ("article", "main")
                    node = node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS and tag not in ("br", "hr"):  # a block ends an open paragraph
            node = _closed(node, {"p"}, CONTAINERS)
        if tag in CLOSES:
            node = _closed(node, CLOSES[tag], CONTAINERS - CLOSES[tag])
        if tag in OUTSIDE:
            if tag not in VOID and not alone:
                skip, depth = tag, 1
            continue
        kind, sure = ("boilerplate", True) if tag == "header" and not articles else _kind(tag, m[4])
        if articles and (not sure or tag in HEADINGS) and kind != "hidden":  # inside an article, names with other words say nothing
            kind = ""
        child = _Node(tag, node, kind, sure)
        node.children.append(child)
        node.parts.append(child)
        if tag not in VOID and not alone:
            node = child
            articles += tag in ("article", "main")
    if not skip:
        node.parts.append(html.unescape(_CUT.sub("", page[at:])))
    return root


def prune(root: _Node) -> _Node:
    """Take out boilerplate and comments, but nothing that holds the article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    chars: dict[_Node, int] = {}
    for node in reversed(order):
        node.own = sum(len(word) for p in node.parts if isinstance(p, str) for word in p.split())
        chars[node] = node.own + sum(chars[c] for c in node.children)
    written = [n for n in order if n.tag == "article" and n.kind == "comments"]
    if len(written) == 1 and not any(n.tag in ("article", "main") and n.kind != "comments" for n in order):
        written[0].kind = ""  # the page's only article may be a review itself
    out: set[_Node] = set()  # inside comments or hidden
    for node in order:
        if node.parent in out or node.kind in ("comments", "hidden"):
            out.add(node)
    mains = [n for n in order if n.tag in ("article", "main") and n not in out and chars[n]]
    main = max(mains, key=lambda n: chars[n], default=None)
    holds = set()
    while main is not None:
        holds.add(main)
        main = main.parent
    below: dict[_Node, tuple[int, int]] = {}  # main headings and paragraphs with text
    for node in reversed(order):
        own = (int(node.tag == "h1"), int(node.tag == "p" and chars[node] > 0))
        below[node] = tuple(map(sum, zip(own, *(below[c] for c in node.children), strict=True)))

    def stays(node: _Node) -> bool:
        if not node.kind or node in holds:
            return True
        wrapper = not mains and 2 * chars[node] > chars[root] and (below[node][0] > 0 or below[node][1] > 1)
        return wrapper and node.kind == "boilerplate"

    for node in order:
        gone = {c for c in node.children if not stays(c)}
        if gone:
            node.children = [c for c in node.children if c not in gone]
            node.parts = [" " if p in gone else p for p in node.parts]
    return root


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Composite text density of one node's counts."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * lc + body_ratio * chars + math.e)
    return chars / t * math.log(chars / lc * t / lt + 1) / max(1.0, math.log(base + math.e - 1))


def _measure(root: _Node) -> list[_Node]:
    """Fill in counts and densities; returns the block nodes, parents first.

    Inline elements count as tags of their block.  A block's text outside its
    child blocks stands as one more child in its density sum.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        own = node.own
        inline = [c for c in node.children if c.tag not in NODES]
        node.chars = own + sum(c.chars for c in node.children)
        node.tags = sum(c.tags + 1 for c in node.children)
        node.loose = [own + sum(c.loose[0] for c in inline), sum(c.loose[1] + 1 for c in inline)]
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in node.children)
        node.link_tags = sum(c.link_tags for c in node.children) + (node.tag == "a")
        node.textual = (node.chars if node.tag in TEXTUAL else sum(c.textual for c in node.children)) if node.link_chars * 2 < node.chars else 0
        node.loose += [node.loose[0] if node.tag == "a" else sum(c.loose[2] for c in inline), sum(c.loose[3] for c in inline) + (node.tag == "a")]
    body_ratio = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, body_ratio)
        node.sum = sum(c.density if c.tag in NODES else c.sum for c in node.children)  # of an inline element: its blocks
        if node.tag in NODES:
            node.sum += _density(*node.loose, body_ratio)
    return [node for node in order if node.tag in NODES]


def _linked(node: _Node) -> bool:
    """Whether a block is a list of links rather than text."""
    return node.link_chars * 2 >= node.chars and node.tag in NODES - TEXTUAL


def article(root: _Node) -> tuple[_Node | None, set[_Node]]:
    """The subtree that holds the article, and the blocks of links in it that do not belong to it."""
    full = [n for n in _measure(root) if n.chars]
    if not full:
        return None, set()
    best = max(full, key=lambda n: (n.sum, n.chars))  # the first of equals, as nodes come in page order
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path if n.tag in NODES)
    whole = max((n for n in full if n.tag in ("article", "main")), key=lambda n: n.chars, default=None)
    around = [n for n in path if n.tag in ("article", "main")]
    if around:
        # an article is a whole; a main element around it is one if it holds more than that
        inner = next((n for n in around if n.tag == "article"), around[0])
        return max([inner, *(n for n in around if n.chars > 2 * inner.chars)], key=lambda n: n.chars), set()
    if whole is not None and 2 * whole.chars >= root.chars:
        return whole, set()
    top, out, held = best, {c for c in best.children if c.chars and _linked(c)}, best
    for up in path[1:]:
        others = [c for c in up.children if c is not held and c.chars]
        held = up
        added = [c for c in others if not _linked(c) and c.textual and (c.tag in HEADINGS or c.density >= threshold)]
        if added:
            top = up
            out |= {c for c in others if _linked(c)}
        elif others or up.own:
            if up.tag in NODES:
                break
    return top, out


def text_of(node: _Node | None, out: set[_Node] = frozenset()) -> str:
    """Blocks of a subtree without those of ``out`` in page order, white space made single, joined by a space."""
    blocks, run = [], []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    stack: list = [node] if node is not None else []
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        else:
            block = item.tag in BLOCKS
            if block:
                flush()
            if item in out:
                continue
            if block:
                stack.append(None)
            stack.extend(reversed(item.parts))
    flush()
    return " ".join(blocks)


def extract(page: str | None) -> str:
    """Main text of one page."""
    return text_of(*article(prune(parse(page)))) if page else ""


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLES: dict[str, str] = {}
