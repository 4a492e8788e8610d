"""Main text of web pages by composite text density.

A page becomes a flat table of nodes in document order.  Each node's composite
density is its characters per tag, adjusted for characters and tags in links; a
node's sum is that of its children's densities.  Whatever is boilerplate by its
element, role or name is cut off before counting, the body's descendant with
the largest sum is the core, and the smallest density on the path from body to
it is the threshold: the core grows to the article around it, and parts of it
that are below the threshold and mostly links go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.llm.common import table

#: Elements without content, and those whose content is no markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends: the nearest open element of these, unless one of the stops lies between.
ENDS = {t: ({"p"}, {"table", "td", "th", "button", "caption"}) for t in BLOCKS - {"body", "html", "option", "optgroup", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "legend"}}
ENDS |= {
    "li": ({"p", "li"}, {"ul", "ol", "menu", "dir", "table", "td"}),
    "dt": ({"p", "dt", "dd"}, {"dl", "table"}),
    "dd": ({"p", "dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that are never part of an article's text.
CUT = set(
    "script style noscript template iframe object embed svg canvas audio video form button select textarea input label"
    " nav aside footer menu dialog head title".split())
#: Of these, those that may hold a page's article; all but the second also what is most of its text outside the second.
WRAPPERS = set("form label dialog aside footer nav menu".split())
MENUS = set("nav menu footer".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id that name boilerplate.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar"
    " navigation menu topbar masthead breadcrumb breadcrumbs footer sidebar aside rail cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies"
    " discussion disqus respond responses reader related recommended recommendations share sharing social pagination pager"
    " widget toolbar search skip hidden".split())
KEEP = {"html", "body", "main", "article"}
_NAME = re.compile(r"[a-z]+")
_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>))", re.S)
_BROKEN_OFF = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str
    text: list[tuple[int, str]] = field(default_factory=list)  # piece of text, before which child
    children: list[int] = field(default_factory=list)
    cut: bool = False
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


def parse(html: str) -> list[Node]:
    """Nodes in document order, the first a root; unclosed and stray tags are mended as browsers mostly do."""
    nodes = [Node("#root", -1, "")]
    open_: list[int] = [0]
    at = 0

    def add(piece: str) -> None:
        if piece:
            node = nodes[open_[-1]]
            node.text.append((len(node.children), piece))

    def close(names: set[str], stops: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[k]].tag
            if tag in names:
                del open_[k:]
                return
            if tag in stops:
                return

    last = html.rfind(">") + 1
    html = html[:last] + _BROKEN_OFF.sub("", html[last:])
    while m := _TAG.search(html, at, last):
        add(html[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, set() if tag in BLOCKS else {"table", "td"})
            continue
        if tag in ENDS:
            close(*ENDS[tag])
        attributes = m[3] if m[3] is not None else m[4]
        nodes.append(Node(tag, open_[-1], attributes))
        nodes[open_[-1]].children.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
            open_.append(len(nodes) - 1)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            open_.append(len(nodes) - 1)
    add(html[at:])
    return nodes


def _named(node: Node) -> tuple[set[str], dict[str, str]]:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(node.attributes)}
    return set(_NAME.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())), found


def _boilerplate(node: Node) -> bool:
    return node.tag in CUT - {"form", "label"} or bool(node.attributes) and node.tag not in KEEP - {"article"} and bool(_named(node)[0] & NAMES)


def _article(nodes: list[Node], outer: list[int], titled: list[bool], size: list[int]) -> int:
    """The page's article of those in no other: with a title before others, outside boilerplate before others, then the longest; 0 if none."""
    if len(outer) < 2:
        return outer[0] if outer else 0
    within = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        within[i] = within[n.parent] or _boilerplate(n)
    return max(outer, key=lambda i: (titled[i], not within[i], size[i], -i))


def mark(nodes: list[Node]) -> None:
    """Cuts off boilerplate; what holds the page's article or main part, or most of its text, is not cut by name.

    Nor is it cut as a form or other wrapper.  Beside an article that has a title or stands in main, boilerplate may
    be longer than it.
    """
    inside = [False] * len(nodes)  # in an article or main
    nested = [False] * len(nodes)  # in an article
    beside = [False] * len(nodes)  # in what is named as boilerplate and too long to be cut
    holds = [False] * len(nodes)
    titled = [False] * len(nodes)
    size = [0] * len(nodes)
    plain = [0] * len(nodes)  # as size, without menus and footers
    outer = []
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        own = sum(len(t) for _, t in n.text) if n.tag not in RAW else 0
        size[i] += own
        plain[i] += own
        size[n.parent] += size[i]
        plain[n.parent] += plain[i] if n.tag not in MENUS else 0
        titled[n.parent] |= titled[i] or n.tag == "h1"
    for i, n in enumerate(nodes[1:], 1):
        inside[i] = inside[n.parent] or n.tag in ("article", "main")
        nested[i] = nested[n.parent] or n.tag == "article"
        if n.tag == "article" and not nested[n.parent]:
            outer.append(i)
    article = _article(nodes, outer, titled, size)
    for i in range(len(nodes) - 1, 0, -1):
        holds[i] |= i == article or nodes[i].tag == "main"
        holds[nodes[i].parent] |= holds[i]
    sure = bool(article) and (titled[article] or inside[nodes[article].parent])
    for i, n in enumerate(nodes[1:], 1):
        p = nodes[n.parent]
        beside[i] = beside[n.parent]
        most = 2 * size[i] > max(1, size[0])
        if p.cut or n.tag in CUT and not (n.tag in WRAPPERS and (holds[i] or n.tag not in MENUS and 2 * plain[i] > max(1, plain[0]) and not sure)):
            n.cut = True
            continue
        if n.tag == "header" and not inside[n.parent] and not holds[i]:
            n.cut = True
            continue
        if beside[i] and n.tag == "article" and not holds[i] and not most:
            n.cut = True
            continue
        if not n.attributes:
            continue
        names, attributes = _named(n)
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""))
        by_name = names & NAMES or "header" in names and not inside[i] and not titled[i] or attributes.get("role", "").lower() in ROLES
        if n.tag == "article" and nested[n.parent]:  # articles inside an article are readers' comments
            by_name = by_name or names
        by_name = by_name and n.tag not in KEEP - {"article"} and not holds[i]
        if hidden or by_name and (not most or sure and not nested[n.parent]):
            n.cut = True
        elif by_name:
            beside[i] = True


def weigh(nodes: list[Node]) -> None:
    """Composite densities and their sums, from the last node up."""
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.cut:
            continue
        n.chars += sum(len(t.strip()) for _, t in n.text)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if i:
            p = nodes[n.parent]
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.cut or not n.chars:
            continue
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = log(c / max(1, c - n.link_chars) * n.link_chars + share * c + e)
        n.density = c / t * log(max(1.0, c / lc * t / lt) + 1e-9) / log(max(base, 1.0000001)) if base > 1 else c / t
        if i:
            nodes[n.parent].total += n.density


def _path(nodes: list[Node], i: int) -> list[int]:
    out = []
    while i > 0:
        out.append(i)
        i = nodes[i].parent
    return out


def core(nodes: list[Node]) -> int:
    """The node whose subtree is the main text; 0 if the page has no text left."""
    mark(nodes)
    weigh(nodes)
    live = [i for i, n in enumerate(nodes) if not n.cut and n.chars]
    if not live:
        return 0
    best = max(live, key=lambda i: (nodes[i].total, -i))
    path = _path(nodes, best)
    threshold = min((nodes[i].density for i in path), default=0.0)
    titles = [i for i in live if nodes[i].tag == "h1"]
    if titles and not any(best in _path(nodes, i) for i in titles):  # the title above the core, if something holds both
        best = next((i for i in path if nodes[i].tag != "body" and nodes[i].tag != "html" and any(i in _path(nodes, k) for k in titles)), best)
    for i in path:  # the article, or main part, around the core
        if nodes[i].tag == "article":
            best = i
        elif nodes[i].tag == "main" and nodes[best].tag != "article":
            best = i
    if nodes[best].tag == "article" and (around := next((i for i in _path(nodes, best) if nodes[i].tag == "main"), 0)):
        headed = {k for t in titles for k in _path(nodes, t)}
        like = [i for i in nodes[nodes[best].parent].children if nodes[i].tag == "article" and not nodes[i].cut
                and 2 * nodes[i].link_chars <= nodes[i].chars and (i in headed or best not in headed)]
        if len(like) > 1:  # a main part of several articles
            best = around
    for i in live:
        n = nodes[i]
        if n.tag in ("ul", "ol", "div", "section", "p", "table") and n.link_tags >= 3 and n.density < threshold and 2 * n.link_chars > n.chars:
            n.cut = True
    return best


def blocks(nodes: list[Node], top: int) -> list[str]:
    """Text of the subtree's blocks in page order, references decoded, white space as one space, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    work: list[tuple[int, int, int]] = [(top, 0, 0)]  # node, next child, next piece of text
    while work:
        i, child, piece = work.pop()
        n = nodes[i]
        if not child and n.tag in BLOCKS:
            flush()
        while piece < len(n.text) and n.text[piece][0] <= child:
            held.append(n.text[piece][1])
            piece += 1
        if child < len(n.children):
            work.append((i, child + 1, piece))
            c = n.children[child]
            if nodes[c].tag in ("br", "hr"):
                held.append(" ")
            if not nodes[c].cut:
                work.append((c, 0, 0))
            elif nodes[c].tag in BLOCKS:
                flush()
        elif n.tag in BLOCKS:
            flush()
    flush()
    return out


def main_text(html: str) -> str:
    nodes = parse(html)
    top = core(nodes)
    return "\n".join(blocks(nodes, top)) if top or nodes[0].chars else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and the main text of each whole page in `out`; empty if there is none.

    Null and empty pages have none; a column named like `out` is replaced;
    repeated rows stay.
    """
    names = [c for c in (pages.columns if keep is None else keep) if c != out]
    source = pages.select(*names, F.col(html).alias("__mt_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h.as_py() or "") for h in b.column(len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*names, out])

    return source.mapInArrow(run, T.StructType([*(pages.schema[c] for c in names), T.StructField(out, T.StringType())]))


def op2(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
