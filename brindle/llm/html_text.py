"""Main text of web pages by composite text density.

A page is parsed into a tree. Elements that hold menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or comments of readers go
(by element or role; by a word of class or id only if the element holds no
article or main and less than half of the body's text). Each node's composite density
is its characters per tag, lowered by the share of its characters and tags
that belong to links. A node's density sum adds its children's densities.
The least density on the path from the body to the densest node is the
threshold: of the nodes that reach it, the one with the largest density sum
is the main subtree, widened to the article or main element around it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import filled

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript iframe nav aside footer form button select textarea template svg canvas object embed dialog menu title xmp noembed noframes input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices sidebar nav navbar navigation menu menus footer masthead breadcrumb breadcrumbs comment comments disqus respond newsletter subscribe subscription popup modal toolbar pagination pager".split())
CLOSES_P = BLOCK - {"button", "body", "html", "caption", "option", "optgroup", "legend", "thead", "tbody", "tfoot", "tr", "td", "th"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_WRAPPER = re.compile(r"\b(?:with|has|have|no|without)[\W_]*(?:left|right)?[\W_]*[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "kids", "parent", "dropped", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.named, self.kids = tag, parent, dropped, False, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _drop(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("article", "main", "body", "html"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.strip().lower() in DROPPED_ROLES:
            return True
    return False


def _named(tag: str, attributes: str) -> bool:
    """Whether a word of class or id is one of boilerplate; with-sidebar and the like name what is around it."""
    if not attributes or tag in ("article", "main", "body", "html"):
        return False
    values = (_WRAPPER.sub(" ", _CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
    return any(not DROPPED_WORDS.isdisjoint(_WORD.findall(v)) for v in values)


def _drop_named(root: Node) -> None:
    """Drops elements with a name of boilerplate that hold no article or main and less than half of the body's text."""
    nodes = _order(root)
    if not any(x.named for x in nodes):
        return
    chars: dict[Node, int] = {}
    whole: set[Node] = set()
    for x in reversed(nodes):
        chars[x] = sum(len("".join(k.split())) if type(k) is str else chars.get(k, 0) for k in x.kids)
        if x.tag in ("article", "main") or any(k in whole for k in x.kids if type(k) is Node):
            whole.add(x)
    body = next((chars[x] for x in nodes if x.tag == "body"), chars[root])
    for x in nodes:
        x.dropped = x.named and x not in whole and 2 * chars[x] < body


def parse(page: str) -> Node:
    """The tree of a page; dropped elements are in it, marked."""
    root = top = Node("#root", None, False)
    articles, at, n = 0, 0, len(page)
    lower = None
    opened: Counter[str] = Counter()  # on the way from the root to top
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at and not top.dropped:
            top.kids.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing and not opened[tag]:
            continue
        if closing:
            x = top
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                while top is not x.parent:
                    articles -= top.tag in ("article", "main")
                    opened[top.tag] -= 1
                    top = top.parent
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            ends, stop = CLOSED_BY.get(tag, ()), SCOPES.get(tag, ("table",))
            x, found = top, None
            while x is not root and x.tag not in ("table", "td", "th", "button") or x.tag in ends:
                if x.tag in ends or x.tag == "p" and tag in CLOSES_P:
                    found = x
                elif x.tag in stop or x.tag in BLOCK and x.tag != "p" and not ends:
                    break
                x = x.parent
            if found is not None:
                while top is not found.parent:
                    opened[top.tag] -= 1
                    top = top.parent
        node = Node(tag, top, top.dropped or _drop(tag, attributes, articles > 0))
        node.named = not node.dropped and _named(tag, attributes)
        top.kids.append(node)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == n else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            end = n if end < 0 else end
            if not node.dropped:
                node.kids.append(page[at:end])
            at = page.find(">", end) + 1 or n
        elif tag not in VOID and not attributes.endswith("/"):
            top = node
            opened[tag] += 1
            articles += tag in ("article", "main")
    if at < n and not top.dropped:
        top.kids.append(page[at:])
    _drop_named(root)
    return root


def _order(root: Node) -> list[Node]:
    out = [root]
    for x in out:
        out.extend(k for k in x.kids if type(k) is Node and not k.dropped)
    return out


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and sums; the nodes, parents first."""
    nodes = _order(root)
    for x in reversed(nodes):
        x.chars += sum(len(k) - k.count(" ") for k in x.kids if type(k) is str and not k.isspace())
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags + 1
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags
    whole = nodes[0]
    share = whole.link_chars / max(1, whole.chars)
    for x in nodes:
        tags, links = max(1, x.tags), max(1, x.link_tags)
        if x.chars:
            plain = max(1, x.chars - x.link_chars)
            base = math.log(x.chars / plain * x.link_chars + share * x.chars + math.e)
            x.density = max(0.0, x.chars / tags * math.log(max(1.0, x.chars / max(1, x.link_chars) * tags / links)) / base) if base > 0 else 0.0
    for x in nodes:
        x.sum = sum(k.density for k in x.kids if type(k) is Node and not k.dropped)
    return nodes


def main_subtree(root: Node) -> Node:
    nodes = measure(root)
    bodies = [x for x in nodes if x.tag == "body"]
    body = bodies[0] if bodies else root
    densest = max(nodes, key=lambda x: x.density)
    threshold, x = densest.density, densest
    while x is not None:
        threshold = min(threshold, x.density)
        x = None if x is body else x.parent
    best = max((x for x in nodes if x.density >= threshold), key=lambda x: x.sum, default=body)
    if best.sum == 0:
        best = body
    x, wide = best, None
    while x is not None:
        if x.tag in ("article", "main"):
            wide = x
        x = x.parent
    if wide is None and best is not body and best.chars < body.chars and best.tag in ("p", "li", "ul", "ol", "td", "tr", "b", "span", "a", "h1", "h2", "h3"):
        best = best.parent or best
    return wide or best


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif type(x) is str:
            held.append(x)
        elif not x.dropped:
            if x.tag in ("br", "wbr"):
                held.append(" " if x.tag == "br" else "")
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.kids))
    end()
    return out


def main_text(page: str) -> str:
    return "\n".join(blocks(main_subtree(parse(page))))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in filled(batch.column("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one line feed in page order. A null, empty or
    text-free page gives an empty text. Pages of any size and nesting are
    read whole; other columns of pages are not read.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
