"""Main text of HTML pages by composite text density.

A page is read into a tree. Elements that never belong to an article (scripts, menus, hidden ones) are cut off. Forms and
blocks whose class or id names a notice, an advert, a menu or comments are marked, since page wrappers can be forms and
have such names, too. Marked nodes are taken out if they hold neither the longest article nor the longest main element
and leave at least half of the page's unlinked characters, or half of those of such an element that then holds a tenth of
the page's; as long as they would leave less, the name with the most of them no longer counts as a mark on that page. For each node, the density is its characters per tag,
weighted down by the share of characters and tags that lie in links. The node whose children's densities have the largest sum is the article;
an ``article`` or ``main`` element around it is taken whole. The least density on the path from it to the body is the
threshold below which blocks in it that mostly consist of links are left out.

Defined results: a null page is empty and has the empty text, as has a page without text. Null ids and urls are kept.
Repeated rows are extracted each. An empty table gives an empty table. Columns other than ``page_id``, ``url`` and
``html`` are not read.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame, functions as F

from .common import arrow_map

#: Element names by their role in HTML, and words that name side matter in a class or an id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    "script style textarea title head iframe noembed noframes noscript template object svg canvas audio video nav aside "
    "footer button select input dialog menu datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",),
}
SCOPES = frozenset("ul ol dl table td th body html article section div main blockquote form".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice overlay pagination paywall "
    "popup promo promoted promotion recommended related replies respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    """An element; ``content`` holds its texts and child nodes in page order."""

    __slots__ = ("tag", "parent", "content", "marks", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None, marks: frozenset = frozenset()):
        self.tag, self.parent, self.content, self.marks = tag, parent, [], marks
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def side_marks(tag: str, attrs: str, inside: bool) -> frozenset | None:
    """The names that mark an element as side matter, or None if it is that for certain; ``inside``: within an article,
    where a header holds the title."""
    if tag in NEVER or tag == "header" and not inside:
        return None
    marks = {"<form>"} if tag == "form" else set()
    if not attrs.strip() or tag in ("html", "body", "article", "main"):
        return frozenset(marks)
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            marks |= SIDE_WORDS.intersection(w.lower() for w in WORDS.findall(value))
        if name == "role" and value.lower() == "form":
            marks.add("<form>")
        if name == "role" and value.lower() in SIDE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return None
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return None
    return frozenset(marks)


def tree(html: str) -> Node:
    """The page without what is side matter for certain. Missing end tags are implied as browsers do for paragraphs, items and cells."""
    root = node = Node("html", None)
    skipped: list[str] = []  # open elements inside side matter
    articles, at, end = 0, 0, len(html)

    def close_to(name: str, stops: frozenset) -> None:
        nonlocal node, articles
        up = node
        while up.parent is not None and up.tag != name:
            if up.tag in stops:
                return
            up = up.parent
        if up.parent is None:
            return
        while node is not up:
            articles -= node.tag in ("article", "main")
            node = node.parent
        articles -= node.tag in ("article", "main")
        node = node.parent

    while at < end:
        token = TOKEN.search(html, at)
        if token is None:
            text, at = html[at:], end
        else:
            text, at = html[at : token.start()], token.end()
        if text and not skipped:
            node.content.append(unescape(text))
        if token is None or not token["name"]:
            continue
        name = token["name"].lower()
        if token["end"]:
            if skipped:
                if name in skipped:
                    while skipped.pop() != name:
                        pass
                elif name in ("body", "html"):
                    skipped.clear()
            elif name not in ("body", "html"):
                close_to(name, frozenset())
            continue
        raw_end = None
        if name in RAW:
            raw_end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            at = raw_end.start() if raw_end else end
        if skipped:
            if name not in VOID and not token["attrs"].endswith("/"):
                if name in ("li", "p", "option", "tr", "td") and skipped[-1] == name:
                    skipped.pop()
                skipped.append(name)
            continue
        if name in CLOSES_P:
            close_to("p", SCOPES)
        for sibling in SIBLINGS.get(name, ()):
            close_to(sibling, frozenset(("ul", "ol", "dl", "table")))
        if name in ("html", "body"):
            continue
        marks = side_marks(name, token["attrs"], articles > 0)
        if marks is None or marks and name in VOID:
            if name not in VOID:
                skipped.append(name)
            node.content.append(" ")
            continue
        made = Node(name, node, marks)
        node.content.append(made)
        if name not in VOID:
            node = made
            articles += name in ("article", "main")
    return root


def measure(root: Node) -> list[Node]:
    """Fill in counts and densities; all nodes, parents first."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        todo += [c for c in node.content if isinstance(c, Node)]
    for node in reversed(nodes):
        for part in node.content:
            if isinstance(part, Node):
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
            else:
                node.chars += len(" ".join(part.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = root.link_chars / max(root.chars, 1)
    for node in nodes:
        if node.chars:
            tags, other = max(node.tags, 1), max(node.chars - node.link_chars, 1)
            spread = (node.chars / max(node.link_chars, 1)) * (tags / max(node.link_tags, 1))
            base = 1 + math.log(node.chars / other * node.link_chars + share * node.chars + math.e)
            node.density = node.chars / tags * math.log(1 + spread) / math.log(base)
    return nodes


def unlinked(node: Node) -> int:
    return node.chars - node.link_chars


def without_side(root: Node) -> list[Node]:
    """Take the marked nodes out, as far as they are side matter; all nodes left, measured."""
    nodes = measure(root)
    if not any(n.marks for n in nodes):
        return nodes
    at = {id(n): i for i, n in enumerate(nodes)}  # a node's descendants are the next ``tags`` nodes
    holders: set[int] = set()
    named = []
    for tag in ("article", "main"):
        up = max((n for n in nodes if n.tag == tag), key=unlinked, default=None)
        named += [up] if up else []
        while up is not None:
            holders.add(id(up))
            up = up.parent
    believed = frozenset().union(*(n.marks for n in nodes))
    while True:
        side, todo, by_name = [], [root], dict.fromkeys(believed, 0)
        while todo:
            node = todo.pop()
            if not node.marks.isdisjoint(believed) and id(node) not in holders:
                side.append(node)
                for name in node.marks & believed:
                    by_name[name] += unlinked(node)
            else:
                todo += [c for c in node.content if isinstance(c, Node)]
        left = [unlinked(n) - sum(unlinked(c) for c in side if at[id(n)] <= at[id(c)] <= at[id(n)] + n.tags) for n in (root, *named)]
        whole = unlinked(root)
        if 2 * left[0] >= whole or any(10 * x >= whole and 2 * x >= unlinked(n) for x, n in zip(left[1:], named)):
            break
        believed -= {max(sorted(by_name), key=by_name.get)}
    gone = {id(n) for n in side}
    for up in {id(n.parent): n.parent for n in side}.values():
        up.content = [" " if id(c) in gone else c for c in up.content]
    return measure(root)


def article(root: Node) -> tuple[Node, float]:
    """The node with the largest sum of child densities, and the least density on its path to the body."""
    best, most = root, -1.0
    for node in without_side(root):
        total = sum(c.density for c in node.content if isinstance(c, Node))
        if total > most:
            best, most = node, total
    while best.parent is not None and (best.tag in INLINE or best.tag == "p"):
        best = best.parent
    around = best
    while around.parent is not None:
        if around.tag in ("article", "main"):
            best = around
        around = around.parent
    threshold, up = best.density, best
    while up is not None:
        threshold, up = min(threshold, up.density), up.parent
    return best, threshold


def main_text(html: str | None) -> str:
    best, threshold = article(tree(html or ""))
    parts: list[str] = []
    todo: list[Node | str] = [best]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            parts.append(part)
            continue
        if part is not best and part.tag not in INLINE and part.density < threshold and 2 * part.link_chars > part.chars:
            parts.append(" ")
            continue
        if part.tag in INLINE:
            todo += reversed(part.content)
        else:
            todo += [" ", *reversed(part.content), " "]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def rows(batch: dict) -> dict:
        return {"page_id": batch["page_id"], "url": batch["url"], "text": [main_text(x) for x in batch["html"]]}

    made = arrow_map(pages.select("page_id", "url", "html"), rows, "page_id bigint, url string, text string")
    return made.withColumn("n_chars", F.char_length("text").cast("bigint"))
