"""HTML extraction by tree scoring.

A page is read into a tree; boilerplate elements are cut off.  Each paragraph gives points for its
length and commas to its ancestors, half as many per level; a container's points are discounted by its
share of link text.  The best container is kept with those siblings that score well or read as
text, and its blocks are written in page order.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from .common import by_value, map_texts

by_value(__name__)

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg select title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset("nav footer aside form button dialog menu head".split()) | RAW
# Words of class, id and role that mark what is not the article.
NOISE = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond disqus discussion share sharing "
    "social related recommended newsletter subscribe signup popup modal overlay breadcrumb breadcrumbs pagination pager toolbar widget "
    "skip login search complementary contentinfo alert copyright byline tags".split()
)
# Words that also name parts of an article: inside one they mark nothing.
INSIDE = frozenset("discussion search byline tags login social copyright alert skip header masthead".split())
KEEP = frozenset("article main content post entry body story text page".split())
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>|/?(?:[a-zA-Z!][^>]*)?\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("name", "parent", "kids", "away", "points", "text", "linked", "commas", "inside", "block", "open")

    def __init__(self, name: str, parent, away: bool):
        self.name, self.parent, self.away = name, parent, away
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        # The block an inline element stands in; a block counts the inline elements open in it, by name.
        self.block = self if parent is None or name in BLOCK else parent.block
        self.open: dict | None = {} if self.block is self else None
        self.kids: list = []
        self.points = 0.0
        self.text = self.linked = self.commas = 0


def _noisy(name: str, attributes: str, inside: bool) -> bool:
    if name in AWAY:
        return True
    if name == "header" and not inside:
        return True
    if not attributes:
        return False
    for m in NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display:\s*none", value)):
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            if key == "id" and name in HEADS:
                continue  # an anchor
            parts = set(re.split(r"[^a-z]+", value)) - (INSIDE if inside else frozenset())
            if parts & NOISE and not parts & KEEP or parts & {"comment", "comments", "sidebar", "advert", "ads", "cookie"}:
                return True
    return False


def parse(html: str) -> Node:
    """A tolerant tree: open paragraphs, items and cells end where the next block needs it."""
    root = Node("html", None, False)
    here, at = root, 0
    blocks: dict[str, int] = {}  # blocks open now, by name

    def leave(to: Node) -> None:
        """Ends what is open below ``to``; every element is left once."""
        nonlocal here
        while here is not to:
            count = blocks if here.block is here else here.block.open
            count[here.name] -= 1
            here = here.parent

    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            here.kids.append(html[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            # an inline end tag does not reach across a block
            if (blocks if name in BLOCK else here.block.open).get(name, 0):
                while here.name != name:
                    leave(here.parent)
                leave(here.parent)
            continue
        if name in BLOCK:
            # inline elements left open, and an open paragraph, end at the next block
            leave(here.block)
            if here is not root and (here.name == "p" or (here.name in HEADS and name in HEADS) or (here.name in ("li", "dd", "dt", "td", "th", "tr") and name == here.name)):
                leave(here.parent)
        node = Node(name, here, _noisy(name, m[3] or "", here.inside))
        here.kids.append(node)
        if name in VOID or (m[3] or "").rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        here = node
        count = blocks if node.block is node else node.block.open
        count[name] = count.get(name, 0) + 1
    if at < len(html):
        here.kids.append(html[at:])
    return root


def _weigh(root: Node) -> list[Node]:
    """Text, link text and commas per element, bottom up, and points of paragraphs to ancestors."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and not k.away)
    for node in reversed(order):
        own = [k for k in node.kids if isinstance(k, str)]
        node.text += sum(len(SPACE.sub(" ", k)) for k in own)
        node.commas += sum(k.count(",") + k.count("，") for k in own)
        if node.name == "a":
            node.linked = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    for node in order:
        direct = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.name in ("p", "pre", "blockquote", "td") or direct > 80:
            size = node.text - node.linked
            if size <= 0:
                continue
            points, up, share = 1 + node.commas + min(size / 100.0, 30.0), node.parent, 1.0
            while up is not None and share > 0.05:
                up.points += points * share
                up, share = up.parent, share / 2
    return order


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of blocks in page order; inline elements run together, a line break is a space."""
    buffer: list[str] = []

    def flush():
        text = SPACE.sub(" ", unescape("".join(buffer))).strip()
        if text:
            out.append(text)
        buffer.clear()

    stack = [iter([node])]
    names: list[str] = []
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            if names and names.pop() in BLOCK:
                flush()
            continue
        if isinstance(kid, str):
            buffer.append(kid)
        elif kid.name in ("br", "hr"):
            if kid.name == "hr":
                flush()
            buffer.append(" ")
        elif not kid.away:
            if kid.name in BLOCK:
                flush()
            names.append(kid.name)
            stack.append(iter([k for k in kid.kids if not _aside(kid, k)]))
    flush()


def _aside(parent: Node, kid) -> bool:
    """What an article's own header holds besides its headings."""
    return parent.name == "header" and not (isinstance(kid, Node) and (kid.name in HEADS or kid.kids and any(isinstance(x, Node) and x.name in HEADS for x in kid.kids)))


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


JOIN = "\n\n"


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by ``JOIN``; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    order = _weigh(root)
    scored = [n for n in order if n.points > 0]
    if not scored:
        # No paragraph anywhere: a declared article, or else the main part, is the text all the same.
        declared = [max((n for n in order if n.name == name and n.text), key=lambda n: n.text, default=None) for name in ("article", "main")]
        out: list[str] = []
        for node in [n for n in declared if n is not None][:1]:
            _blocks(node, out)
        return JOIN.join(out)
    value = lambda n: n.points * (1 - _density(n))
    best = max(scored, key=value)
    # A declared article that holds the best container is the article.
    up = best
    while up is not None:
        if up.name == "article":
            best = up
            break
        up = up.parent
    kept = [best]
    if best.parent is not None and best.name not in ("article", "main", "body", "html"):
        least = max(10.0, 0.2 * value(best))
        for sibling in best.parent.kids:
            if not isinstance(sibling, Node) or sibling.away or sibling is best:
                continue
            reads = sibling.name == "p" and sibling.text > 80 and _density(sibling) < 0.25
            if sibling.points > 0 and value(sibling) >= least or reads or sibling.name == "h1":
                kept.append(sibling)
        places = {id(k): i for i, k in enumerate(best.parent.kids)}
        kept.sort(key=lambda n: places[id(n)])
    elif best.name == "article" and best.parent is not None:
        kept = [k for k in best.parent.kids if isinstance(k, Node) and k.name == "article" and not k.away and (k is best or value(k) >= max(10.0, 0.2 * value(best)))]
    out = []
    for node in kept:
        _blocks(node, out)
    return JOIN.join(out)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, *keep, text, n_chars) for every row; a null or empty page has an empty text.

    Each page is read on its own, whole; other columns are ignored, rows that repeat are all returned.
    """
    def compute(texts):
        found = [main_text(x) for x in texts]
        return [found, [len(t) for t in found]]

    return map_texts(pages, html, [key, *keep], compute, "text string, n_chars long")
