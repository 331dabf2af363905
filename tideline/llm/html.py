"""Main text of web pages by scores in the tree of their elements.

Paragraphs pass points for their length and commas to the elements around them; the
element with most points, less its share of link text, holds the article, together
with siblings that score near it. Menus, adverts, forms and the like are left out
before anything is scored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import map_batches

#: A tag with quoted attributes, and one up to the next bracket where quotes do not close.
TAG = re.compile(r"""</?([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
LOOSE_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to their end tag is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Elements that begin a block of text of their own.
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: An open element of the set ends where the named one begins, unless one of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
#: A stray end tag does not reach past these.
WALLS = frozenset("article aside body div footer form header html main nav section table td th".split())

#: Elements that hold no part of an article.
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog embed footer form frame frameset head iframe input label map math menu nav"
    " noembed noframes noscript object script select style svg template textarea title video xmp".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of a class or id that name what is no part of an article.
NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments cookie cookies"
    " disqus footer masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination popup"
    " promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
NAME_WORD = re.compile(r"[a-z0-9]+")
#: These are never left out for their names.
KEPT_WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Points of a paragraph besides one for each comma: one, and one for each so many characters, up to most.
CHARS_PER_POINT, MOST_LENGTH_POINTS = 100, 3.0
#: A paragraph with fewer characters passes no points unless nothing else does.
SCORED_CHARS = 25
#: What an ancestor gets of the points, by its distance from the paragraph; the rest share alike.
SHARES = (1.0, 0.5, 0.25, 0.125)
#: A sibling stays with this part of the best score, or as a paragraph of so many characters with few links.
SIBLING_SHARE, SIBLING_CHARS, FEW_LINKS = 0.2, 80, 0.25
#: Elements nested deeper stand beside each other, as in browsers.
MOST_DEPTH = 512
#: A list or box with so many links and hardly any other text is a menu.
MENU_LINKS, MENU_DENSITY = 3, 0.9


class Node:
    """An element: its place in the tree, texts and elements inside in page order."""

    __slots__ = ("tag", "parent", "depth", "children", "gone", "score", "chars", "link_chars", "links", "holds_article")

    def __init__(self, tag: str, parent: Node | None, gone: bool):
        self.tag, self.parent, self.gone = tag, parent, gone
        self.depth: int = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.score, self.chars, self.link_chars, self.links = 0.0, 0, 0, 0
        self.holds_article = False


def _left_out(tag: str, attributes: str, parent: Node) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in KEPT_WHOLE and tag != "article" or not attributes.strip(" /"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and not NAMES.isdisjoint(NAME_WORD.findall(value)):
            # an article that is named so is one of the comments only inside another
            if tag != "article" or _inside(parent, "article"):
                return True
    return False


def _inside(node: Node | None, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _close_before(node: Node, tag: str) -> Node:
    """The element that a new ``tag`` belongs to, after those that it ends."""
    if tag in BLOCKS:
        at = node
        while at is not None and at.tag not in WALLS:  # a block ends an open paragraph
            if at.tag == "p":
                node = at.parent
                break
            at = at.parent
    if tag in CLOSES:
        ended, walls = CLOSES[tag]
        at = node
        while at is not None and at.tag not in walls:
            if at.tag in ended:
                return at.parent
            at = at.parent
    if tag in HEADINGS and node.tag in HEADINGS:
        return node.parent
    return node


def _end(node: Node, tag: str) -> Node:
    """The element that is open after an end tag; stray end tags change nothing."""
    at = node
    while at is not None and at.parent is not None:
        if at.tag == tag or tag in HEADINGS and at.tag in HEADINGS:
            return at.parent
        if at.tag in WALLS and tag not in WALLS:
            return node
        at = at.parent
    return node


def parse(page: str) -> Node:
    """The tree of a page. Any text gives one; each character is looked at a bounded number of times."""
    root = node = Node("html", None, False)
    at, n, strict, low = 0, len(page), True, ""
    while at < n:
        opened = page.find("<", at)
        if opened < 0:
            opened = n
        if opened > at:
            node.children.append(entities.unescape(page[at:opened]) if "&" in page[at:opened] else page[at:opened])
        if opened == n:
            break
        after = page[opened + 1 : opened + 2]
        if page.startswith("<!--", opened):
            closed = page.find("-->", opened + 2)
            at = n if closed < 0 else closed + 3
            continue
        if after in ("!", "?") or after == "/" and not page[opened + 2 : opened + 3].isalpha():
            closed = page.find(">", opened)
            at = n if closed < 0 else closed + 1
            continue
        m = TAG.match(page, opened) if strict and after else None
        if m is None and (after == "/" or after.isascii() and after.isalpha()):
            m = LOOSE_TAG.match(page, opened)
            if m is None:  # the page ends inside a tag
                break
            strict = False  # from here on a quote has no end
        if m is None:
            node.children.append("<")
            at = opened + 1
            continue
        at = m.end()
        tag, attributes = m[1].lower(), m[2]
        if after == "/":
            if tag == "br" or tag == "p" and not _inside(node, "p"):
                node.children.append(Node(tag, node, False))
            else:
                node = _end(node, tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and node.tag == "head":
                node = node.parent
            continue
        node = _close_before(node, tag)
        made = Node(tag, node, _left_out(tag, attributes, node))
        node.children.append(made)
        if tag in RAW:
            m = RAW_END[tag].search(page, at)
            made.gone = True
            if m is None:
                break
            closed = page.find(">", m.end())
            at = n if closed < 0 else closed + 1
        elif tag not in VOID and not attributes.endswith("/") and made.depth < MOST_DEPTH:
            node = made
    return root


def _in_order(root: Node):
    """All nodes, parents before children."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _prune(nodes: list[Node]) -> None:
    """Mark what is left out: pages' headers, and what lies in elements left out.

    A form or box around the article itself is no part that goes. Of a header within
    an article only the headings stay.
    """
    for node in reversed(nodes):
        if node.tag in ("article", "main") or node.holds_article:
            if node.parent is not None and not (node.gone and node.tag == "article"):
                node.parent.holds_article = True
    for node in nodes:
        if node.parent is not None and node.parent.gone:
            node.gone = True
        elif node.tag == "form" and node.holds_article:
            node.gone = False
        elif node.tag == "header" and not node.holds_article:
            if _inside(node.parent, "article"):
                _headings_only(node)
            else:
                node.gone = True


def _headings_only(header: Node) -> None:
    """Leave nothing but the headings in the header of an article."""
    inner = [n for n in _in_order(header) if n is not header]
    headings = [n for n in inner if n.tag in HEADINGS and not n.gone]
    for node in inner:
        node.gone = True
    for heading in headings:
        heading.parent = header
        for node in _in_order(heading):
            node.gone = node.tag in LEFT_OUT
    header.children = list(headings)


def _measure(nodes: list[Node]) -> None:
    """Characters, link characters and links of what is not left out, from the leaves up."""
    for node in reversed(nodes):
        if node.gone:
            continue
        node.chars += sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.links += node.links
    for node in nodes:
        if node.gone or node.parent is not None and node.parent.gone:
            node.gone = True
        elif node.tag in ("ul", "ol", "dl", "div", "section", "table"):
            node.gone = node.links >= MENU_LINKS and _density(node) >= MENU_DENSITY


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _score(nodes: list[Node], least_chars: int) -> Node | None:
    """The element with most points after the discount for links; the first of equals."""
    for node in nodes:
        node.score = 0.0
    told: list[Node] = []
    for node in nodes:
        if node.gone or node.tag not in BLOCKS:
            continue
        own = _own_text(node)
        if len(own) < least_chars or not own:
            continue
        points = 1 + own.count(",") + min(len(own) / CHARS_PER_POINT, MOST_LENGTH_POINTS)
        # text that lies directly in a box, not in a paragraph, counts for the box itself
        at = node.parent if node.tag in ("p", "pre", "td", "li", "blockquote") or node.tag in HEADINGS else node
        distance = 0
        while at is not None:
            if at.tag in BLOCKS:
                if not at.score:
                    told.append(at)
                at.score += points * SHARES[min(distance, len(SHARES) - 1)]
                distance += 1
            at = at.parent
    best = max(told, key=lambda x: x.score * (1 - _density(x)), default=None)
    return best


def _own_text(node: Node) -> str:
    """Text of a block that lies in no inner block, white space as one blank."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif not c.gone and c.tag not in BLOCKS:
            stack.extend(reversed(c.children))
    return " ".join("".join(parts).split())


def _kept_roots(best: Node) -> list[Node]:
    """The best element, or the article around it, and siblings that belong to it."""
    at = best
    while at is not None:
        if at.tag in ("article", "main") and not _inside(at.parent, "article"):
            best = at
            if at.tag == "article":
                break
        at = at.parent
    if best.parent is None:
        return [best]
    least = SIBLING_SHARE * best.score * (1 - _density(best))
    kept = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif isinstance(c, Node) and not c.gone and c.tag in BLOCKS:
            score = c.score * (1 - _density(c))
            prose = c.tag in ("p", "pre", "blockquote") and c.chars >= SIBLING_CHARS and _density(c) < FEW_LINKS
            if score and score >= least or prose or c.tag in HEADINGS and best.tag not in ("article", "main"):
                kept.append(c)
    return kept


def _blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(roots))
    while stack:
        c = stack.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif not c.gone:
            if c.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(c.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The text of the article of a page, one line a block; empty if there is none.

    Character references are decoded and white space inside a block is one blank. A
    page without elements is one block; a null or empty page has no text. Nested
    elements of any depth are taken, and broken markup is read as browsers do.
    """
    if not page:
        return ""
    nodes = list(_in_order(parse(page)))
    _prune(nodes)
    _measure(nodes)
    best = _score(nodes, SCORED_CHARS) or _score(nodes, 1)
    return "\n".join(_blocks(_kept_roots(best))) if best else ""


def extract(df: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` of every row with ``text`` and its code points ``n_chars``.

    Null and empty pages give an empty text, repeated rows are repeated; an empty
    table gives no rows. No shuffle: one page is held as a tree at a time.
    """
    kinds = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        texts = pa.array([main_text(p) for p in batch.column(len(keys)).to_pylist()], pa.string())
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"text": texts}

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "text string"])
    return map_batches(df.select(*keys, html), run, schema).withColumn("n_chars", F.length("text").cast("bigint"))
