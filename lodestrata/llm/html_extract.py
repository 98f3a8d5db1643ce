"""Main text of web pages by tree scoring.

A forgiving parser builds the element tree of a page.  Every paragraph earns
points for its length and its commas and passes them up: all to its parent, half
to the grandparent, a third to the next and so on.  A container's points are
discounted by its link density.  The best container is kept together with those
of its siblings that score near it or read like prose; from these the blocks are
written in page order.

Null or empty html gives an empty text.  Unclosed elements, stray end tags, raw
``<`` signs and pages cut off in the middle of a tag are read as browsers do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import batch, rows_of, short_batches

#: A quote sign is one only behind an equals sign; elsewhere in a tag it is a letter like others.
TAG = r"""</?[a-zA-Z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*(?:>|\Z)"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|" + TAG + r"|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:[\s=>/]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")

# Element names by what the HTML standard says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
P_BARRIER = frozenset("table td th button object template".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe object embed svg canvas math audio video map menu dialog label input noembed noframes xmp".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
CONTAINER = frozenset("article main section div body td blockquote html".split())
OWN_KIND = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

HEAD = frozenset("base basefont bgsound head html link meta title noscript noframes style script template".split())
#: An inline end tag inside these does not end what is around them, nor does a list item inside these one around them.
APART = (BLOCK | DROPPED) - {"label", "canvas", "audio", "video", "map", "object", "embed"}

# Words in class, id and role that mark what is not the article.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets comment comments commentlist disqus reply replies respond pagination pager tags rating print search copyright legal disclaimer contentinfo complementary skip".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main page post story text blog".split())
#: In names like page-with-sidebar, which say what else is on the page.
LAYOUT = frozenset("with without has no".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "parent", "kids", "points", "marks", "good", "chars", "link_chars", "lost", "open_p", "inside")

    def __init__(self, name: str, parent: Node | None, marks: frozenset[str] = frozenset()):
        self.name, self.parent, self.kids, self.points, self.marks = name, parent, [], 0.0, marks
        self.good, self.chars, self.link_chars = bool(marks & GOOD_WORDS), 0, 0
        self.lost = parent is not None and parent.lost
        # the paragraph that a block here would end, and whether an article is around
        self.open_p = self if name == "p" else parent.open_p if parent is not None and name not in P_BARRIER else None
        self.inside = name in ("article", "main") or parent is not None and parent.inside


def _marks(tag: str) -> frozenset[str]:
    out: set[str] = set()
    for name in " ".join(a or b or c for a, b, c in MARKS.findall(tag)).split():
        words = SPLIT.split(CAMEL.sub(" ", name).lower())
        if not LAYOUT.intersection(words):
            out.update(words)
    return frozenset(out)


def parse(html: str, by_marks: bool = True) -> Node:
    """The tree of a page without the subtrees that can't hold article text; by_marks: nor those whose class, id or role says so.

    A dropped element is opened and ended as any other, but hangs on no parent's list.
    """
    root = node = Node("html", None)
    raw, opened = "", Counter()

    def close(at: Node) -> None:
        """End an open element and all that is open in it."""
        nonlocal node
        while node is not at.parent:
            opened[node.name] -= 1
            node = node.parent

    for m in TOKEN.finditer(html):
        t = m.group()
        if raw:  # up to its end tag, all is text
            if t[:2] == "</" and (n := NAME.match(t)) and n[1].lower() == raw:
                raw = ""
                close(node)
            continue
        if t[0] != "<" or t == "<":
            if node.name == "head" and t.strip():
                close(node)
            if not node.lost:
                node.kids.append(t)
            continue
        if t[1] in "!?":
            continue
        if not (n := NAME.match(t)):
            continue
        name = n[1].lower()
        if t[1] == "/":
            at = _open(node, name) if opened[name] else None
            if at is not None:
                close(at)
            continue
        if t[-1] != ">":  # the page ends inside this tag
            continue
        if opened["head"] and (name == "body" or node.name == "head" and name not in HEAD):  # ends an open head
            at = node
            while at.parent is not None and at.name not in ("head", "template"):
                at = at.parent
            if at.name == "head":
                close(at)
        if name in VOID:
            if not node.lost:
                node.kids.append(" ") if name in ("br", "wbr") else name == "hr" and node.kids.append(Node("hr", node))
            continue
        if name == "body" or name == "html":
            continue
        if name in CLOSES_P and node.open_p is not None:
            close(node.open_p)
        if name in OWN_KIND:
            kind, within = OWN_KIND[name]
            at = node
            while any(opened[k] for k in kind.split()) and at.parent is not None and at.name not in within.split():
                if at.name in kind.split():  # of a cell and its row, a row ends both
                    close(at)
                elif at.lost and _stops(at, name):
                    break
                at = at.parent
        marks = _marks(t) if "=" in t and not node.lost else frozenset()
        kid = Node(name, node, marks)
        bad = kid.lost or name in DROPPED or (name == "header" and not node.inside) or HIDDEN.search(t) or (by_marks and marks & BAD_WORDS and name not in ("article", "main", "p", "h1") and not _in_sentence(node, name) and not marks & {"article", "articlebody"})
        if bad:
            if t.endswith("/>") and name == "svg":
                continue
            kid.lost = True
            raw = name if name in RAW else ""
        else:
            node.kids.append(kid)
        opened[name] += 1
        node = kid
    return root


def _in_sentence(node: Node, name: str) -> bool:
    """Whether an inline element stands behind words of its parent, and so is part of a sentence whatever its class says."""
    return name not in BLOCK and bool(node.kids) and isinstance(node.kids[-1], str) and node.kids[-1].rstrip()[-1:].isalnum()


def _stops(at: Node, name: str) -> bool:
    """Whether an item, row or cell of that name inside the dropped element at leaves open what is around it."""
    return at.name == "template" or name in ("li", "dt", "dd", "option") and at.name in APART and at.name not in ("address", "div", "p")


def _open(node: Node, name: str) -> Node | None:
    """The open element that an end tag ends, if there is one."""
    within = OWN_KIND[name][1].split() if name in OWN_KIND else ()
    at = node
    while at.parent is not None and at.name != name:
        if at.lost and (at.name in ("template", "object", "svg", "math", "select") or at.name in within or (name not in APART and at.name in APART)):
            return None
        at = at.parent
    return at if at.parent is not None else None


def _measure(root: Node) -> list[Node]:
    """Fill in the text lengths from the leaves up; the elements in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    for n in reversed(order):
        for k in n.kids:
            if isinstance(k, Node):
                n.chars += k.chars
                n.link_chars += k.link_chars
            else:
                n.chars += len(k.strip())
        if n.name == "a":
            n.link_chars = n.chars
    return order


def _words(n: Node) -> str:
    parts, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            stack.extend(reversed(x.kids))
    return "".join(parts)


def score(root: Node) -> tuple[Node, list[Node]]:
    """The best container and, in page order, all that is kept of its siblings and itself."""
    order = _measure(root)
    touched: dict[int, Node] = {}
    for n in order:
        own = n.name in PARAGRAPH and not any(isinstance(k, Node) and k.name in BLOCK for k in n.kids)
        if not own and n.name in CONTAINER:  # text of its own counts as a paragraph of its own
            text = "".join(k for k in n.kids if isinstance(k, str)).strip()
            up: Node | None = n
        else:
            text, up = (_words(n).strip() if own else ""), n.parent
        if len(text) < 2:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3) + len(text) / 400
        share = 1
        while up is not None and share <= 6:
            if up.name in CONTAINER:
                up.points += points / share
                touched[id(up)] = up
                share += 1
            up = up.parent
    if not touched:
        return root, [root]
    value = {}
    for k, n in touched.items():
        bonus = 1.25 if n.name in ("article", "main") or n.good else 1.0
        value[k] = n.points * bonus * (1 - n.link_chars / max(n.chars, 1))
    best = max(touched.values(), key=lambda n: value[id(n)])
    at: Node | None = best
    while at is not None:  # an article's container is the article
        if at.name in ("article", "main"):
            best = at
            break
        at = at.parent
    if best.parent is None:
        return best, [best]
    least, kept = max(10.0, 0.2 * value.get(id(best), 0.0)), []
    for k in best.parent.kids:
        if k is best:
            kept.append(k)
        elif isinstance(k, Node):
            density = k.link_chars / max(k.chars, 1)
            near = value.get(id(k), 0.0) >= least or (k.name == best.name and k.marks == best.marks and k.name == "article")
            prose = k.name in PARAGRAPH and (k.chars > 80 and density < 0.25 or 0 < k.chars <= 80 and density == 0 and re.search(r"[.!?]\s*$", _words(k)))
            heading = re.fullmatch(r"h[1-6]", k.name) and density < 0.5
            if near and density < 0.5 or prose or heading:
                kept.append(k)
    return best, kept


def blocks(kept: list[Node]) -> str:
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = SPACE.sub(" ", unescape("".join(line))).strip()
            line.clear()
            if text:
                out.append(text)

    stack: list = list(reversed(kept))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        else:
            edge = x.name in BLOCK
            if edge:
                close()
                stack.append(None)
            stack.extend(reversed(x.kids))
    close()
    return "\n".join(out)


def main_text(html: str | None) -> str:
    """The text of one page; empty if there is none.

    A page that its classes and ids would leave empty is read again without them.
    """
    if not html:
        return ""
    return blocks(score(parse(html))[1]) or blocks(score(parse(html, by_marks=False))[1])


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns, text and n_chars for each row of pages; other columns are ignored."""
    short_batches(pages.sparkSession)
    slim = pages.select(*keep, pages[html].cast("string").alias("__html"))
    fields = [f"{n} {t}".replace("bigint", "long") for n, t in slim.dtypes[:-1]]
    schema = ", ".join([*fields, "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*ids, htmls) in rows_of(batches, *keep, "__html"):
            texts = [main_text(h) for h in htmls]
            yield batch(schema, text=texts, n_chars=[len(t) for t in texts], **dict(zip(keep, ids)))

    return slim.mapInArrow(run, schema)
