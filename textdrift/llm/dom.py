"""HTML pages as blocks of text and as summary trees, and the simple tree matching of two of these."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Element names by their role, and words in class, id and role attributes that name
# page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section
summary table tbody td tfoot th thead tr ul""".split())
SKIPPED = frozenset("""script style noscript template svg math iframe object select button textarea title audio video
canvas datalist""".split())
FURNITURE = frozenset("nav aside footer form menu dialog search".split())
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo
promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices
notification popup modal newsletter subscribe subscription signup share sharing social related recommended comment
comments commentlist disqus respond reply replies widget widgets pagination pager toolbar login masthead alert
navigation banner contentinfo complementary topbar dialog search""".split())
PAGE_HEADER_WORDS = frozenset(["header", "masthead", "topbar"])
COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
REPEATED = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
#: An open element of the second kind ends where one of the first kind starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
        "tfoot": {"tbody", "tr", "td", "th"}}
#: ... but not one outside of these.
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
          "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
DEEPEST, ALIKE = 60, 16


@dataclass
class Block:
    """A run of text between block boundaries: its place in the summary tree, whether it lies in an
    ``article`` or in ``main``, and how much of it is link text."""

    text: str
    node: int
    article: bool
    main: bool
    links: int


@dataclass
class Page:
    """The blocks of a page without furniture, and its summary tree: (depth, label) in page order.

    Repeated elements (paragraphs, list items, rows) of one parent are one node of the summary, all
    others each their own, up to ``ALIKE`` with the same label; below ``DEEPEST`` levels nodes are
    taken as their ancestor there."""

    blocks: list[Block] = field(default_factory=list)
    depths: list[int] = field(default_factory=lambda: [0])
    labels: list[str] = field(default_factory=lambda: ["#"])
    parents: list[int] = field(default_factory=lambda: [-1])
    repeated: dict[tuple[int, str], list[int]] = field(default_factory=dict)
    order: dict[int, int] = field(default_factory=dict)

    def skeleton(self) -> str:
        """The summary tree as text, in preorder; ``order`` has each node's place there."""
        children: dict[int, list[int]] = {}
        for i, p in enumerate(self.parents):
            children.setdefault(p, []).append(i)
        out, todo, self.order = [], [0], {}
        while todo:
            i = todo.pop()
            self.order[i] = len(out)
            out.append(f"{self.depths[i]} {self.labels[i]}")
            todo.extend(reversed(children.get(i, ())))
        return "\n".join(out)


class _Element:
    __slots__ = ("tag", "node", "depth", "furniture", "article", "main", "nth")

    def __init__(self, tag, node, depth, furniture, article, main):
        self.tag, self.node, self.depth = tag, node, depth
        self.furniture, self.article, self.main, self.nth = furniture, article, main, {}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _furniture(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is page furniture; ``inside`` an article, a header belongs to it."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
    if not names or tag in ("html", "body", "main"):
        return False
    names = re.sub(r"\b(?:has|with|no|without)[-_]\w+", " ", names)
    words = set(_WORD.findall(names))
    if tag == "article":
        return bool(words & COMMENT_WORDS)
    return bool(words & FURNITURE_WORDS) or not inside and bool(words & PAGE_HEADER_WORDS)


def _label(tag: str, attributes: dict[str, str]) -> str:
    return ".".join([tag, *sorted(set(_WORD.findall(attributes.get("class", "").lower())))])


def parse(page: str) -> Page:
    """The page's blocks in order and its summary tree. Malformed markup is mended as browsers do:
    open paragraphs, items and cells end where the next one starts, stray end tags are ignored."""
    out = Page()
    stack = [_Element("#", 0, 0, False, False, False)]
    text: list[str] = []
    links, link_depth, skip = 0, 0, None

    def flush() -> None:
        nonlocal links
        top = stack[-1]
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block and not top.furniture:
                out.blocks.append(Block(block, top.node, top.article, top.main, links))
            text.clear()
        links = 0

    def pop_to(size: int) -> None:
        nonlocal link_depth
        flush()
        del stack[size:]
        if link_depth > len(stack):
            link_depth = 0

    for m in _TOKEN.finditer(page):
        tag = m["tag"]
        if skip is not None:
            if tag is not None and m["end"] and tag.lower() == skip:
                skip = None
            continue
        if tag is None:
            if m["text"] is not None:
                text.append(m["text"])
                if link_depth:
                    links += len(m["text"].strip())
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                link_depth = 0
            elif tag in BLOCKS and tag not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
        elif tag in SKIPPED:
            if not m["attributes"].endswith("/"):
                skip = tag
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            link_depth = len(stack)
        elif tag in BLOCKS:
            flush()
            if tag in ("html", "body") and any(e.tag == tag for e in stack):
                continue
            ends, scope = ENDS.get(tag), SCOPES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    break
            if ends:
                last = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in ends:
                        last = i
                if last is not None:
                    pop_to(last)
            if tag == "hr":
                continue
            attributes, parent = _attributes(m["attributes"]), stack[-1]
            furniture = parent.furniture or _furniture(tag, attributes, parent.article or parent.main)
            label = _label(tag, attributes)
            node = _summary_node(out, parent, tag, label)
            main = parent.main or tag == "main" or attributes.get("role") == "main"
            stack.append(_Element(tag, node, parent.depth + 1, furniture, parent.article or tag == "article", main))
    flush()
    return out


def _summary_node(page: Page, parent: _Element, tag: str, label: str) -> int:
    if parent.depth >= DEEPEST:
        return parent.node
    known = (page.repeated.setdefault((parent.node, label), []) if tag in REPEATED
             else parent.nth.setdefault(label, []))
    if known and (tag in REPEATED or len(known) >= ALIKE):
        return known[-1]
    page.depths.append(parent.depth + 1)
    page.labels.append(label)
    page.parents.append(parent.node)
    known.append(len(page.labels) - 1)
    return known[-1]


class Tree:
    """A summary tree, read from its text."""

    def __init__(self, skeleton: str):
        lines = [line.split(" ", 1) for line in skeleton.split("\n")]
        self.labels = [label for _, label in lines]
        self.children: list[list[int]] = [[] for _ in lines]
        path: list[int] = []
        for i, (depth, _) in enumerate(lines):
            del path[int(depth):]
            if path:
                self.children[path[-1]].append(i)
            path.append(i)


def align(a: Tree, b: Tree) -> list[int]:
    """For every node of ``b`` its node of ``a``, or -1: the simple tree matching with most nodes.
    Matched nodes have equal labels, matched parents, and the order of their siblings."""
    scores: dict[tuple[int, int], int] = {}

    def table(x: int, y: int) -> list[list[int]]:
        left, right = a.children[x], b.children[y]
        rows = [[0] * (len(right) + 1)]
        for c in left:
            above, row = rows[-1], [0]
            for j, d in enumerate(right):
                best = max(above[j + 1], row[j])
                if a.labels[c] == b.labels[d]:
                    best = max(best, above[j] + score(c, d))
                row.append(best)
            rows.append(row)
        return rows

    def score(x: int, y: int) -> int:
        if (x, y) not in scores:
            scores[x, y] = 1 + (table(x, y)[-1][-1] if a.children[x] and b.children[y] else 0)
        return scores[x, y]

    out = [-1] * len(b.labels)
    todo: list[tuple[int, int]] = [(0, 0)] if a.labels[0] == b.labels[0] else []
    while todo:
        x, y = todo.pop()
        out[y] = x
        rows, left, right = table(x, y), a.children[x], b.children[y]
        i, j = len(left), len(right)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((left[i], right[j]))
    return out
