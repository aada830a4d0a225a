"""A forgiving HTML reader: elements with implied ends, hashes of subtrees, and blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
# An opening tag ends open elements of the first group unless one of the second stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
# Elements that are never part of an article's text.
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe object embed canvas svg math head title button select "
    "textarea input dialog menu search audio video map xmp noembed noframes datalist".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert status menu menubar toolbar form".split()
)
# Parts of class and id names that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "pagination pager share sharing social related recommended comment comments commentlist disqus respond replies "
    "widget widgets login skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[\s_\-:./]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str]
    parts: list[Node | str] = field(default_factory=list)
    parent: Node | None = None
    hash: int = 0
    texts: bool = False

    def marks(self) -> set[str]:
        named = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"
        return {p.lower() for p in _PARTS.split(named) if p}


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _close(stack: list[Node], names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in barrier:
            return


_P = frozenset({"p"})
_P_BARRIER = frozenset("html body td th caption button object".split())


def parse(source: str) -> Node:
    """The tree of a page.  Unclosed, misnested and torn markup is read as browsers roughly do."""
    root = Node("#root", {})
    stack = [root]
    at, size = 0, len(source)
    while at < size:
        m = _MARKUP.search(source, at)
        if not m:
            stack[-1].parts.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(html.unescape(source[at : m.start()]))
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if m["end"] or m["end2"]:
            barrier = BLOCK if name not in BLOCK else frozenset({"table"} - {name})
            if name == "br":
                stack[-1].parts.append("\n")
            else:
                _close(stack, {name}, barrier)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in CLOSES_P:
            _close(stack, _P, _P_BARRIER)
        if name in ENDS:
            _close(stack, *ENDS[name])
        node = Node(name, _attributes(attrs) if attrs.strip(" /") else {}, parent=stack[-1])
        stack[-1].parts.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            body = source[at : end.start()]
            node.parts.append(html.unescape(body) if name in ("textarea", "title") else body)
            at = end.end()
        elif name not in VOID and not (attrs.endswith("/") and name in ("svg", "path")):
            stack.append(node)
    return root


def _walk(node: Node) -> list[Node]:
    """All nodes, parents before children, without recursion."""
    order, open_ = [], [node]
    while open_:
        n = open_.pop()
        order.append(n)
        open_ += [p for p in reversed(n.parts) if isinstance(p, Node)]
    return order


def hash_subtrees(root: Node) -> list[Node]:
    """Set the hash of each subtree (names and texts, attributes left out); parents before children."""
    order = _walk(root)
    for n in reversed(order):
        digest = xxhash.xxh64(n.name.encode())
        n.texts = False
        for p in n.parts:
            if isinstance(p, Node):
                digest.update(p.hash.to_bytes(8, "little"))
                n.texts |= p.texts
            else:
                words = " ".join(p.split())
                digest.update(words.encode("utf-8", "replace") + b"\0")
                n.texts |= bool(words)
        n.hash = digest.intdigest()
    return order


def _hidden(node: Node) -> bool:
    attrs = node.attrs
    style = attrs.get("style", "").replace(" ", "").lower()
    return (
        "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
    )


def dropped(root: Node) -> set[int]:
    """``id`` of every node that structure, role or name marks as no part of an article."""
    order = _walk(root)
    holds: set[int] = set()  # nodes with an article or the main part below them, and headings
    heads: set[int] = set()
    for n in order:
        mark = holds if n.name in ("article", "main") else heads if n.name in ("h1", "h2") else None
        if mark is not None:
            up = n.parent
            while up is not None and id(up) not in mark:
                mark.add(id(up))
                up = up.parent
    out: set[int] = set()
    inside: set[int] = set()
    for n in order:
        if n.parent is not None and (n.parent.name in ("article", "main") or id(n.parent) in inside):
            inside.add(id(n))
        if n.name in ("#root", "html", "body"):
            continue
        if n.name in DROPPED or _hidden(n):
            out.add(id(n))
        elif n.name == "header":
            if not (id(n) in inside and id(n) in heads):
                out.add(id(n))
        elif n.attrs:
            marks = n.marks()
            if n.name in ("article", "main"):
                if marks & COMMENTS:
                    out.add(id(n))
            elif id(n) not in holds and (marks & MARKS or n.attrs.get("role", "").lower() in ROLES):
                out.add(id(n))
    return out


def roots(root: Node, without: set[int]) -> list[Node]:
    """The outermost articles with text, else the main part, else the whole page."""
    articles, mains, open_ = [], [], [root]
    while open_:
        n = open_.pop()
        if id(n) in without:
            continue
        if n.name == "article":
            articles.append(n)
            continue
        if n.name == "main" or n.attrs.get("role", "").lower() == "main":
            mains.append(n)
        open_ += [p for p in reversed(n.parts) if isinstance(p, Node)]
    return articles or mains[:1] or [root]


def blocks(tops: list[Node], without: set[int]) -> list[str]:
    """Texts of the blocks in page order, white space turned into single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for top in tops:
        open_: list[Node | str | None] = [top]  # None marks the end of a block
        while open_:
            n = open_.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                run.append(n)
            elif id(n) not in without:
                if n.name == "br":
                    run.append("\n")
                if n.name in BLOCK:
                    flush()
                    open_.append(None)
                open_ += reversed(n.parts)
        flush()
    return out
