"""A small HTML parser: pages to trees of tags and texts, forgiving like browsers are, to any depth in linear time."""

from __future__ import annotations

import html
import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: Start tags that end an open p, and what else ends where a like element begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
WALLS = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr"))}

_MARKUP = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element: its tag, the words of its class, id and role, and its texts and elements in order."""

    __slots__ = ("kids", "names", "tag")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.names, self.kids = tag, names, []

    @property
    def label(self) -> str:
        return ".".join((self.tag, *self.names))


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    words = {w for _, a, b, c in _ATTRIBUTE.findall(attributes) for w in _DIGITS.sub("0", (a or b or c).lower()).split()}
    return tuple(sorted(words))


def parse(page: str) -> Node:
    """The tree of a page, under a node of its own."""
    root = Node("#page")
    stack, at, n = [root], 0, len(page)
    opened: Counter[str] = Counter()  # tags on the stack, so that what is not open is not looked for

    def add_text(raw: str) -> None:
        if raw:
            stack[-1].kids.append(html.unescape(raw) if "&" in raw else raw)

    def close(tags: tuple[str, ...], walls: frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in walls:
                return

    while at < n:
        found = _MARKUP.search(page, at)
        if not found:
            add_text(page[at:])
            break
        add_text(page[at : found.start()])
        at = found.end()
        slash, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue  # a comment or a declaration
        tag = tag.lower()
        if slash:
            if tag not in VOID:
                close((tag,), frozenset(("article", "main", "body", "table")) if tag in INLINE or tag == "p" else frozenset())
            continue
        if tag in ENDS_P:
            close(("p",), frozenset(("button", "td", "th", "table", "object")))
        if tag in ENDS:
            for _ in range(2):
                close(ENDS[tag], WALLS.get(tag, frozenset(("table", "select"))))
        node = Node(tag, _names(attributes))
        stack[-1].kids.append(node)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            node.kids.append(page[at:stop])
            at = page.find(">", stop) + 1 if end else n
            if end and at == 0:
                at = n
            continue
        stack.append(node)
        opened[tag] += 1
    return root
