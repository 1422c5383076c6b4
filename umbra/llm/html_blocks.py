"""HTML to a sequence of leaf blocks with their tag paths.

A tolerant single-pass reader: it follows open elements, closes what HTML closes
implicitly, skips markup that is never text, and ends a block at every block-level tag.
Paths are shared: a block points at its innermost element, which points at the one around
it, and equal paths are one object.  What is open is counted by name and by scope, so time
and memory grow with the page, however long or deep it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript title iframe textarea".split())
#: Of these, the ones whose content is code.
CODE = frozenset({"script", "style"})
#: Elements that do not end a block.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark math q s samp small span strike strong sub sup svg time tt u var object canvas".split())
#: Elements of another language: what is inside them ends no block, until one of ``BREAKOUT`` opens (which ends them).
FOREIGN = frozenset({"svg", "math"})
BREAKOUT = frozenset("blockquote body br center dd div dl dt embed h1 h2 h3 h4 h5 h6 head hr img li listing main menu meta ol p pre ruby section table article aside header footer nav form figure ul".split())
#: Foreign elements that hold HTML.
INTEGRATION = frozenset({"foreignobject"})
#: Inline elements whose text stands apart from its surroundings.
APART = frozenset("svg object canvas text tspan".split())
#: Elements that an end tag of a smaller one does not close.
SCOPE = frozenset("html body main article section aside nav header footer div table form ul ol dl td th blockquote figure".split())
#: What an opening tag closes first, if it is open within its scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_NEXT_TAG = re.compile(r"</?[a-zA-Z]|<!--")
_BODY_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Element:
    """An open element that makes blocks: its tokens, and the element around it (None: the page)."""

    __slots__ = ("parent", "tokens", "inner", "mask")

    def __init__(self, parent: Element | None, tokens: str):
        self.parent, self.tokens = parent, tokens
        self.inner: dict[str, Element] = {}
        self.mask: int | None = None  #: for readers of paths

    def child(self, tokens: str) -> Element:
        if tokens not in self.inner:
            self.inner[tokens] = Element(self, tokens)
        return self.inner[tokens]


class Block(NamedTuple):
    path: Element  #: the innermost open element
    text: str  #: references decoded, white space single
    linked: int  #: characters inside links


def _tokens(tag: str, attributes: str) -> str:
    """An element as words: its tag and the names in its class, id and role."""
    if not attributes or "=" not in attributes:
        return tag
    names = [tag]
    for key, *values in _ATTRIBUTE.findall(attributes):
        names += [f"{key[0].lower()}:{n}" for n in _NAME.findall("".join(values).lower())]
    return " ".join(names)


class _Open:
    """The open elements: a stack, with counts that tell what it holds without a walk."""

    def __init__(self):
        self.tags: list[str] = []
        self.elements = [Element(None, "")]  # for each open element the innermost one that makes blocks
        self.counts: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # the same, since each open scope
        self.foreign: list[tuple[int, bool]] = []  # places of svg and math (True) and of HTML in those

    def push(self, tag: str, element: Element) -> None:
        if tag in FOREIGN or tag in INTEGRATION:
            self.foreign.append((len(self.tags), tag in FOREIGN))
        self.tags.append(tag)
        self.elements.append(element)
        self.counts[tag] += 1
        if tag in SCOPE:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][tag] += 1

    def pop(self) -> str:
        tag = self.tags.pop()
        self.elements.pop()
        self.counts[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        if self.foreign and self.foreign[-1][0] == len(self.tags):
            self.foreign.pop()
        return tag

    def close(self, names: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of these names, unless a wider one is between."""
        held = self.counts if names & SCOPE else self.scopes[-1]
        if any(held[name] for name in names):
            while self.pop() not in names:
                pass

    @property
    def in_foreign(self) -> bool:
        """Inside svg or math, and not in HTML inside those."""
        return bool(self.foreign) and self.foreign[-1][1]


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    found: list[Block] = []
    open_ = _Open()
    words: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                found.append(Block(open_.elements[-1], text, linked))
            words.clear()
        linked = 0

    endless: set[str] = set()  # raw elements without an end tag in the rest of the page
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[7]:
            text = html.unescape(m[7]) if "&" in m[7] else m[7]
            words.append(text)
            if open_.counts["a"]:
                linked += len(text)
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        inside = open_.in_foreign
        if tag in APART and (inside or tag in INLINE):
            words.append(" ")
        if m[1] or m[4]:
            if tag not in INLINE and not (inside and tag not in BREAKOUT and tag not in SCOPE):
                flush()
            open_.close({tag})
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                stop = None if tag in endless else _BODY_END[tag].search(page, at)
                if stop:
                    at = stop.end()
                else:  # only the tag goes, and code up to the next tag
                    endless.add(tag)
                    if tag in CODE:
                        code = _NEXT_TAG.search(page, at)
                        at = code.start() if code else end
            continue
        if inside and tag in BREAKOUT:
            open_.close(FOREIGN)
            inside = False
        if inside:
            if not attributes.endswith("/"):
                open_.push(tag, open_.elements[-1])
            continue
        if tag not in INLINE:
            flush()
            if open_.counts["p"] and tag not in VOID:
                open_.close({"p"})
            if tag in CLOSES:
                open_.close(CLOSES[tag])
        if tag not in VOID and not (attributes.endswith("/") and tag in INLINE):
            around = open_.elements[-1]
            open_.push(tag, around if tag in INLINE else around.child(_tokens(tag, attributes)))
    flush()
    return found
