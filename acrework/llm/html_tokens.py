"""Token streams of web pages: a tolerant scan of raw HTML into nested elements and blocks of text.

Everything is one pass whose cost grows with the page: unclosed quotes, comments and raw elements are looked for once.
Inline elements stand for nothing but their text; every other element begins and ends a block.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: An opening tag ends open elements of these names, down to (without) the nearest of those.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Deeper elements only bound blocks; pages of sense do not nest like this.
DEPTH = 120
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


class Node:
    """An element (key, kids), a group of siblings (its key in brackets) or a text (key ``#``, blocks or slot)."""

    __slots__ = ("key", "kids", "occ", "blocks", "slot", "shape")

    def __init__(self, key: str, kids: list["Node"] | None = None, occ: int = 0):
        self.key, self.kids, self.occ = key, kids if kids is not None else [], occ
        self.blocks: list[int] = []
        self.slot: int | None = None
        self.reshape()

    def reshape(self) -> None:
        """What the node is like, whatever the number of its repetitions."""
        self.shape = (self.key, *(kid.shape for kid in self.kids))


def element_key(name: str, attributes: str) -> str:
    """The name with the words of its class, id, role and item property; digits do not count."""
    if "=" not in attributes:
        return name
    words = sorted({_DIGITS.sub("0", w.lower()) for m in _ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").split()})
    return ".".join([name, *words])


class Page:
    """Top-level nodes of a page, its blocks of text, and how many of each block's characters are links."""

    def __init__(self, html: str):
        self.html, self.blocks, self.linked = html, [], []
        self.root = Node("")
        self._names, self._nodes = [""], [self.root]
        self._parts: list[str] = []
        self._link, self._link_chars = False, 0
        self._nothing_after: dict[str, int] = {}
        self._scan()
        self._end_block()

    def _find(self, what: str, at: int) -> int:
        """The next place, or -1; a string that is not found is not looked for again."""
        if what in self._nothing_after:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self._nothing_after[what] = at
        return found

    def _scan(self) -> None:
        html, at = self.html, 0
        while True:
            mark = self._find("<", at)
            if mark < 0:
                self._text(html[at:])
                return
            if mark > at:
                self._text(html[at:mark])
            at = self._markup(mark)

    def _markup(self, mark: int) -> int:
        html = self.html
        if html.startswith("<!--", mark):
            end = self._find("-->", mark + 4)
            return len(html) if end < 0 else end + 3
        ending = html.startswith("/", mark + 1)
        name = _NAME.match(html, mark + 1 + ending)
        if name is None:
            if html[mark + 1 : mark + 2] in ("!", "?", "/"):
                end = self._find(">", mark)
                return len(html) if end < 0 else end + 1
            self._text("<")
            return mark + 1
        end = self._tag_end(name.end())
        tag = name[0].lower()
        if ending:
            self._close(tag)
        else:
            attributes = html[name.end() : end]
            self._open(tag, attributes)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, end + 1)
                inner = html[end + 1 : stop.start() if stop else len(html)]
                if tag == "textarea" or tag == "title":
                    self._text(inner)
                if stop is None:
                    return len(html)
                return stop.start()
        return end + 1

    def _tag_end(self, at: int) -> int:
        """Where the tag's ``>`` stands, quotes minded; the end of the page if there is none."""
        while True:
            end = self._find(">", at)
            if end < 0:
                return len(self.html)
            quotes = [q for q in (self.html.find('"', at, end), self.html.find("'", at, end)) if q >= 0]
            if not quotes:
                return end
            first = min(quotes)
            closing = self._find(self.html[first], first + 1)
            if closing < 0:
                return end
            at = closing + 1

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._link:
            self._link_chars += len(text)

    def _end_block(self) -> None:
        if self._parts:
            block = " ".join("".join(self._parts).split())
            if block:
                top = self._nodes[-1]
                if top.kids and top.kids[-1].key == "#":
                    leaf = top.kids[-1]
                else:
                    leaf = Node("#")
                    top.kids.append(leaf)
                leaf.blocks.append(len(self.blocks))
                self.blocks.append(block)
                self.linked.append(min(self._link_chars, len(block)))
            self._parts = []
        self._link_chars = 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._link = True
            elif tag == "br":
                self._parts.append(" ")
            return
        self._end_block()
        self._link = False
        if tag in VOID:
            return
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            k = len(self._names) - 1
            last = None
            while k > 0 and self._names[k] not in within:
                if self._names[k] in ended:
                    last = k
                k -= 1
            if last is not None:
                self._pop(last)
        if self._names[-1] == "p":
            self._pop(len(self._names) - 1)
        if len(self._names) <= DEPTH:
            node = Node(element_key(tag, attributes))
            self._nodes[-1].kids.append(node)
            self._nodes.append(node)
            self._names.append(tag)

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._link = False
            return
        self._end_block()
        for k in range(len(self._names) - 1, 0, -1):
            if self._names[k] == tag:
                self._pop(k)
                return

    def _pop(self, k: int) -> None:
        del self._names[k:], self._nodes[k:]
