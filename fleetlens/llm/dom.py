"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements whose content is never text of the page, up to their end tag.
SKIPPED = frozenset("script style title textarea noscript template iframe select svg canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header html label legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: A start tag ends the open elements named, up to the nearest of the bounds.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "body": (("head",), ()),
}
_TAG = re.compile(r"""<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class Node:
    """An open element: its tag, and what it and those around it are called."""

    tag: str
    parent: Node | None
    names: frozenset[str]


@dataclass
class Block:
    """Text of one block, white space as single spaces; how much of it is links; where it stands."""

    text: str
    linked: int
    node: Node | None


@dataclass
class _Open:
    stack: list[Node] = field(default_factory=list)
    count: dict[str, int] = field(default_factory=dict)

    def push(self, tag: str, attributes: str) -> None:
        parent = self.stack[-1] if self.stack else None
        around = parent.names if parent else frozenset()
        own = {f"in:{tag}"}
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "style" and _NO_DISPLAY.search(value)):
                own.add("hidden")
            elif name != "style":
                own.update(f"name:{t.lower()}" for t in _TOKEN.findall(value))
        self.stack.append(Node(tag, parent, around if own <= around else around | own))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> None:
        self.count[self.stack.pop().tag] -= 1

    def close(self, tag: str) -> None:
        if self.count.get(tag):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def make_room(self, tag: str) -> None:
        if self.stack and self.stack[-1].tag == "p":
            self.pop()
        ended, bounds = _ENDS.get(tag, ((), ()))
        if any(self.count.get(t) for t in ended):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].tag in bounds:
                    break
                if self.stack[depth].tag in ended:
                    while len(self.stack) > depth:
                        self.pop()
                    break


def blocks(page: str) -> list[Block]:
    """In page order.  Markup needn't be well-formed; what is no tag is text."""
    out: list[Block] = []
    open_, parts, linked, in_link = _Open(), [], 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text and not open_.count.get("head"):
                out.append(Block(text, linked, open_.stack[-1] if open_.stack else None))
            parts.clear()
            linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:  # a comment, doctype or instruction
            close = "-->" if m[0] == "<!--" else ">"
            found = page.find(close, at)
            at = end if found < 0 else found + len(close)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK:
                flush()
                open_.close(tag)
        elif tag in SKIPPED:
            if not m[3].endswith("/"):
                found = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
                at = found.end() if found else end
            parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCK:
            flush()
            in_link = 0 if tag != "li" else in_link
            open_.make_room(tag)
            open_.push(tag, m[3])
    flush()
    return out
