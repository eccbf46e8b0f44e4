"""Leaf blocks of HTML: maximal texts between block-level tags, with the tags that they lie in.

Tags are read in one pass over the page. Inline tags do not end a block; a line break counts as white
space. Comments, declarations, scripts, styles and templates have no text. Open elements are closed by
their end tags, or by those start tags that imply it; end tags without a start are passed over. Formulas are text of their paragraph.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from papyra.functions.markup import Reader

ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
NAME = re.compile(r"[a-z]+")

# HTML element names by how they are read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input svg math annotation merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea iframe object svg select".split())
CLOSED_BY = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer form main blockquote pre figure hr address fieldset".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}



class Element:
    """An open element; paths are chains of elements, shared by the blocks below them."""

    __slots__ = ("parent", "tag", "names", "depth", "tags")

    def __init__(self, parent: Element | None, tag: str, names: tuple[str, ...]) -> None:
        self.parent, self.tag, self.names = parent, tag, names
        self.depth = parent.depth + 1 if parent else 1
        above = parent.tags if parent else ()
        self.tags = above if tag in ("html", "body") else (*above[-1:], tag)  # the last two besides the roots


@dataclass(slots=True)
class Block:
    text: str
    element: Element | None  # the innermost
    links: int  # characters inside links

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """(tag, names in class, id and role) from the root."""
        out, at = [], self.element
        while at:
            out.append((at.tag, at.names))
            at = at.parent
        return tuple(reversed(out))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    reader, here = Reader(page), None
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = depth = at = 0

    def end() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, here, links))
            parts.clear()
        links = 0

    while True:
        found = reader.tag(at)
        text = page[at : found[0] if found else len(page)]
        if text:
            parts.append(text)
            if depth:
                links += len(text)
        if not found:
            break
        _, at, tag, attributes = found
        if not tag:
            continue
        closing = tag[0] == "/"
        tag = tag.lstrip("/")
        if tag in RAW and not closing:
            if tag not in INLINE:
                end()
            at = reader.after(tag, at)
            continue
        if tag in INLINE:
            if tag == "a":
                depth = max(0, depth + (-1 if closing else 1))
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        end()
        if closing:
            if open_.get(tag):
                depth, left = 0, None
                while left != tag:
                    left, here = here.tag, here.parent
                    open_[left] -= 1
            continue
        while here and tag in CLOSED_BY.get(here.tag, ()):
            open_[here.tag] -= 1
            here = here.parent
        if tag not in VOID:
            names = tuple(n for a in ATTRIBUTE.findall(attributes) for n in (NAME.findall((a[1] or a[2] or a[3]).lower()) if a[0].lower() not in ("hidden",) else ("hidden",))) if attributes else ()
            here = Element(here, tag, names)
            open_[tag] = open_.get(tag, 0) + 1
    end()
    return out
