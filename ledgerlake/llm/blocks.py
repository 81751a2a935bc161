"""The blocks of a web page: runs of text between tags that break lines, with what stands around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr"
    " object audio video canvas math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mphantom merror mfrac msqrt mroot msub msup msubsup"
    " munder mover munderover mmultiscripts mprescripts none mtable mtr mtd".split()
)
#: Elements that the first of these tags ends when it opens, up to an element of their own.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "body": ("head",),
}
SCOPES = frozenset("ul ol dl table select body html article section div".split())

# A quote opens a value only after an equals sign; anywhere else, and where it isn't closed, it is a character like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>=]|=)*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # what the enclosing elements are called, from the outside in
    linked: int  # characters inside links


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words in its class, id and role."""
    out = [tag]
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        if key.lower() in ("class", "id", "role"):
            out += [f".{n}" for n in NAME.findall(CAMEL.sub("-", "".join(values)).lower())]
    return tuple(out)


def blocks_of(page: str | None) -> list[Block]:
    """All blocks of a page in order. Markup, comments and raw elements are no text. A single line break
    inside a block is white space, two in a row end it. Tags that aren't closed end where the format says;
    of a raw element that isn't closed only the start tag is markup. Formulas and what media elements
    hold stand in the block around them."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links, breaks, at = 0, 0, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(n for _, names in stack for n in names), linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if links:
                    linked += len(text.strip())

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if tag in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else at
            parts.append(" ")
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        flush()
        breaks = 0
        if tag in VOID:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    links = 0
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        ended = ENDED_BY.get(tag, ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ended:
                del stack[k:]
                break
            if stack[k][0] in SCOPES and tag != "body":
                break
        stack.append((tag, names_of(tag, m[3])))
    flush()
    return out
