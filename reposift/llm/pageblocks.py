"""Leaf blocks of web pages: a forgiving reader of HTML and the features of each block."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page; of these, RAW ones end only at their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset("head noscript template svg math object select option datalist audio video canvas".split())
#: Elements that stand within a block; all others begin and end one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
#: A start tag ends these open elements, up to the nearest element of the second set.
ENDS = {
    **{t: (frozenset({"li"}), frozenset("ul ol menu".split())) for t in ("li",)},
    **{t: (frozenset("dt dd".split()), frozenset({"dl"})) for t in ("dt", "dd")},
    **{t: (frozenset("td th".split()), frozenset("tr table".split())) for t in ("td", "th")},
    "tr": (frozenset("tr".split()), frozenset("table".split())),
    **{t: (frozenset("tr thead tbody tfoot caption".split()), frozenset("table".split())) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset({"head"}), frozenset()),
}
#: Block elements end an open paragraph.
_ENDS_P = (frozenset({"p"}), frozenset("table td th button body".split()))
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_MARK = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    """``path``: open elements as (tag, names in class, id and role), outermost first; ``begin``: place in the source."""

    text: str
    linked: int
    begin: int
    path: tuple[tuple[str, tuple[str, ...]], ...]


def _names(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role of an element, lower-cased."""
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for _, a, b, c in _MARK.findall(attributes))
    return tuple(dict.fromkeys(w.lower() for w in _NAMES.findall(unescape(found))))


def leaf_blocks(html: str | None) -> list[Block]:
    """Runs of text between block elements, in page order, each with white space turned into single blanks.

    Character references are decoded; comments, scripts, styles, the head and
    other content that isn't shown is left out.  ``<br>`` is white space.  End
    tags without a start, unclosed elements and a page cut anywhere are taken
    as they come.  Empty blocks are dropped.
    """
    html = html or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    blocks: list[Block] = []
    parts: list[str] = []
    linked, begin, hidden, links = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, linked, begin, tuple(stack)))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            tag = stack.pop()[0]
            hidden -= tag in HIDDEN
            links -= tag == "a"

    def say(text: str, place: int) -> None:
        nonlocal begin, linked
        if not hidden and text:
            if not parts or not any(map(str.strip, parts)):
                begin = place
            text = unescape(text)
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))

    at, size = 0, len(html)
    while at < size:
        met = _TAG.search(html, at)
        if met is None:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that never ends
            say(rest[: cut.start()] if cut else rest, at)
            break
        say(html[at : met.start()], at)
        at = met.end()
        tag = (met[2] or "").lower()
        if not tag:
            if met[0].startswith("<![CDATA["):
                say(met[0][9:].removesuffix("]]>"), met.start())
            continue
        block = tag not in INLINE and tag not in HIDDEN
        if met[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if block:
                close()
            if tag == "br":
                say(" ", met.start())
            elif depth is not None:
                if not block and any(t not in INLINE for t, _ in stack[depth:]):
                    continue  # an inline end tag doesn't close the blocks inside
                pop_to(depth)
            continue
        if tag == "br":
            say(" ", met.start())
            continue
        if block:
            close()
            for ended, fence in filter(None, (_ENDS_P, ENDS.get(tag))):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        pop_to(i)
                        break
                    if stack[i][0] in fence:
                        break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = size if end is None else html.find(">", end.start()) + 1 or size
            continue
        if not met[3].endswith("/") or tag not in ("svg", "math"):
            stack.append((tag, _names(met[3])))
            hidden += tag in HIDDEN
            links += tag == "a"
    close()
    return blocks


_END = frozenset(".!?…。！？")
_YEAR = re.compile(r"(?:19|20)\d\d")


def path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    """Features of the elements a block stands in: tags, names, the innermost block and the innermost named element."""
    found = {f"tag={t}" for t, _ in path if t not in ("html", "body")}
    found |= {f"name={n}" for _, names in path for n in names}
    own = next((p for p in reversed(path) if p[0] not in INLINE), ("", ()))
    found.add(f"own={own[0]}")
    found |= {f"own-name={n}" for n in own[1]}
    near = next((names for _, names in reversed(path) if names), None)
    found |= {f"near={n}" for n in near} if near else {"unnamed"}
    return tuple(sorted(found))


def text_features(block: Block, place: int, many: int) -> list[str]:
    """Features of a block's words, links and place; none depends on the language."""
    text = block.text
    words = text.split(" ")
    n, chars = len(words), len(text)
    linked = block.linked / chars
    found = ["bias", f"words={min(n, 1) if n < 2 else min(n.bit_length(), 8)}", f"linked={0 if not linked else 1 if linked < 0.3 else 2 if linked < 0.8 else 3}"]
    if text[-1] in _END:
        found.append("ends-sentence")
    stops = sum(text.count(c) for c in ".,;!?")
    found.append(f"stops={min(3, stops)}" if n < 8 else f"stops-per-word={min(4, int(20 * stops / n))}")
    if text[0].islower():
        found.append("begins-low")
    if n > 1 and sum(w[0].isupper() for w in words) > 0.6 * n:
        found.append("capitals")
    if any(c in text for c in "©®»›•"):
        found.append("marks")
    if n < 12 and any(map(str.isdigit, text)):
        found.append("year" if _YEAR.search(text) else "digits")
    found.append(f"first={place}" if place < 2 else f"last={many - 1 - place}" if many - place < 3 else "inside")
    return found
