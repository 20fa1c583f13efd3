"""A small HTML tree: block elements with their own text, in page order.

Any string gives a tree, in time linear in its length. A quoted attribute value may hold ``>``; a quote that is never
closed is an ordinary character. A tag that the page breaks off is markup and shows no text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:\-]*+)")
#: What matters inside a tag: its end, or an attribute value that begins with a quote.
_INSIDE = re.compile(r">|=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"(?<![\w:\-])([a-zA-Z][\w:\-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
#: Numeric character references of more digits than any code point has (leading zeros aside): they stand for U+FFFD.
_NUMBER = re.compile(r"&#(?:0*+([0-9]*+)|[xX]0*+([0-9a-fA-F]*+));?")
_SPACE = re.compile(r"\s+")
#: Elements without end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, and elements whose inside is not shown as text of the page.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("script style head title template noscript svg math iframe object select option textarea button canvas audio video datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements that may stand in a head; any other opening tag, and text, ends a head without an end tag.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: What an opening tag closes, and the elements beyond which it closes nothing.
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_FENCE = frozenset("ul ol dl table div article section body html main aside nav td th form".split())


@dataclass
class Node:
    """A block element. texts: (position on the page, text, characters of it inside links)."""

    tag: str
    parent: int
    names: str = ""
    label: str | None = None
    hidden: bool = False
    texts: list[tuple[int, str, int]] = field(default_factory=list)


class _Scanner:
    """Finds where tags end. What has been searched for in vain is not searched for again, so a page is read once."""

    def __init__(self, page: str):
        self.page, self.plain = page, False
        self.missing: set[str] = set()  # quotes that the rest of the page lacks

    def tag_end(self, at: int) -> int:
        """Just behind the tag whose name ends at ``at``; -1 if the page ends first."""
        page, start = self.page, at
        while not self.plain and (m := _INSIDE.search(page, at)):
            at, quote = m.end(), m[1]
            if quote is None:
                return at
            if quote not in self.missing:
                end = page.find(quote, at)
                if end < 0:
                    self.missing.add(quote)
                else:
                    at = end + 1
        self.plain = True  # every > left stands in quotes: from here on quotes count for nothing
        return page.find(">", start) + 1 or -1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element whose inside begins at ``at``; the end of the page if there is none."""
        page = self.page
        while (at := page.find("</", at)) >= 0:
            at += 2
            if page[at : at + len(tag)].lower() == tag:
                return page.find(">", at) + 1 or len(page)
        return len(page)


def _decoded(text: str) -> str:
    """Character references decoded; those of no code point are U+FFFD, however many digits they have."""
    if "&" not in text:
        return text

    def short(m: re.Match) -> str:
        digits = m[1] if m[1] is not None else m[2]
        return m[0] if len(m[0]) < 12 else "\ufffd" if len(digits) > 8 else m[0][: 2 if m[1] is not None else 3] + (digits or "0") + ";"

    return html.unescape(_NUMBER.sub(short, text))


def parse(page: str) -> list[Node]:
    """Block elements, parents before children; the first is the page itself. Character references are decoded."""
    nodes = [Node("#page", -1)]
    stack: list[tuple[str, int]] = []  # open elements and the node of each
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    blocks: list[int] = []  # where block elements and hidden ones are
    scanner = _Scanner(page)
    pieces: list[str] = []
    linked = position = 0
    links = 0

    def here() -> int:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        nonlocal pieces, linked, position
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                nodes[here()].texts.append((position, text, min(linked, len(text))))
                position += 1
            pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not nodes[here()].hidden:
            text = _decoded(text)
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def open_tag(tag: str, node: int) -> None:
        nonlocal links
        places[tag].append(len(stack))
        if tag in BLOCKS or tag in HIDDEN:
            blocks.append(len(stack))
        stack.append((tag, node))
        links += tag == "a"

    def close(n: int) -> None:
        nonlocal links
        while len(stack) > n:
            tag, _ = stack[-1]
            if tag in BLOCKS or tag in HIDDEN:
                flush()
                blocks.pop()
            links -= tag == "a"
            places[tag].pop()
            stack.pop()

    def close_tag(tag: str, fence: frozenset = frozenset()) -> None:
        """Closes the innermost such element, unless an element of the fence stands further in."""
        if places[tag] and not any(places[f][-1] > places[tag][-1] for f in fence if places.get(f)):
            close(places[tag][-1])

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = _NAME.match(page, lt)
        if m is None and page[lt + 1 : lt + 2] not in ("!", "?"):
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        if m is None:
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 2)
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        at = scanner.tag_end(m.end())
        if at < 0:
            break
        inside = page[m.end() : at - 1]
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in HIDDEN:
                close_tag(tag)
            elif places[tag] and not (blocks and blocks[-1] > places[tag][-1]):
                close(places[tag][-1])
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag == "br":
            if not nodes[here()].hidden:
                pieces.append(" ")
            continue
        if tag in BLOCKS:
            close_tag("p", _FENCE)
            for other in _ITEMS.get(tag, ()):
                close_tag(other, _FENCE - {tag, other})
        if tag in BLOCKS or tag in HIDDEN:
            flush()
            found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(inside)} if inside else {}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop") if k in found)
            up = here()
            nodes.append(Node(tag, up, names, found.get("data-label"), nodes[up].hidden or tag in HIDDEN))
            own = len(nodes) - 1
        else:
            own = here()
        if tag in VOID or (inside.endswith("/") and tag not in BLOCKS):
            continue
        if tag in RAW:
            at = scanner.raw_end(tag, at)
            continue
        open_tag(tag, own)
    flush()
    return nodes
