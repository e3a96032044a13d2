"""HTML pages as sequences of leaf blocks: text, tag path and simple measures."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template iframe svg textarea".split())
#: An opening tag closes an open element of the first kinds, up to the nearest of the second.
ENDED = [
    (("li",), ("li",), ("ul", "ol", "menu")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("tr",), ("tr",), ("table",)),
    (("td", "th"), ("td", "th"), ("tr", "table")),
    (("option",), ("option",), ("select",)),
    ((), ("p",), ("td", "th", "li", "div", "article", "section")),  # any other block
]
RULE_OF = {tag: n for n, (opening, _, _) in enumerate(ENDED) for tag in opening}
NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARKS = re.compile(r"[<>\"']")
NAME_PART = re.compile(r"[a-z]+")
SPLIT_NAME = re.compile(r"([a-z])([A-Z])")
#: Distinct tags and name parts of a path that a block is told by, the innermost first.
MOST_TOKENS = 128


class Path:
    """Open elements around a block; ``tokens`` are the distinct tags and name parts, innermost first.

    ``ended`` holds, for each rule of ENDED, the element that its opening tags close.
    """

    __slots__ = ("children", "ended", "parent", "tag", "tokens")

    def __init__(self, parent: Path | None, tag: str, own: tuple[str, ...]):
        self.parent, self.tag, self.children = parent, tag, {}
        outer = parent.tokens if parent else ()
        self.tokens = tuple(dict.fromkeys(own + outer))[:MOST_TOKENS]
        before = parent.ended if parent else (None,) * len(ENDED)
        self.ended = tuple(self if tag in closed else None if tag in until else old for (_, closed, until), old in zip(ENDED, before, strict=True))

    def child(self, tag: str, names: tuple[str, ...]) -> Path:
        key = (tag, names)
        found = self.children.get(key)
        if found is None:
            found = self.children[key] = Path(self, tag, (tag, *names))
        return found


class Block:
    __slots__ = ("link", "path", "text")

    def __init__(self, text: str, path: Path, link: int):
        self.text, self.path, self.link = text, path, link


def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of the class, id and role values, as ``.word``."""
    if not attributes or "=" not in attributes:
        return ()
    out: list[str] = []
    for values in NAMED.findall(attributes):
        value = SPLIT_NAME.sub(r"\1 \2", values[0] or values[1] or values[2])
        out += ("." + w for w in NAME_PART.findall(value.lower()))
    return tuple(dict.fromkeys(out))


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags, comments and hidden elements of a page, in order.

    The name is empty where only the place matters.  A tag ends at the first ``>``
    outside quotes; one that meets the next ``<`` or the end of the page before is
    text.  Every step goes on behind what it has read, so the time is linear.
    """
    lower = page.lower()
    if len(lower) != len(page):  # some capitals are longer in lower case
        lower = page.translate({c: c + 32 for c in range(65, 91)})
    size, at = len(page), 0
    closed: dict[str, int] = {}  # place from which on a sign was not found any more

    def find(sign: str, start: int) -> int:
        if start >= closed.get(sign, size):
            return -1
        found = lower.find(sign, start)
        if found < 0:
            closed[sign] = start
        return found

    while (start := find("<", at)) >= 0:
        at = start + 1
        following = page[at : at + 1]
        if page.startswith("!--", at):
            end = find("-->", at + 3)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if following in ("!", "?") or (following == "/" and not page[at + 1 : at + 2].isalpha()):
            end = find(">", at)
            if end >= 0:
                at = end + 1
                yield start, at, "", False, ""
            continue
        closing = following == "/"
        name = NAME.match(page, at + closing)
        if not name:
            continue
        end = name.end()
        while end < size and (sign := page[end]) not in "<>":
            step = MARKS.search(page, end)
            end = step.start() if step else size
            if end < size and (sign := page[end]) in "\"'":
                after = find(sign, end + 1)
                if after < 0:  # an open quote is no quote
                    end += 1
                else:
                    end = after + 1
        at = end
        if end >= size or page[end] == "<":
            continue
        at = end + 1
        tag, attributes = name[0].lower(), page[name.end() : end]
        if tag in HIDDEN and not closing:
            while (end := find("</" + tag, at)) >= 0 and (lower[end + 2 + len(tag) : end + 3 + len(tag)] or ">") not in " \t\n\r\f/>":
                at = end + 1
            end = find(">", end) if end >= 0 else -1
            at = size if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        yield start, at, tag, closing, attributes


def blocks_of(page: str, root: Path | None = None) -> list[Block]:
    """Leaf blocks of a page in order; white space inside a block is one space."""
    top = path = root or Path(None, "", ())
    blocks: list[Block] = []
    pieces: list[str] = []
    links, link = 0, 0
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal pieces, links
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(text, path, min(links, len(text))))
            pieces, links = [], 0

    def leave(step: Path) -> None:
        """Close all elements up to ``step``."""
        nonlocal path
        while path is not step:
            opened[path.tag] -= 1
            path = path.parent
        opened[path.tag] -= 1
        path = path.parent

    at = 0
    for start, end, tag, closing, attributes in tags_of(page):
        if start > at:
            piece = page[at:start]
            pieces.append(piece)
            if link:
                links += len(piece)
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                link = 0
            if tag in BLOCK:
                flush()
            if opened[tag] > 0:
                step = path
                while step.tag != tag:
                    step = step.parent
                leave(step)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            step = path.ended[RULE_OF.get(tag, len(ENDED) - 1)]
            if step is not None and tag not in ("html", "head", "body"):
                leave(step)
        if tag == "a":
            link = 1
        if tag not in VOID and not attributes.endswith("/"):
            path = path.child(tag, names_of(attributes))
            opened[tag] += 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return blocks


def bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size
