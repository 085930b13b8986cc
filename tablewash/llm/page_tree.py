"""A tolerant HTML reader: block elements and text runs as a tree in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Element names of HTML by their part in the layout.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
#: A start tag ends the open elements named here, up to the nearest of the second group.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tbody": ("tbody thead tfoot tr td th", ("table",)),
    "tfoot": ("tbody thead tfoot tr td th", ("table",)),
    "option": ("option", ("select",)),
    "body": ("head", ("html",)),
}

_PIECE = re.compile(
    r"""<!--(?P<comment>.*?)(?:-->|\Z)
      |<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
      |<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)
      |<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.X,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass(slots=True)
class Node:
    """A block element, or a run of text if `tag` is empty."""

    tag: str
    parent: int
    names: str = ""
    text: str = ""
    linked: int = 0  # characters of the text inside links
    children: int = 0


@dataclass(slots=True)
class _Run:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def read(page: str) -> list[Node]:
    """Nodes in page order, parents before children; node 0 is the root."""
    nodes = [Node("#root", -1)]
    stack = [0]
    open_tags: dict[str, int] = {}
    links = 0
    run = _Run()

    def flush() -> None:
        nonlocal run
        if run.parts:
            text = " ".join(html.unescape("".join(run.parts)).split())
            if text:
                nodes.append(Node("", stack[-1], text=text, linked=min(run.linked, len(text))))
                nodes[stack[-1]].children += 1
            run = _Run()

    def close(upto: int) -> None:
        while len(stack) > upto:
            open_tags[nodes[stack.pop()].tag] -= 1

    def add_text(text: str) -> None:
        if text:
            run.parts.append(text)
            if links:
                run.linked += len(text)

    at, size = 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            add_text(page[at:])
            break
        add_text(page[at:less])
        hit = _PIECE.match(page, less)
        if not hit:
            add_text("<")
            at = less + 1
            continue
        at = hit.end()
        name = hit["name"] or hit["name2"]
        if not name:
            continue
        tag, ending = name.lower(), bool(hit["end"] or hit["end2"])
        if tag == "a":
            links = 0 if ending else 1
        if tag == "br" or tag == "img":
            add_text(" ")
        if not ending and tag in RAW:
            low = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            inside = page[at : low.start() if low else size]
            if low:
                close_at = page.find(">", low.start())
                at = size if close_at < 0 else close_at + 1
            else:
                at = size
            if tag in ("title", "textarea"):
                flush()
                nodes.append(Node(tag, stack[-1]))
                nodes[stack[-1]].children += 1
                stack.append(len(nodes) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
                run.parts.append(inside)
                flush()
                close(len(stack) - 1)
            continue
        if tag not in BLOCKS:
            continue
        flush()
        links = 0
        if ending:
            if open_tags.get(tag):
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if open_tags.get("p") and tag not in ("button", "label", "option", "select"):
            depth = len(stack) - 1
            while depth and nodes[stack[depth]].tag not in ("p", "td", "th", "button", "caption"):
                depth -= 1
            if nodes[stack[depth]].tag == "p":
                close(depth)
        if tag in CLOSES:
            ended, within = CLOSES[tag]
            if any(open_tags.get(t) for t in ended.split()):
                depth, lowest = len(stack) - 1, 0
                while depth and nodes[stack[depth]].tag not in within:
                    if nodes[stack[depth]].tag in ended.split():
                        lowest = depth
                    depth -= 1
                if lowest:
                    close(lowest)
        if tag in VOID:
            continue
        rest = hit["rest"] or hit["rest2"] or ""
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
        nodes.append(Node(tag, stack[-1], names))
        nodes[stack[-1]].children += 1
        stack.append(len(nodes) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return nodes
