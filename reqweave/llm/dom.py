"""Pages as trees of block elements with the text that stands in each.

A page is cut into tags and text once. Elements that only mark up running text (links, emphasis) are no nodes: their
text belongs to the block around them, links are counted. Open elements are closed as browsers do: a new paragraph
ends the open one, list items and cells end each other, an end tag without its start is left out, what is open at
the end of the page ends there. Scripts, styles, titles and controls of forms carry no text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of the HTML standard by their kind.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SILENT = frozenset("head template svg math object audio video canvas select option optgroup datalist button map".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: A start tag ends the open elements named here, up to the nearest container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
CONTAINERS = frozenset("ul ol menu dl table select body div section article aside main nav header footer form blockquote".split())

TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*+)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|aria-label|itemprop|itemtype|data-kind)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.IGNORECASE)
#: Attribute of training pages that holds the label of a node; never a feature.
LABEL = "data-kind"


@dataclass
class Page:
    """Nodes in page order; ``ends`` is the number of the first node behind a node's subtree."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    marks: list[str] = field(default_factory=lambda: [""])
    labels: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])
    #: Text pieces in page order: owner, stretch of running text, whether in a link, text.
    pieces: list[tuple[int, int, bool, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page()
    names, nodes = ["html"], [0]  # open elements, and the node each belongs to
    opened: dict[str, int] = {}
    stretch = at = links = silent = 0
    size = len(source)

    def close(down_to: int) -> None:
        nonlocal stretch, links, silent
        while len(names) > down_to:
            name, node = names.pop(), nodes.pop()
            opened[name] -= 1
            if name == "a":
                links -= 1
            elif name in SILENT:
                silent -= 1
            if name not in INLINE:
                stretch += name not in SILENT
                page.ends[node] = len(page.tags)

    def text(start: int, stop: int) -> None:
        if stop > start and not silent:
            piece = source[start:stop]
            page.pieces.append((nodes[-1], stretch, links > 0, html.unescape(piece) if "&" in piece else piece))

    while at < size:
        found = TOKEN.search(source, at)
        if found is None:
            text(at, size)
            break
        text(at, found.start())
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:  # an end tag
            if opened.get(name):
                place = len(names) - 1
                while names[place] != name and (name not in INLINE or names[place] in INLINE):
                    place -= 1
                if names[place] == name:
                    close(place)
            continue
        if name == "br":
            page.pieces.append((nodes[-1], stretch, False, " "))
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
            at = stop.start() if stop else size
            continue
        if opened.get("head") and name not in VOID and name not in SILENT:
            close(names.index("head"))
        if name in ENDS_PARAGRAPH and opened.get("p"):
            place = len(names) - 1
            while names[place] != "p" and (names[place] not in CONTAINERS):
                place -= 1
            if names[place] == "p":
                close(place)
        if name in ENDS and any(opened.get(x) for x in ENDS[name]):
            last = place = len(names)
            while place > 1 and names[place - 1] not in CONTAINERS:
                place -= 1
                if names[place] in ENDS[name]:
                    last = place
            close(last)
        if name in VOID:
            stretch += name == "hr"
            continue
        if name == "html":
            page.labels[0] = next(("".join(values) for key, *values in ATTRIBUTE.findall(found[3]) if key == LABEL), "")
            continue
        if name == "body" and opened.get("body"):
            continue
        opened[name] = opened.get(name, 0) + 1
        node = nodes[-1]
        if name in INLINE:
            if name == "a":
                links += 1
                page.links[node] += 1
        else:
            stretch += name not in SILENT
            marks, label = [], ""
            if "=" in found[3]:
                for key, *values in ATTRIBUTE.findall(found[3]):
                    if key.lower() == LABEL:
                        label = "".join(values)
                    else:
                        marks += filter(None, values)
            page.tags.append(name)
            page.parents.append(node)
            page.depths.append(page.depths[node] + 1)
            page.ends.append(0)
            page.marks.append(" ".join(marks))
            page.labels.append(label)
            page.links.append(0)
            node = len(page.tags) - 1
            silent += name in SILENT
        names.append(name)
        nodes.append(node)
    close(1)
    page.ends[0] = len(page.tags)
    return page


def main_text(page: Page, keeps) -> str:
    """Text of the nodes for which ``keeps[node]``: blocks in page order, joined by line breaks."""
    blocks, now, last = [], [], -1
    for owner, stretch, _, piece in page.pieces:
        if not keeps[owner]:
            continue
        if stretch != last and now:
            blocks.append(" ".join("".join(now).split()))
            now = []
        last = stretch
        now.append(piece)
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)
