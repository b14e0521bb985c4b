"""Main text of web pages: boosted trees judge every DOM node, a decoding over the tree makes the judgements agree.

A node is ``main`` (its text belongs to the article), ``other`` (menus, adverts, comments and the like) or a ``shell``
(it holds both, such as the body). Features are of the node (element, depth, attribute tokens), of its subtree
(text, link and tag density, paragraphs), of its siblings and of its place in the page. The decoding finds the best
labelling in which nothing below ``other`` is kept and nothing below ``main`` is a shell again: bottom up it sums
the best of every subtree for each label, top down it reads the labels off.

Training pages are layouts drawn from a grammar (with and without telling names) and filled with words of a bounded
sample of the given pages, and these pages themselves where an ``article`` or ``main`` element labels them. Nothing
depends on the number of pages otherwise.

Edge cases: a null or empty page, or one without main text, gives an empty text with zero characters. Broken markup is
read as browsers do; a cut-off page ends where it ends. Repeated rows get equal answers, a null id stays null, an empty table
gives an empty table and extra columns are not read. A page of any size is one tree; pages are judged in groups of bounded size.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqweave.llm.boosting import Forest, fit
from reqweave.llm.common import arrow_schema, batch_of
from reqweave.llm.dom import LABEL, Page, main_text, parse

SHELL, MAIN, OTHER = range(3)
KINDS = ["shell", "main", "other"]
#: Given pages that training looks at (smallest hashes), their length at most there, and drawn layouts.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 200, 100_000, 1000
#: Characters of markup whose nodes are judged together.
CHARS_TOGETHER = 4_000_000

# Element groups that are told apart.
GROUPS = [
    {"p"}, {"div"}, {"section"}, {"article"}, {"main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend"}, {"ul", "ol", "menu", "dl"},
    {"li", "dd", "dt"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"table", "tbody", "thead", "tfoot"}, {"tr"}, {"td", "th"}, {"blockquote", "pre"},
    {"figure", "figcaption"}, {"dialog", "details", "summary"}, {"body", "html"}, {"center", "address"},
]
GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
GOOD, BAD = {"article", "main"}, {"nav", "footer", "aside", "form", "dialog", "menu"}


@dataclass
class Names:
    """What attribute tokens, and pieces of four letters of unknown ones, say: log odds of main and of other."""

    tokens: dict[str, tuple[float, float]]
    pieces: dict[str, tuple[float, float]]

    def odds(self, marks: str, known: dict[str, tuple[float, float]]) -> tuple[float, float]:
        """Sum over the tokens of an element, remembered by its attributes."""
        found = known.get(marks)
        if found is None:
            values = [self._token(t) for t in set(split_names(marks))]
            found = known[marks] = (sum(v[0] for v in values), sum(v[1] for v in values)) if values else (0.0, 0.0)
            if len(known) > 50_000:
                known.clear()
        return found

    def _token(self, token: str) -> tuple[float, float]:
        if token in self.tokens:
            return self.tokens[token]
        values = [self.pieces[g] for g in pieces_of(token) if g in self.pieces]
        return (float(np.mean([v[0] for v in values])) / 2, float(np.mean([v[1] for v in values])) / 2) if values else (0.0, 0.0)


def split_names(marks: str) -> list[str]:
    """Lower-case words of class names, ids and roles."""
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", marks)] if marks else []


def pieces_of(token: str) -> set[str]:
    edged = f"^{token}$"
    return {edged[k : k + 4] for k in range(max(1, len(edged) - 3))}


def learn_names(pages: list[Page], labels: list[np.ndarray]) -> Names:
    """Smoothed log odds; a token counts once per page and label."""
    counts: list[dict[str, Counter]] = [{}, {}]
    totals = Counter()
    for page, label in zip(pages, labels, strict=True):
        seen = {(t, int(k)) for marks, k in zip(page.marks, label, strict=True) if marks and k >= 0 for t in split_names(marks)}
        totals.update(k for _, k in seen)
        for t, k in seen:
            counts[0].setdefault(t, Counter())[k] += 1
        for g, k in {(g, k) for t, k in seen for g in pieces_of(t)}:
            counts[1].setdefault(g, Counter())[k] += 1

    def table(found: dict[str, Counter], least: int) -> dict[str, tuple[float, float]]:
        odds = lambda c, k: float(np.log((c[k] + 1) / (sum(c.values()) - c[k] + 1)))
        return {t: (odds(c, MAIN), odds(c, OTHER)) for t, c in found.items() if sum(c.values()) >= least}

    return Names(table(counts[0], 3), table(counts[1], 8))


def features(pages: list[Page], names: Names, known: dict) -> np.ndarray:
    """One row per node of all pages, page after page."""
    sizes = np.array([len(p.tags) for p in pages])
    n = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    root = np.repeat(first, sizes)
    flat = lambda name: np.concatenate([np.asarray(getattr(p, name)) for p in pages])
    parent, end, depth = flat("parents") + root, flat("ends") + root, flat("depths")
    parent[first] = first
    links = flat("links")
    tags = [t for p in pages for t in p.tags]
    group = np.array([GROUP.get(t, len(GROUPS)) for t in tags])
    odds = np.array([names.odds(m, known) for p in pages for m in p.marks]).reshape(n, 2)

    pieces = [(a + owner, linked, t) for p, a in zip(pages, first.tolist(), strict=True) for owner, _, linked, t in p.pieces if not t.isspace()]
    owner = np.array([x[0] for x in pieces], np.int64)
    chars = np.array([len(x[2]) for x in pieces], float)
    linked = np.array([x[1] for x in pieces], bool)
    words = np.array([x[2].count(" ") + 1 for x in pieces], float)
    stops = np.array([x[2].count(".") + x[2].count(",") + x[2].count("?") + x[2].count("!") for x in pieces], float)
    sum_by = lambda values: np.bincount(owner, values, n) if len(owner) else np.zeros(n)
    own, own_linked, own_words, own_stops = sum_by(chars), sum_by(chars * linked), sum_by(words), sum_by(stops)

    def below(values: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree."""
        up = np.concatenate([[0.0], np.cumsum(values)])
        return up[end] - up[np.arange(n)]

    text, text_linked, text_words, text_stops = below(own), below(own_linked), below(own_words), below(own_stops)
    nodes, all_links = (end - np.arange(n)).astype(float), below(links.astype(float))
    good, bad = np.isin(tags, list(GOOD)).astype(float), np.isin(tags, list(BAD)).astype(float)
    before = np.concatenate([[0.0], np.cumsum(own)])[:n]
    whole = text[root]
    page_before = before - before[root]
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)

    # what lies above: levels from the root down
    above_good, above_bad, above_main, above_other = good.copy(), bad.copy(), odds[:, 0].copy(), odds[:, 1].copy()
    order = np.argsort(depth, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(depth))])
    for a, b in zip(edges[1:-1], edges[2:], strict=True):
        level = order[a:b]
        over = parent[level]
        above_good[level] += above_good[over]
        above_bad[level] += above_bad[over]
        above_main[level] = np.maximum(above_main[level], above_main[over])
        above_other[level] = np.maximum(above_other[level], above_other[over])

    # siblings stand next to each other when nodes are ordered by parent
    not_root = np.arange(n) != root
    kids = np.nonzero(not_root)[0]
    line = kids[np.argsort(parent[kids], kind="stable")]
    same = np.zeros(len(line) + 1, bool)
    same[1:-1] = parent[line[1:]] == parent[line[:-1]]
    count = np.bincount(parent[kids], minlength=n).astype(float)
    starts = np.nonzero(~same[:-1])[0]
    place = np.zeros(n)
    place[line] = np.arange(len(line)) - np.repeat(starts, np.diff(np.append(starts, len(line))))
    link_share = share(text_linked, text)
    log_text = np.log1p(text)
    previous, following = np.full((n, 2), -1.0), np.full((n, 2), -1.0)
    for out, here, there in ((previous, line[1:], line[:-1]), (following, line[:-1], line[1:])):
        next_to = same[1:-1] if len(line) else np.zeros(0, bool)
        out[here[next_to], 0], out[here[next_to], 1] = log_text[there[next_to]], link_share[there[next_to]]
    siblings = count[parent] * not_root
    kind = parent * (len(GROUPS) + 1) + group
    alike = np.bincount(kind, not_root.astype(float), n * (len(GROUPS) + 1))[kind]
    kid_text = np.bincount(parent[kids], text[kids], n) if len(kids) else np.zeros(n)
    paragraphs = below((group == 0) & (own > 0))
    columns = [
        depth, log_text, np.log1p(own), np.log1p(text_words), link_share, np.log1p(all_links), np.log((1 + nodes) / (1 + text / 100)), np.log1p(nodes),
        share(text_stops, text), share(text, text_words), count, place, share(place, siblings), siblings, share(alike, siblings), share(page_before, whole), share(page_before + text, whole),
        share(text, whole), share(text, text[parent]), np.log1p(paragraphs), np.log1p(share(text, below((own > 0).astype(float)))), share(own, text), share(kid_text, siblings),
        above_good, above_bad, above_main, above_other, odds[:, 0], odds[:, 1], odds[parent, 0] * not_root, odds[parent, 1] * not_root,
        below(good) - good, below(bad) - bad, share(below(own * (above_bad > 0)), text), share(below(own * (above_good > 0)), text),
        below(odds[:, 0] > 1), below(odds[:, 1] > 1), previous[:, 0], previous[:, 1], following[:, 0], following[:, 1],
        below((group == GROUP["h1"]).astype(float)), group[parent] * 1.0, log_text - np.log1p(text[parent]), below(own * (link_share > 0.5)) / np.maximum(text, 1),
        *[(group == k).astype(float) for k in range(len(GROUPS))],
    ]
    return np.stack(columns, axis=1)


def decode(pages: list[Page], chance: np.ndarray) -> np.ndarray:
    """Best labelling of all trees in which ``other`` has only ``other`` below it and ``main`` no ``shell``."""
    sizes = np.array([len(p.tags) for p in pages])
    first = np.cumsum(sizes) - sizes
    root = np.repeat(first, sizes)
    parent = np.concatenate([np.asarray(p.parents) for p in pages]) + root
    depth = np.concatenate([np.asarray(p.depths) for p in pages])
    order = np.argsort(depth, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(depth))])
    levels = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    total = chance.copy()
    for level in reversed(levels[1:]):
        here = total[level]
        np.add.at(total[:, SHELL], parent[level], here.max(axis=1))
        np.add.at(total[:, MAIN], parent[level], here[:, MAIN:].max(axis=1))
        np.add.at(total[:, OTHER], parent[level], here[:, OTHER])
    label = np.zeros(len(total), np.int64)
    label[first] = total[first].argmax(axis=1)
    for level in levels[1:]:
        over = label[parent[level]]
        here = total[level].copy()
        here[over >= MAIN, SHELL] = -np.inf
        here[over == OTHER, MAIN] = -np.inf
        label[level] = here.argmax(axis=1)
    return label


@dataclass
class Model:
    names: Names
    forest: Forest

    def texts(self, sources: list[str]) -> list[str]:
        """Main text of each page."""
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        known: dict = {}
        chance = self.forest.scores(features(pages, self.names, known))
        empty = np.concatenate([silent_nodes(p) for p in pages])
        chance[empty] = 0.0
        label = decode(pages, chance)
        out, start = [], 0
        for page in pages:
            out.append(main_text(page, (label[start : start + len(page.tags)] == MAIN).tolist()))
            start += len(page.tags)
        return out


def silent_nodes(page: Page) -> np.ndarray:
    """Nodes without text in their subtree; they have no say in the decoding."""
    own = np.zeros(len(page.tags) + 1)
    for owner, _, _, piece in page.pieces:
        own[owner + 1] += not piece.isspace()
    up = np.cumsum(own)
    return up[np.asarray(page.ends)] - up[:-1] == 0


# ---- training pages ----

# Names that pages give to their parts.
MAIN_NAMES = "content main-content article article-body post post-content entry entry-content story story-body text body-text page-content blog-post news-article detail prose article__content mainText td-post-content".split()
WRAP_NAMES = "wrap wrapper container page root app layout inner outer row col grid site page-wrap columns center col-md-8 content-area site-content".split()
OTHER_NAMES = {
    "menu": "nav menu navbar main-menu navigation topnav mega-menu breadcrumb breadcrumbs navigation pagination pager tabs toc links site-nav".split(),
    "header": "header masthead banner top topbar site-header logo branding page-head hero-bar".split(),
    "footer": "footer bottom copyright site-footer foot legal imprint colophon footer-links contentinfo".split(),
    "side": "sidebar side rail aside widget widgets secondary right-column left-col related recommended more-stories trending popular tags tag-cloud archive complementary".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay disclaimer warning toast message privacy-note age-gate paywall".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion ad-slot adbox banner-ad google-ads teaser-ad commercial offer".split(),
    "form": "form newsletter subscribe signup search search-form login contact-form poll survey feedback comment-form".split(),
    "comments": "comments comment discussion replies responses disqus user-comments comment-list reviews thread reader-comments".split(),
    "share": "share social share-buttons follow sharing social-links toolbar actions print-tools".split(),
}
HEAD_NAMES = "entry-header post-header article-header article-head story-header title-block headline".split()
OTHER_TAGS = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "aside", "dialog", "p"], "ad": ["div", "div", "aside", "section", "ins", "p"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "aside", "ol"], "share": ["div", "ul", "p"]}


class Drawn:
    """Random pages of known labels; words come from ``words``."""

    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words

    def say(self, low: int, high: int, marks: bool = True) -> str:
        rng = self.rng
        out = [rng.choice(self.words) for _ in range(rng.randint(low, high))]
        if marks:
            k = 0
            while (k := k + rng.randint(4, 16)) < len(out):
                out[k - 1] += rng.choice([".", ".", ",", "?", " &amp;", "!"])
            out[-1] += rng.choice([".", ".", ".", "", "!"])
        return " ".join(out)

    def element(self, tag: str, kind: str, inside: str, names: list[str] | None = None) -> str:
        rng, extra = self.rng, f' {LABEL}="{kind}"'
        if names:
            name = rng.choice(names)
            if rng.random() < 0.3:
                name = rng.choice(["js-", "c-", "site-", "l-", "m-"]) + name
            if rng.random() < 0.2:
                name += " " + rng.choice(["clearfix", "hidden", "x1a", "mt-4", "is-open", "box"])
            extra += f' {rng.choice(["id", "class", "class", "class", "role"] if rng.random() < 0.5 else ["class"])}="{name}"'
        elif rng.random() < 0.1:
            extra += f' class="{rng.choice(["a", "x7f", "b-2", "css-1q", "left", "sc"])}"'
        return f"<{tag}{extra}>{inside}</{tag}>"

    def link_list(self, kind: str, low: int, high: int) -> str:
        rng = self.rng
        links = [f'<a href="/{k}">{self.say(1, 4, False)}</a>' for k in range(rng.randint(low, high))]
        if rng.random() < 0.7:
            return self.element(rng.choice(["ul", "ul", "ol"]), kind, "".join(self.element("li", kind, x) for x in links))
        return rng.choice([" | ", " ", " &middot; "]).join(links)

    def other(self, part: str) -> str:
        rng, inside = self.rng, ""
        if part == "menu":
            inside = self.link_list("other", 2, 14)
        elif part == "header":
            inside = self.say(1, 5, False) + (self.link_list("other", 2, 8) if rng.random() < 0.5 else "")
            if rng.random() < 0.4:
                inside = self.element(rng.choice(["h1", "h2", "div", "p"]), "other", inside)
        elif part == "footer":
            inside = rng.choice(["&copy; ", "Copyright ", ""]) + self.say(2, 25) + (self.link_list("other", 2, 8) if rng.random() < 0.4 else "")
            if rng.random() < 0.4:
                inside = self.element("p", "other", inside)
        elif part == "side":
            for _ in range(rng.randint(1, 3)):
                if rng.random() < 0.6:
                    inside += self.element(rng.choice(["h3", "h4", "h2"]), "other", self.say(1, 4, False))
                inside += rng.choice([self.link_list("other", 2, 9), self.element("p", "other", self.say(5, 40)), self.element("div", "other", self.say(3, 30))])
        elif part in ("notice", "ad"):
            inside = self.say(3, 45) + (f' <a href="#">{self.say(1, 3, False)}</a>' if rng.random() < 0.4 else "")
            if rng.random() < 0.4:
                inside = self.element("p", "other", inside)
        elif part == "form":
            inside = self.element("label" if rng.random() < 0.5 else "p", "other", self.say(2, 15)) + "<input type=text><button>go</button>"
        elif part == "comments":
            if rng.random() < 0.6:
                inside = self.element("h3", "other", self.say(1, 3, False))
            for _ in range(rng.randint(1, 7)):
                one = (f"<b>{self.say(1, 2, False)}</b> " if rng.random() < 0.5 else "") + rng.choice([self.element("p", "other", self.say(3, 70)), self.say(3, 70)])
                inside += self.element(rng.choice(["div", "li", "div", "article"]), "other", one, rng.choice([None, ["comment", "reply", "comment-body", "review"]]))
        else:
            inside = " ".join(f'<a href="#">{self.say(1, 1, False)}</a>' for _ in range(rng.randint(2, 5)))
        tag = rng.choice(OTHER_TAGS[part])
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        return self.element("div" if tag == "ins" else tag, "other", inside, None if plain else OTHER_NAMES[part])

    def block(self) -> str:
        """A block of an article."""
        rng, draw = self.rng, self.rng.random()
        if draw < 0.72:
            inside = self.say(1, 120)
            if rng.random() < 0.2:
                inside = f"<b>{inside}<br>" if rng.random() < 0.5 else f'{inside} <a href="/x">{self.say(1, 4, False)}</a> {self.say(1, 30)}'
            return self.element(rng.choice(["p"] * 7 + ["div"]), "main", inside)
        if draw < 0.8:
            return self.element(rng.choice(["h2", "h3"]), "main", self.say(1, 10, False))
        if draw < 0.87:
            return self.element(rng.choice(["ul", "ol"]), "main", "".join(self.element("li", "main", self.say(2, 30)) for _ in range(rng.randint(1, 7))))
        if draw < 0.92:
            return self.element("blockquote", "main", self.element("p", "main", self.say(3, 50)))
        if draw < 0.96:
            cells = "".join(self.element("tr", "main", "".join(self.element("td", "main", self.say(1, 5, False)) for _ in range(3))) for _ in range(rng.randint(1, 5)))
            return self.element("table", "main", cells)
        return self.element("figure", "main", "<img>" + self.element("figcaption", "main", self.say(2, 15)))

    def blocks(self) -> list[str]:
        """The blocks of an article; running text without an element stands alone."""
        rng = self.rng
        if rng.random() < 0.07:
            return ["<br>".join(self.say(5, 90) for _ in range(rng.randint(1, 4)))]
        blocks = [self.block() for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14]))]
        if rng.random() < 0.75:
            title = self.element(rng.choice(["h1", "h1", "h1", "h2"]), "main", self.say(1, 12, False), rng.choice([None, None, HEAD_NAMES]))
            if rng.random() < 0.3:
                by = self.element(rng.choice(["p", "div"]), "main", self.say(1, 6, False)) if rng.random() < 0.4 else ""
                title = self.element(rng.choice(["header", "div"]), "main", title + by, HEAD_NAMES if rng.random() < 0.7 else None)
            blocks.insert(0, title)
        return blocks

    def article(self) -> str:
        rng, blocks, kind = self.rng, self.blocks(), "main"
        if rng.random() < 0.4:  # something that does not belong there
            for _ in range(rng.choice([1, 1, 2])):
                blocks.insert(rng.randint(0, len(blocks)), self.other(rng.choice(["ad", "share", "side", "ad", "form", "notice", "comments"])))
            kind = "shell"
        if rng.random() < 0.35 and blocks[0][0] == "<":  # a title above the body of the text
            head = blocks.pop(0) if "<h" in blocks[0][:3] and len(blocks) > 1 else ""
            blocks = [head, self.element(rng.choice(["div", "div", "section"]), kind, "".join(blocks), rng.choice([MAIN_NAMES, MAIN_NAMES, None]))]
        tag = rng.choice(["article", "article", "article", "main", "main", "div", "div", "section"])
        plain = tag in ("article", "main") and rng.random() < 0.6
        out = self.element(tag, kind, "".join(blocks), None if plain else MAIN_NAMES if rng.random() < 0.85 else WRAP_NAMES)
        while rng.random() < 0.35:
            out = self.element(rng.choice(["div", "main", "section", "div"]), kind, out, rng.choice([None, WRAP_NAMES, MAIN_NAMES]))
        return out

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.05:  # nothing but an article
            inside = "".join(self.blocks())
            return f"<html {LABEL}=main>{inside}" if rng.random() < 0.5 else f"<html {LABEL}=main><body {LABEL}=main>{inside}</body></html>"
        parts = ["notice"] * (rng.random() < 0.3) + ["header"] * (rng.random() < 0.5) + ["menu"] * (rng.random() < 0.8) + ["ad"] * (rng.random() < 0.5)
        top = [self.other(p) for p in parts]
        bare = ["".join(b if b[0] == "<" else self.element("div", "main", b) for b in self.blocks())]
        middle = bare if rng.random() < 0.15 else [self.article()]
        for p, chance in (("side", 0.4), ("ad", 0.2), ("comments", 0.35), ("form", 0.2), ("share", 0.15), ("menu", 0.1)):
            if rng.random() < chance:
                middle.insert(len(middle) if p in ("comments", "share") or rng.random() < 0.6 else 0, self.other(p))
        if rng.random() < 0.4:
            middle = [self.element(rng.choice(["div", "main", "div"]), "shell", "".join(middle), WRAP_NAMES)]
        end = ["footer"] * (rng.random() < 0.85) + ["notice"] * (rng.random() < 0.2) + ["ad"] * (rng.random() < 0.1)
        body = "".join(top + middle + [self.other(p) for p in end])
        while rng.random() < 0.3:
            body = self.element("div", "shell", body, WRAP_NAMES)
        return f"<!DOCTYPE html><html {LABEL}=shell><head><title>{self.say(1, 8)}</title></head><body {LABEL}=shell>{body}</body></html>"


def drawn_labels(page: Page) -> np.ndarray:
    return np.array([KINDS.index(x) if x else -1 for x in page.labels])


def landmark_labels(page: Page) -> np.ndarray:
    """Labels by the elements of a page, where exactly one ``article`` or ``main`` tells; -1 elsewhere."""
    n = len(page.tags)
    marked = [k for k, t in enumerate(page.tags) if t == "article"] or [k for k, t in enumerate(page.tags) if t == "main"]
    label = np.full(n, -1)
    if len(marked) != 1 or silent_nodes(page)[marked[0]]:
        return label
    start, end = marked[0], page.ends[marked[0]]
    label[:] = OTHER
    bad = [k for k in range(start + 1, end) if page.tags[k] in BAD]
    label[start:end] = MAIN
    for k in bad:
        label[k : page.ends[k]] = OTHER
        over = page.parents[k]
        while over >= start and label[over] == MAIN:
            label[over] = SHELL
            over = page.parents[over]
    over = page.parents[start]
    while over >= 0:
        label[over] = SHELL
        over = page.parents[over]
    return label


def train(sample: list[str], layouts: int = LAYOUTS, seed: int = 11) -> Model:
    """The model fitted on drawn layouts and on those sample pages whose elements label them."""
    rng = random.Random(seed)
    given = [parse(s) for s in sample]
    words = sorted({w for p in given for *_, t in p.pieces for w in t.split() if "<" not in w and "&" not in w})
    if len(words) < 200:
        words += ["".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    drawn = Drawn(rng, words)
    pages = [parse(drawn.page()) for _ in range(layouts)]
    labels = [drawn_labels(p) for p in pages]
    for page in given:
        label = landmark_labels(page)
        if (label >= 0).any():
            pages.append(page)
            labels.append(label)
    names = learn_names(pages, labels)
    x, y = features(pages, names, {}), np.concatenate(labels)
    usable = (y >= 0) & ~np.concatenate([silent_nodes(p) for p in pages])
    return Model(names, fit(x[usable], y[usable], 3))


ANSWER = "page_id long, url string, text string, n_chars long"


def fitted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """The model for a table of pages; ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters come to the driver."""
    rows = pages.select(F.xxhash64(F.col(id_col), F.md5(html_col)).alias("h"), F.col(html_col).alias("html"))
    rows = rows.where((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS))
    share = min(1.0, 8 * SAMPLE_PAGES / max(1, pages.count()))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return train([r["html"] for r in near.orderBy("h", "html").limit(SAMPLE_PAGES).collect()])


def by_size(sources: list[str]) -> Iterator[list[str]]:
    now, size = [], 0
    for s in sources:
        now.append(s)
        size += len(s)
        if size >= CHARS_TOGETHER:
            yield now
            now, size = [], 0
    if now:
        yield now


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every whole page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema, shared = arrow_schema(ANSWER), pages.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        for batch in batches:
            texts = [t for part in by_size(batch.column(2).to_pylist()) for t in fit.texts(part)]
            yield batch_of(schema, {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInArrow(answer, ANSWER)
