"""Main text of pages: parsing, decoding against all labellings, held-out layouts, odd rows."""

import functools
import itertools
import random

import numpy as np
import pytest

from reqweave.llm import boosting, pagetext
from reqweave.llm.common import start
from reqweave.llm.dom import main_text, parse

WORDS = "harbour river stone market early letter window seven garden before under which their people small quiet winter bridge answer north".split()


def whole(source):
    page = parse(source)
    return main_text(page, [True] * len(page.tags))


def tree(source):
    page = parse(source)
    return [(t, page.tags[p] if p >= 0 else None, e) for t, p, e in zip(page.tags, page.parents, page.ends, strict=True)][1:]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a <b>b<p>c</b> d", "a b\nc d"), ("<ul><li>one<li>two <i>x</i></ul>tail", "one\ntwo x\ntail"), ("a &lt; b &amp; c &eacute; &#8364; &nope; &amp", "a < b & c é € &nope; &"),
        ("x<script>var t='</p>';</script>y<style>p{}</style>z", "xyz"), ("<div>a\n\t b&nbsp;c<br>d</div>", "a b c d"), ("1 < 2 and <3", "1 < 2 and <3"), ("a<!-- no <p> -->b<!-- open", "ab"),
        ("<div>a</span></i>b</div></div>c", "ab\nc"), ("<td>a<td>b<tr><td>c", "a\nb\nc"), ("<p title='x > y'>q</p><p class=\"a>r", "q\nr"), ("<head><title>t</title><meta><p>body", "body"),
        ("<textarea>no<p></textarea>yes<select><option>n</select>!", "yes!"), ("", ""), ("<", "<"), ("<p", ""), ("<script>never closed <p>", ""), ("<button>go</button>x<hr>y", "x\ny"),
    ],
)
def test_parsing(source, want):
    assert whole(source) == want


def test_trees_close_what_is_open():
    assert tree("<div><p>a<div>b</div></div><p>c") == [("div", "html", 4), ("p", "div", 3), ("div", "div", 4), ("p", "html", 5)]
    assert tree("<ul><li>a<ul><li>b</ul><li>c</ul>") == [("ul", "html", 6), ("li", "ul", 5), ("ul", "li", 5), ("li", "ul", 5), ("li", "ul", 6)]
    assert parse('<div class="a b" id=c data-kind="main" data-class="no">').marks[1] == "a b c"


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 30_000 + "x"
    assert len(parse(deep).tags) == 30_001
    assert len(whole("<b>" * 50_000 + "x" + "</i>" * 50_000)) == 1
    assert len(parse('<p a="' * 50_000).tags) >= 1


def plain_decoding(page, chance):
    """The best of all allowed labellings."""
    best, found = -np.inf, None
    for label in itertools.product(range(3), repeat=len(page.tags)):
        pairs = [(label[p], label[k]) for k, p in enumerate(page.parents) if p >= 0]
        if any((a == pagetext.OTHER and b != a) or (a == pagetext.MAIN and b == pagetext.SHELL) for a, b in pairs):
            continue
        score = sum(chance[k, x] for k, x in enumerate(label))
        if score > best:
            best, found = score, label
    return found


def test_decoding_against_all_labellings():
    rng = np.random.default_rng(3)
    shapes = ["<div><p>a</p><p>b</p></div><div>c</div>", "<div><div><div><p>a", "<p>a<p>b<p>c<p>d<p>e", "<ul><li>a<li>b<ul><li>c</ul></ul>"]
    for shape in shapes * 6:
        pages = [parse(shape), parse("<p>x")]
        chance = np.log(rng.dirichlet([1, 1, 1], sum(len(p.tags) for p in pages)))
        got = pagetext.decode(pages, chance)
        cut = len(pages[0].tags)
        assert tuple(got[:cut]) == plain_decoding(pages[0], chance[:cut]) and tuple(got[cut:]) == plain_decoding(pages[1], chance[cut:])


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6))
    y = np.where(x[:, 4] > 0.5, 2, (x[:, 0] * x[:, 2] > 0).astype(int))
    forest = boosting.fit(x[:3000], y[:3000], 3, rounds=25)
    scores = forest.scores(x[3000:])
    assert (scores.argmax(axis=1) == y[3000:]).mean() > 0.95
    assert np.allclose(np.exp(scores).sum(axis=1), 1)


def template(rng, k):
    """A page as crawlers bring it, and its article."""
    say = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    blocks = [say(1, 8)] + [say(2, 60) for _ in range(rng.randint(1, 9))]
    links = "".join(f"<li><a href=/{w}>{w}</a>" for w in rng.sample(WORDS, 5))
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}" for b in blocks[1:])
    page = f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><script>f('<p>')</script></head><body><nav><ul>{links}</ul></nav><div class=ad>{say(4, 12)}</div><article>{body}</article>"
    return page + f"<footer>&copy; {say(2, 9)}</footer>" + ("</body></html>" if k % 5 else ""), "\n".join(blocks)


@functools.cache
def model():
    rng = random.Random(4)
    return pagetext.train([template(rng, k)[0] for k in range(60)], layouts=700)


def test_held_out_layouts():
    rng = random.Random(77)
    drawn, shared, seen, exact = pagetext.Drawn(rng, WORDS), 0, 0, 0
    for _ in range(200):
        source = drawn.page()
        page = parse(source)
        want = main_text(page, (pagetext.drawn_labels(page) == pagetext.MAIN).tolist())
        got = model().texts([source])[0]
        exact += got == want
        a, b = set(want.split("\n")), set(got.split("\n"))
        shared, seen = shared + len(a & b), seen + len(a | b)
    assert exact >= 185 and shared / seen > 0.97


LONG = "The committee met on Tuesday to discuss the new proposal, which would change how the city funds its libraries. Members were split, and no vote was taken."
SHORT = "Officials said that more time was needed."


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<div id=nav><a href=/>Home</a> <a href=/n>News</a></div><div id=main><h1>Libraries</h1><p>{LONG}<p>{SHORT}</div><div id=foot>Copyright</div>", f"Libraries\n{LONG}\n{SHORT}"),
        (f"<main><p>{LONG}</p><p>{SHORT}</p><div class='comment-area'><p>{LONG}</p><p>Not my view at all.</p></div></main><aside>More here.</aside>", f"{LONG}\n{SHORT}"),
        (f"<div class=cookie-consent>We use cookies to make this site better.</div><div class=story-text><p>{LONG}</p><p>{LONG}</p></div><form><p>Write to us.</p></form>", f"{LONG}\n{LONG}"),
        ("<nav><a href=/>Home</a></nav>", ""), (LONG, LONG),
    ],
)
def test_pages_of_other_makers(source, want):
    assert model().texts([source]) == [want]


SCHEMA = "page_id long, url string, html string, text string, n_chars long, tag string, parent int"


def test_pages_of_a_table(spark):
    start(spark)
    rng = random.Random(9)
    drawn = [template(rng, k) for k in range(40)]
    data = [(k, f"u{k}", page) for k, (page, _) in enumerate(drawn)]
    big = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(20_000)) + "</article>"
    data += [(100, None, None), (101, "u", ""), (None, "u", drawn[3][0]), (102, "v", big), (5, "u5", drawn[5][0])]
    frame = spark.createDataFrame([(*r, "clash", 3, "t", 7) for r in data], SCHEMA).repartition(3)
    got = pagetext.extract(frame, model())
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(data) and all(r.n_chars == len(r.text) for r in rows)
    text = {r.page_id: r.text for r in rows}
    assert [text[k] for k in range(40)] == [want for _, want in drawn]
    assert text[100] == text[101] == "" and text[None] == drawn[3][1] and text[102].count("\n") == 19_999
    assert [r.url for r in rows if r.page_id == 100] == [None]
    none = frame.limit(0)
    assert pagetext.extract(none, model()).count() == 0


def test_model_without_pages(spark):
    start(spark)
    none = spark.createDataFrame([], SCHEMA)
    fitted = pagetext.fitted(none)
    assert fitted.texts([f"<nav><a>a</a></nav><article><p>{LONG}</p></article>"]) == [LONG] and fitted.texts([]) == []
