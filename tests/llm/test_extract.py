import html
import itertools
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from quarry.llm import extract
from quarry.llm.extract import Forest, Model, Tree, by_element, by_marks, fit, learned, main_text, marginals, parse, train
from quarry.llm.layouts import LAYOUTS

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(PAGES).to_pylist()


@pytest.fixture(scope="module")
def model(pages):
    return learned([p["html"] for p in pages[:60]], LAYOUTS)


def runs(page):
    return [t for t in parse(page).text if t is not None]


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    trees = []
    for n in (1, 2, 6, 9):
        t = Tree()
        for i in range(n):
            t.add(-1 if i == 0 else int(r.integers(0, i)), "p" if i % 2 else "div", set())
        trees.append(t)
    forest = Forest.of(trees)
    own, pair = r.normal(0, 2, len(forest.parent)), r.normal(0, 1.5, extract.KINDS_N)
    got, both, log_z = marginals(forest, own, pair)
    at, total = 0, 0.0
    for t in trees:
        n = len(t.parent)
        some, same, z = np.zeros(n), np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=n):
            kind = forest.kind[at : at + n]
            w = np.exp(sum(own[at + i] * y[i] for i in range(n)) + sum(pair[kind[i]] for i in range(1, n) if y[i] == y[t.parent[i]]))
            z += w
            some += w * np.array(y)
            same += w * np.array([i > 0 and y[i] == y[t.parent[i]] for i in range(n)])
        total += np.log(z)
        assert np.allclose(got[at : at + n], some / z) and np.allclose(both[at + 1 : at + n, 0, 0] + both[at + 1 : at + n, 1, 1], same[1:] / z)
        at += n
    assert np.isclose(log_z, total)


def test_training_finds_the_likeliest_weights():
    """At the end no step in any direction of the weights raises the penalised likelihood."""
    labelled = [(t, by_marks(t), 1.0) for t in map(parse, LAYOUTS)]
    model = train(labelled, steps=1500, ridge=0.5)
    forest = Forest.of([t for t, _, _ in labelled])
    y = np.concatenate([extract.labels_of(c, t) for t, c, _ in labelled])
    inner = forest.parent >= 0

    def likelihood(own, pair):
        z = marginals(forest, forest.x @ own, pair)[2]
        same = (y[forest.parent] == y) & inner
        return y @ (forest.x @ own) + pair[forest.kind[same]].sum() - z - 0.25 * ((own - extract.PRIOR) ** 2).sum() - 0.25 * (pair**2).sum()

    best = likelihood(model.own, model.pair)
    r = np.random.default_rng(1)
    for _ in range(40):
        a, b = r.normal(0, 0.05, len(model.own)), r.normal(0, 0.05, len(model.pair))
        assert likelihood(model.own + a, model.pair + b) < best


def test_deep_and_long_pages(model):
    deep = "<div>" * 3000 + "<p>At the bottom there is a sentence.</p>"
    assert len(parse(deep).parent) == 3003 and len(model.texts([deep])) == 1
    long_ = "<article><h1>Long</h1>" + "<p>One of very many paragraphs in this text.</p>" * 30_000 + "</article>"
    assert model.texts([long_])[0].count("\n") == 30_000
    quotes = "<a href='" * 20_000
    assert len(model.texts([quotes])) == 1


def test_parse():
    assert runs("a<b>b</b>c<br>d") == ["abc d"]
    assert runs("<p>one<p>two</p>three<div>four") == ["one", "two", "three", "four"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert runs("<script>var t='</p><p>no';</script><style>p{}</style><p>x &amp; y&nbsp; &lt;z&#33;</p><!-- <p>no</p> -->") == ["x & y <z!"]
    assert runs("<head><title>no</title><meta name=a><p>head never closed</p>") == ["head never closed"]
    assert runs("<div hidden><p>no</p></div><p aria-hidden=true>no<p style='display: none'>no</p><p>yes") == ["yes"]
    assert runs("<select><option>no<option>no</select><button>no</button>yes<textarea><p>no</textarea>") == ["yes"]
    assert runs("1 < 2 and <3") == ["1 < 2 and <3"]
    assert runs("") == runs("<!DOCTYPE html>") == runs("<p></p>") == runs("<!-- never closed") == []
    assert parse('<p>a <a href="x>y">link</a></p>').linked[-1] == 4


def article(page):
    """What the given pages hold in their article, by a reading of its own."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_every_given_page(pages, model):
    assert model.texts([p["html"] for p in pages]) == [article(p["html"]) for p in pages]


def test_pages_whose_article_is_not_named(pages, model):
    for p in pages[60:]:
        page = p["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert model.texts([page]) == [article(p["html"])]


UNSEEN = [
    '<body><div id="header-nav"><a href=1>Start</a> <a href=2>Topics</a></div><div class="story-body" data-label="main"><h1>Rain at last</h1><p>After nine dry weeks the rain came on Sunday night.</p><p>Farmers had been waiting for it since May, and some had given up hope.</p></div><div class="sidebar-right"><p>Our reporters write every day about the land and its people.</p></div><div id="comments"><p>Great text, thank you for writing it!</p><p>I do not agree at all with this.</p></div></body>',
    '<body><nav><a href=1>A</a><a href=2>B</a></nav><main data-label="main"><h2>How to prune</h2><ul><li>Cut in late winter, before the buds open.</li><li>Use a sharp knife.</li></ul><p>Leave the strongest branch alone. It will carry the fruit.</p><aside data-label="none"><p>Sign up for our letters and never miss a tip again.</p></aside></main><footer><p>All rights reserved by the gardeners.</p></footer></body>',
    '<body><div class="consent-popup"><p>This site stores data on your machine, if you let it.</p></div><article data-label="main"><p>Short.</p><p>The second paragraph says rather more than the first one did.</p></article><form action="/s"><p>Write to us and tell us what you think.</p></form></body>',
]


def test_layouts_it_was_not_trained_on(model):
    for page in (*UNSEEN, *LAYOUTS):
        tree = parse(page)
        assert model.texts([page]) == ["\n".join(t for t, c in zip(tree.text, by_marks(tree)) if t is not None and c)]


def test_self_labelled():
    assert by_element(parse("<p>x</p>")) is None and by_element(parse("<article>a</article><article>b</article>")) is None
    tree = parse('<nav>n</nav><article><h1>t</h1><div class="ad">a</div><p>p</p></article>')
    assert [t for t, c in zip(tree.text, by_element(tree)) if t is not None and c] == ["t", "p"]


def test_frames(spark, model):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>Kept as it is, twice over.</p></article>"), (2, "v", "<article><p>Kept as it is, twice over.</p></article>"), (3, "w", "<script>1</script>")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in main_text(df, model).collect())
    kept = "Kept as it is, twice over."
    assert got == sorted([("1", "u", "", 0), ("1", "u", "", 0), ("None", None, kept, len(kept)), ("2", "v", kept, len(kept)), ("3", "w", "", 0)], key=lambda r: r[0])
    assert main_text(df.limit(0), fit(df.limit(0))).count() == 0


def test_fit_does_not_depend_on_order(spark):
    df = spark.read.parquet(PAGES).select("html")
    a, b = fit(df, 10), fit(df.orderBy("html").repartition(3), 10)
    assert isinstance(a, Model) and np.array_equal(a.own, b.own) and np.array_equal(a.pair, b.pair)
