"""Operator 11: main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of blocks: elements that make blocks, and runs of text between them (inline markup belongs to
its run). Every node has a hidden label, content or not. Potentials are log-linear: one of the node's own features, one for
a node that has its parent's label, by the node's kind. Messages go up and then down the tree
(sum-product), all nodes of one depth of all pages of a batch at once, so marginals are exact and cost is linear in
the nodes, however deep. A run whose content marginal is MARGIN or more is text of the page.

Training: the likelihood of labelled pages is convex in the weights; its gradient, observed features less those that
the marginals expect, comes from the same messages. Labelled pages are those of `layouts.py`, labelled by hand, and
up to SAMPLE pages of the table that label themselves: their markup holds exactly one <article> or <main>, of which what is
not a menu, header, footer, sidebar, form or advert by tag or class name is content. They are chosen by a hash
of the page. Each is learned twice, once with that element's name taken away, so that the model must tell content
where no element says so.

Defined results: white space is what str.split() says; a line break inside a block is white space; null and empty pages have
the empty text; repeated rows each give a row; other columns are ignored; an empty table gives none. Elements that show no
text (script, style, title, form controls, templates, frames, media) and hidden ones are markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches

MARGIN = 0.5
#: Pages of the table that train the model, nodes of a block of messages.
SAMPLE, NODES = 100, 200_000
RIDGE, STEPS = 0.05, 250

# HTML's own names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSHOWN = RAW | frozenset("head template noscript svg math canvas object audio video select option optgroup button datalist input map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt tr td th tbody thead tfoot".split()
)
#: What a start tag closes if it is open, up to the elements that shut the search in.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Words in class names, ids and roles, by what they speak for.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar toolbar sitemap skip",
    "edge": "header masthead banner footer foot copyright legal bottom",
    "side": "sidebar side aside widget rail secondary complementary related recommended more teaser teasers promo popular trending",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored adsense adbox dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay subscribe subscription newsletter paywall signup message",
    "form": "form search login contactform searchform register",
    "talk": "comment comments disqus reply replies respond discussion reviews",
    "share": "share sharing social follow tags tag meta byline author print tools",
    "main": "article content main post entry story text body page prose maincontent articlebody postbody",
}
NAMED = {w: k for k, ws in NAMES.items() for w in ws.split()}
TAGS = {t: t for t in "article main section div p ul ol li dl dd dt table tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details body html".split()} | {h: "heading" for h in HEADINGS}
KINDS = {"run": 0, "p": 1, "heading": 2, "li": 3, "ul": 4, "ol": 4, "dl": 4, "table": 5, "tr": 5, "td": 5, "th": 5, "article": 6, "main": 6, "nav": 7, "header": 7, "footer": 7, "aside": 7, "form": 7}
OTHER = 8
#: What self-labelled pages hold beside their content, by tag and by name.
BARRED = ("nav", "header", "footer", "aside", "form")
ASIDE = frozenset(NAMES) - {"main"}

FEATURES = (
    ["bias", "run", "empty"] + [f"tag {t}" for t in sorted(set(TAGS.values()))] + [f"name {k}" for k in NAMES] + [f"run in {t}" for t in ("p", "heading", "li", "td", "div", "other")]
    + ["words", "many words", "few words", "sentence", "link share", "all links", "copyright", "pipe", "words below", "link share below", "long below", "paragraphs below", "under main", "under aside"]
)
AT = {f: i for i, f in enumerate(FEATURES)}
#: What HTML's names mean, as centres of the weights before training.
PRIOR = np.array([2.0 if f == "under main" else -2.0 if f == "under aside" else 0.0 for f in FEATURES])
KINDS_N = OTHER + 1

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’)]?(?:\s|$)")
COPYRIGHT = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)


def names_of(value: str) -> set[str]:
    """Kinds of words that class names, ids and roles hold: main-content, mainContent and main_content alike."""
    split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
    return {NAMED[w] for w in WORD.findall(split) if w in NAMED}


@dataclass
class Tree:
    """Blocks of a page in page order; parent of the first is -1. text is None for elements."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[set[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: set[str], text: str | None = None, linked: int = 0, mark: str | None = None) -> int:
        self.parent.append(parent), self.tag.append(tag), self.names.append(names), self.text.append(text), self.linked.append(linked), self.marks.append(mark)
        return len(self.parent) - 1


def _raw_end(name: str, page: str, at: int) -> int:
    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def parse(page: str) -> Tree:
    """The block tree of a page. Any text is a page: what is not markup is text, what is not closed ends with its parent."""
    tree = Tree()
    stack = [tree.add(-1, "html", set())]
    hidden: list[str] = []  # open elements of which nothing is shown
    run: list[str] = []
    linked, link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            tree.add(stack[-1], "run", set(), text, min(linked, len(text)))
        run.clear()
        linked = 0

    def shut(depth: int) -> None:
        nonlocal link
        flush()
        del stack[depth:]
        link = 0

    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at and not hidden:
            run.append(page[at:stop])
            if link:
                linked += stop - at
        if not found:
            break
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if found["end"]:
            if hidden:
                if name in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                continue
            if name in INLINE:
                if name == "a":
                    link = 0
                elif name == "br":
                    run.append(" ")
                continue
            for d in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[d]] == name:
                    shut(d)
                    break
            continue
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(found["rest"])} if found["rest"].strip(" /\n\t") else {}
        if hidden == ["p"] and name in ENDS_P or hidden == ["li"] and name == "li":
            hidden.clear()
        closed = found["rest"].endswith("/") and name in ("svg", "math", "canvas", "object")
        if hidden or name in UNSHOWN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
            if hidden and hidden[-1] == "head" and name not in UNSHOWN | {"meta", "link", "base"}:
                hidden.clear()  # a head that was never closed
            elif name in VOID or closed:
                continue
            elif name in RAW:
                at = _raw_end(name, page, at)
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
                continue
            else:
                if not hidden and name not in INLINE:
                    flush()
                if not hidden or name == hidden[-1] or name not in INLINE:
                    hidden.append(name)
                continue
        if name in INLINE:
            if name == "a":
                link = 1
            elif name in ("br", "wbr"):
                run.append(" " if name == "br" else "")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        link = 0
        if name in ("html", "body"):
            names = names_of(f"{attributes.get('class', '')} {attributes.get('id', '')}") if name == "body" else set()
            tree.names[stack[0]] |= names & {"main"}
            continue
        if name in ENDS_P and tree.tag[stack[-1]] == "p":
            stack.pop()
        if name in HEADINGS and tree.tag[stack[-1]] in HEADINGS:
            stack.pop()
        if name in CLOSES:
            closes, walls = CLOSES[name]
            for d in range(len(stack) - 1, 0, -1):
                t = tree.tag[stack[d]]
                if t in walls:
                    break
                if t in closes:
                    first = d
                    while first > 1 and tree.tag[stack[first - 1]] in closes and name in ("tr", "tbody", "tfoot"):
                        first -= 1
                    del stack[first:]
                    break
        names = names_of(" ".join(attributes.get(a, "") for a in ("class", "id", "role", "itemprop"))) if attributes else set()
        stack.append(tree.add(stack[-1], name, names, mark=attributes.get("data-label")))
    flush()
    return tree


def features(tree: Tree) -> np.ndarray:
    """One row a node, nodes by FEATURES."""
    n = len(tree.parent)
    x = np.zeros((n, len(FEATURES)))
    x[:, AT["bias"]] = 1
    words, linked, size, paragraphs, long_ = (np.zeros(n) for _ in range(5))
    for i in range(n):
        tag, row = tree.tag[i], x[i]
        for k in tree.names[i]:
            row[AT[f"name {k}"]] = 1
        text = tree.text[i]
        if text is None:
            if tag in TAGS:
                row[AT[f"tag {TAGS[tag]}"]] = 1
            continue
        up = tree.tag[tree.parent[i]]
        place = "heading" if up in HEADINGS else up if up in ("p", "li", "td", "div") else "other"
        w = text.count(" ") + 1
        words[i], linked[i], size[i] = w, tree.linked[i], len(text)
        sentence = SENTENCE.search(text) is not None
        long_[i] = w >= 12 and sentence
        paragraphs[i] = up == "p" and w >= 5
        row[AT["run"]], row[AT[f"run in {place}"]] = 1, 1
        row[AT["words"]], row[AT["many words"]], row[AT["few words"]] = min(np.log1p(w), 6) / 3, w >= 20, w <= 3
        row[AT["sentence"]], row[AT["link share"]] = sentence, min(1.0, tree.linked[i] / len(text))
        row[AT["all links"]] = tree.linked[i] >= 0.9 * len(text)
        row[AT["copyright"]], row[AT["pipe"]] = COPYRIGHT.search(text) is not None, "|" in text or "»" in text
    for i in range(n - 1, 0, -1):  # parents come before children
        up = tree.parent[i]
        words[up] += words[i]
        linked[up] += linked[i]
        size[up] += size[i]
        paragraphs[up] += paragraphs[i]
        long_[up] += long_[i]
    element = np.array([t is None for t in tree.text])
    x[:, AT["words below"]] = np.where(element, np.minimum(np.log1p(words), 8) / 4, 0)
    x[:, AT["link share below"]] = np.where(element, np.minimum(1, linked / np.maximum(size, 1)), 0)
    x[:, AT["long below"]] = np.where(element, np.minimum(np.log1p(long_), 4) / 2, 0)
    x[:, AT["paragraphs below"]] = np.where(element, np.minimum(np.log1p(paragraphs), 4) / 2, 0)
    x[:, AT["empty"]] = element & (size == 0)
    under = surroundings(tree)
    x[:, AT["under main"]], x[:, AT["under aside"]] = under == 1, under == 2
    return x


def surroundings(tree: Tree) -> np.ndarray:
    """Of every node: 1 in an <article> or <main>, 2 in something that names itself as beside the content, as the nearest of both says; else 0.
    A header or footer of an article belongs to it."""
    out = np.zeros(len(tree.parent), np.int64)
    for i, (up, tag, names) in enumerate(zip(tree.parent, tree.tag, tree.names)):
        above = out[up] if up >= 0 else 0
        beside = tag in BARRED and not (tag in ("header", "footer") and above == 1) or names & ASIDE and tag not in ("body", "html")
        out[i] = 1 if tag in ("article", "main") else 2 if beside else above
    return out


def kinds(tree: Tree) -> np.ndarray:
    """Kinds of nodes that differ in how they follow their parents: by name first, then by tag."""
    out = []
    for tag, names in zip(tree.tag, tree.names):
        named = "nav" if names & ASIDE else "main" if names else tag
        out.append(KINDS["heading"] if named in HEADINGS else KINDS.get(named, OTHER))
    return np.array(out, np.int64)


@dataclass
class Forest:
    """Trees of several pages, one after the other: their nodes by depth, for messages of whole depths."""

    parent: np.ndarray
    x: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]

    @staticmethod
    def of(trees: list[Tree]) -> Forest:
        starts = np.cumsum([0] + [len(t.parent) for t in trees])
        parent = np.concatenate([np.where((p := np.array(t.parent, np.int64)) < 0, -1, p + s) for t, s in zip(trees, starts)])
        depth = np.zeros(len(parent), np.int64)
        for i, up in enumerate(parent.tolist()):
            depth[i] = depth[up] + 1 if up >= 0 else 0
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        return Forest(parent, np.vstack([features(t) for t in trees]), np.concatenate([kinds(t) for t in trees]), levels)


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def marginals(forest: Forest, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product: P(content) of every node; P(parent's label, label) of every node with a parent (roots: zero); log Z.

    own is the log potential of content (of the other label 0), pair[kind] that of a label like the parent's (of another one 0).
    """
    n = len(own)
    pair = pair[:, None, None] * np.eye(2)
    up = np.column_stack([np.zeros(n), own])  # own potential and what comes from below
    sent = np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        sent[level] = _sum(pair[forest.kind[level]] + up[level][:, None, :], 2)
        np.add.at(up, forest.parent[level], sent[level])
    down = np.zeros((n, 2))  # what comes from above, by own label
    both = np.zeros((n, 2, 2))
    log_z = float(_sum(up[forest.levels[0]], 1).sum())
    for level in forest.levels[1:]:
        p = forest.parent[level]
        rest = up[p] + down[p] - sent[level]
        joint = rest[:, :, None] + pair[forest.kind[level]]
        down[level] = _sum(joint, 1)
        joint = joint + up[level][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        both[level] = joint / joint.sum((1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), both, log_z


@dataclass
class Model:
    own: np.ndarray  # a weight for each feature
    pair: np.ndarray  # and for each kind

    def content(self, trees: list[Tree]) -> np.ndarray:
        forest = Forest.of(trees)
        return marginals(forest, forest.x @ self.own, self.pair)[0]

    def texts(self, pages: list[str]) -> list[str]:
        out: list[str] = []
        held: list[Tree] = []

        def take() -> None:
            likely = self.content(held)
            at = 0
            for t in held:
                out.append("\n".join(x for x, p in zip(t.text, likely[at : at + len(t.text)]) if x is not None and p >= MARGIN))
                at += len(t.text)
            held.clear()

        nodes = 0
        for page in pages:
            tree = parse(page)
            held.append(tree)
            nodes += len(tree.parent)
            if nodes > NODES:
                take()
                nodes = 0
        if held:
            take()
        return out


def labels_of(content: list[bool], tree: Tree) -> np.ndarray:
    """Labels of all nodes: a run's own; an element's, what most of the text below it is (without text, that of its parent)."""
    n = len(tree.parent)
    good, all_ = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            all_[i] = len(tree.text[i])
            good[i] = all_[i] if content[i] else 0
        if i:
            good[tree.parent[i]] += good[i]
            all_[tree.parent[i]] += all_[i]
    y = np.zeros(n, np.int64)
    for i in range(n):
        y[i] = 2 * good[i] >= all_[i] if all_[i] else (y[tree.parent[i]] if i else 0)
    return y


def by_marks(tree: Tree) -> list[bool]:
    """Content by data-label attributes: that of the nearest element that has one."""
    state = [False] * len(tree.parent)
    for i, up in enumerate(tree.parent):
        state[i] = tree.marks[i] == "main" if tree.marks[i] else up >= 0 and state[up]
    return state


def by_element(tree: Tree) -> list[bool] | None:
    """Content of a page that labels itself; None if it does not."""
    found = [i for i, t in enumerate(tree.tag) if t in ("article", "main")]
    if len(found) != 1:
        return None
    state = [0] * len(tree.parent)  # 0 outside, 1 content, 2 barred inside
    for i, up in enumerate(tree.parent):
        state[i] = state[up] if up >= 0 else 0
        if i == found[0]:
            state[i] = 1
        elif state[i] == 1 and tree.text[i] is None and (tree.tag[i] in BARRED or tree.names[i] & ASIDE):
            state[i] = 2
    return [s == 1 for s in state]


def blind(tree: Tree) -> Tree:
    """The same page with its main element unnamed."""
    main = [t in ("article", "main") for t in tree.tag]
    return Tree(tree.parent, ["div" if m else t for m, t in zip(main, tree.tag)], [set() if m else s for m, s in zip(main, tree.names)], tree.text, tree.linked, tree.marks)


def train(pages: list[tuple[Tree, list[bool], float]], steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Weights of greatest likelihood of (tree, content, weight), less a ridge around PRIOR, by gradient steps with momentum (the aim is convex)."""
    forest = Forest.of([t for t, _, _ in pages])
    y = np.concatenate([labels_of(c, t) for t, c, _ in pages])
    inner = np.flatnonzero(forest.parent >= 0)
    of = np.repeat([w for _, _, w in pages], [len(t.parent) for t, _, _ in pages])
    seen = np.bincount(forest.kind[inner], of[inner] * (y[forest.parent[inner]] == y[inner]), KINDS_N)
    own, pair = PRIOR.copy(), np.zeros(KINDS_N)
    first, second = [np.zeros_like(own), np.zeros_like(pair)], [np.zeros_like(own), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        likely, both, _ = marginals(forest, forest.x @ own, pair)
        expected = np.bincount(forest.kind[inner], of[inner] * (both[inner, 0, 0] + both[inner, 1, 1]), KINDS_N)
        gradient = (forest.x.T @ (of * (y - likely)) - ridge * (own - PRIOR), seen - expected - ridge * pair)
        for k, (g, w) in enumerate(zip(gradient, (own, pair))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w += 0.1 * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(own, pair)


def fit(pages: DataFrame, sample: int = SAMPLE, page: str = "html") -> Model:
    """A model from the labelled layouts and up to `sample` self-labelled pages of the table: distinct ones of the smallest hashes,
    so the same at every order of rows. A page over a million characters teaches nothing (it is extracted like any other)."""
    from quarry.llm.layouts import LAYOUTS

    known = pages.where(F.col(page).rlike("(?i)<(article|main)[\\s>]") & (F.length(page) <= 1_000_000)).select(F.col(page).alias("html"))
    hashed = known.select(F.xxhash64("html").alias("h"), "html")
    few = hashed.select("h").distinct().orderBy("h").limit(sample)
    chosen = hashed.join(F.broadcast(few), "h").groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return learned([r["html"] for r in chosen], LAYOUTS)


def learned(pages: list[str], layouts: list[str]) -> Model:
    """A model of layouts (by their marks) and of those pages that label themselves; all pages weigh twice as much as all layouts."""
    own = [(t, c) for t in map(parse, pages) if (c := by_element(t)) is not None]
    labelled = [(t, by_marks(t), 1.0) for t in map(parse, layouts)]
    for tree, content in own:
        labelled += [(t, content, len(layouts) / len(own)) for t in (tree, blind(tree))]
    return train(labelled)


def main_text(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = model.texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kept['page_id']}, url {kept['url']}, text string, n_chars long")
