"""Near copies of the pipeline against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F
from test_simhash import same

import corpus_pipeline
from quarry.llm import near

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def corpus():
    """Changed copies of some texts, many of one of them, and many different texts around one common passage."""
    g = np.random.default_rng(4)
    passage = " ".join(f"common{i}" for i in range(30))
    texts = [" ".join(f"w{x}" for x in g.integers(0, 400, 110 if k == 0 else int(g.integers(1, 120)))) for k in range(60)]
    for k in range(200):
        w = texts[0 if k % 2 else int(g.integers(60))].split(" ")
        for at in g.integers(0, len(w), int(g.integers(1, 3))):
            w[at] = f"n{g.integers(10**6)}"
        texts.append(" ".join(w[: len(w) - int(g.integers(0, 3))]))
    texts += [passage + " " + " ".join(f"z{g.integers(10**6)}" for _ in range(int(g.integers(1, 12)))) for _ in range(100)]
    return texts + ["", None, " \n", "one two", "One  TWO", texts[3], texts[3]]


def roots_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rid", F.col("doc_id"))
    rows, roots = near.near_groups(docs)
    got = {r.doc_id: r.root for r in rows.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")).collect()}
    return [got[i] for i in range(len(texts))]


def test_groups_against_all_pairs(spark, monkeypatch):
    texts = corpus()
    want = brute(texts)
    assert len(set(want)) < len(want) - 80
    assert same(roots_of(spark, texts), want)
    monkeypatch.setattr(near, "SHORT", 3)
    monkeypatch.setattr(near, "LOOKED_UP", 0)
    assert same(roots_of(spark, texts), want)


def test_sketches_never_tell_too_many_differences():
    g = np.random.default_rng(5)
    for n, m, common in ((0, 3, 0), (1, 1, 0), (64, 65, 60), (300, 260, 250), (90, 2000, 10)):
        all_ = g.integers(-(2**63), 2**63 - 1, n + m - common)
        a, b = np.unique(all_[:n]), np.unique(all_[n - common :])
        got = near.differences(near.sketch(a), near.sketch(b))
        assert 0 <= got <= n + m - 2 * common and (common or got)
        assert near.differences(near.sketch(a), near.sketch(a)) == 0


def test_stage_drops_near_copies(spark):
    """Fingerprints of such copies differ by more than two bits: the contract of operator 5 kept them."""
    g = np.random.default_rng(3)
    base = [f"w{x}" for x in g.integers(0, 1000, 200)]
    copies = [" ".join(base[:at] + [f"new{at}"] + base[at + 1 :]) for at in (20, 60, 100, 140, 180)]
    other = " ".join(f"v{x}" for x in g.integers(0, 1000, 200))
    rows = [(7, " ".join(base)), *((10 + k, t) for k, t in enumerate(copies)), (None, copies[0]), (None, other), (3, "alone"), (3, "another text of the same key")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted([(7, rows[0][1]), (0, other), (3, "alone"), (3, "another text of the same key")])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0
