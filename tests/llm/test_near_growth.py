"""Pairs that a group of near copies makes: in proportion to its members, not to their square."""

import numpy as np
from pyspark.sql import functions as F
from test_near import brute, roots_of
from test_simhash import same

from quarry.llm import near


def test_pairs_of_large_groups(spark, monkeypatch):
    """Without help from fingerprints. Lists of up to 32 members gave all their pairs: 502 different ones here at first."""
    g = np.random.default_rng(8)
    texts = []
    for size in (30, 45):
        base = [f"w{x}" for x in g.integers(0, 10**6, 150)]
        for _ in range(size):
            at = int(g.integers(150))
            texts.append(" ".join(base[:at] + [f"n{g.integers(10**6)}"] + base[at + 1 :]))
    asked = []

    def counted(pairs, *rest, verified=near.verified):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near, "fingerprint_pairs", lambda reps: reps.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(near, "verified", counted)
    assert same(roots_of(spark, texts), brute(texts))
    assert len(set(brute(texts))) == 2 and sum(asked) <= 4 * len(texts), asked


def test_lists_give_every_pair_once():
    """Round by round a list of texts that are not similar gives all its pairs between different components."""
    g = np.random.default_rng(9)
    node, n, place, root = g.permutation(10**6)[:90], g.integers(50, 80, 90), g.integers(0, 8, 90), g.integers(0, 40, 90)
    alike = lambda i, j: root[i] != root[j] and near.similar(n[i], n[j], min(n[i] - place[i], n[j] - place[j]))
    want = sorted((min(node[i], node[j]), max(node[i], node[j])) for i in range(90) for j in range(i) if alike(i, j))
    at, tried, got = 0, 0, []
    while at + 1 < 90:
        before = len(got)
        for at, a, b in near.long_pairs(node, n, place, root, at, tried):
            got += zip(a, b)
        assert len(got) - before <= 45 * 4**tried + 90
        tried += 1
    assert sorted(got) == want
