"""Pairs and lists must grow with the table, not with the square of a group that is alike but not similar enough."""

import numpy as np
from pyspark.sql import functions as F
from test_near import brute, corpus, roots_of
from test_simhash import same

from quarry.llm import near


def none(reps):
    return reps.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def test_group_below_the_limit(spark, monkeypatch):
    """All pairs of such a group were given at last, 3,160 here. Its shingles are not frequent, as in a large table."""
    g = np.random.default_rng(12)
    base, texts = [f"w{x}" for x in g.integers(0, 10**6, 300)], []
    for _ in range(80):
        words = list(base)
        for at in g.choice(300, 8, replace=False):
            words[at] = f"n{g.integers(10**6)}"
        texts.append(" ".join(words))
    asked = []

    def counted(pairs, *rest, verified=near.verified):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near, "rarity", lambda numbered: np.zeros(near.COUNTERS, np.uint8))
    monkeypatch.setattr(near, "fingerprint_pairs", none)
    monkeypatch.setattr(near, "verified", counted)
    want = brute(texts)
    assert len(set(want)) > 60
    assert same(roots_of(spark, texts), want)
    assert sum(asked) <= 8 * len(texts), asked


def test_narrowed_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "LONG", 3)
    monkeypatch.setattr(near, "fingerprint_pairs", none)
    texts = corpus()
    assert same(roots_of(spark, texts), brute(texts))


def test_what_stands_elsewhere(spark):
    """For each node the members of its set that nodes with another root hold, too."""
    texts = ["a b c d e f g h", "a b c d e f x y", "b c d e f g h i", "q r s t u v w", "a b c d e f g z"]
    roots = [0, 1, 0, 3, 0]
    sets = [set(near.shingle_set(t).tolist()) for t in texts]
    want = {i: sum(any(x in sets[j] for j in range(5) if roots[j] != roots[i]) for x in sets[i]) for i in range(5)}
    want[3] = 0  # in no list
    numbered = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    reps = spark.createDataFrame([(i, i) for i in range(5)], "node long, rid long")
    members = [(i, len(sets[i]), 0, roots[i] if roots[i] != i else None) for i in (0, 1, 2, 4)]
    lists = spark.createDataFrame([(7, members), (8, members[:2])], "s long, members array<struct<node: long, n: int, place: int, root: long>>")
    got = {r.node: r.most for r in near.elsewhere(lists, numbered, reps).collect()}
    assert {i: got.get(i, 0) for i in range(5)} == want and sum(want.values()) > 3


def test_counts_cover_the_table(spark, monkeypatch):
    """Every counter holds how many texts have its shingles, however many tasks are added up at a time; rarer ones come first."""
    monkeypatch.setattr(near, "COUNTERS", 1 << 12)
    monkeypatch.setattr(near, "BLOCK", 1 << 8)
    texts = [f"a b c d e {i} {i + 1} {i + 2}" if i % 2 == 0 else f"{i} {i + 1} {i + 2} x y z" for i in range(800)] + ["", None]
    numbered = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(7)
    want = np.zeros(near.COUNTERS, int)
    for t in texts:
        np.add.at(want, near.counter(near.shingle_set(t), near.COUNTERS), 1)
    for fan in (2, 32):
        monkeypatch.setattr(near, "FAN", fan)
        got = np.zeros(near.COUNTERS, int)
        for r in near.counted(numbered).collect():
            got[r.block * near.BLOCK : (r.block + 1) * near.BLOCK] = near.widened(r.v, near.BLOCK)
            assert (r.least, r.total) == (near.widened(r.v, near.BLOCK).min(), near.widened(r.v, near.BLOCK).sum())
        assert (got == want).all() and want.max() >= 400
    codes = near.rarity(numbered)
    order = np.argsort(want, kind="stable")
    assert (np.diff(codes[order].astype(int)) >= 0).all() and codes[np.argmax(want)] > codes[np.median(want) == want].max() + 50
    assert not near.rarity(numbered.limit(0)).any()


def test_narrowing_makes_no_row_a_shingle(spark, monkeypatch):
    """A join gave a row for each shingle of each member of long lists; on check_l 1,044,034. Few places lose no link either."""
    plans = []

    def planned(df, name, write=near.written):
        plans.append((name, df._jdf.queryExecution().analyzed().toString()))
        return write(df, name)

    monkeypatch.setattr(near, "written", planned)
    monkeypatch.setattr(near, "LONG", 3)
    monkeypatch.setattr(near, "BLOCKS", 4)
    monkeypatch.setattr(near, "PLACES", 64)
    monkeypatch.setattr(near, "fingerprint_pairs", none)
    texts = corpus()
    assert same(roots_of(spark, texts), brute(texts))
    own = [plan for name, plan in plans if name == "near-elsewhere"]
    assert own and not any("Join" in plan or "explode(s#" in plan for plan in own), own
