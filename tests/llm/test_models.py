"""The trained operators: brute force where there is one, accuracy on rows kept out elsewhere."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import lm
from quarry.llm.bytewords import split, word_ids
from quarry.llm.common import crc_mod
from quarry.llm import quality as Q
from quarry.llm.quality import fit as fit_quality
from quarry.llm.quality import quality, shape
from quarry.llm.toxicity import Model, segments
from quarry.llm.toxicity import fit as fit_toxicity
from quarry.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_segments_against_brute_force():
    """Maximal segments: best segment first, then the same to its left and right."""

    def brute(scores, lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                    best = (total, a, b)
        if best is None:
            return []
        return brute(scores, lo, best[1]) + [(best[1], best[2] + 1, best[0])] + brute(scores, best[2] + 1, hi)

    r = np.random.default_rng(6)
    for _ in range(60):
        scores = np.where(r.random(40) < 0.3, np.round(r.random(40) * 3, 3) + 0.001, -np.round(r.random(40), 3) - 0.0007)
        got = segments(scores.tolist())
        want = brute(scores.tolist(), 0, 40)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_take_linear_time():
    import time

    def seconds(n):
        some = [x for _ in range(n) for x in (1.0, -1.5)]
        began = time.perf_counter()
        for _ in range(5):
            segments(some)
        return time.perf_counter() - began

    assert min(seconds(16_000) / seconds(8_000) for _ in range(5)) <= 2.6
    assert segments([1.0, -1.5] * 3) == [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0)]


def test_toxicity_scores_against_a_slow_version():
    model = Model({"bad": 2.0, "wors~": 1.0}, {"calm": -0.7}, loss=0.1, rate=0.9, scale=0.02, curve=(2.0, -3.0))
    for text in ("", "calm " * 9, "a Bad, WORSE calm bad b", "bad " * 60, "a " * 500 + "bad bad" + " a" * 500):
        words = text.split()
        scores = [2.0 if w.lower().strip(",") == "bad" else 1.0 if w.lower().startswith("wor") else -0.7 if w == "calm" else -0.1 for w in words]
        total = sum(-math.log(0.02 * len(words) * math.exp(-0.9 * s)) for *_, s in segments(scores) if 0.02 * len(words) * math.exp(-0.9 * s) < 0.05)
        assert math.isclose(model.probability(model.evidence(text)[0]), 1 / (1 + math.exp(-(2.0 * math.log1p(total) - 3.0))), rel_tol=1e-9)


def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    clean = [(10_000 + i, "the good and calm text of day number " + " ".join(chr(97 + (i * k) % 26) * 3 for k in range(1, 30))) for i in range(300)]
    toxic = [(20_000 + i, clean[i][1] + (" you utter moronface and worthless scumbag " * (1 + i % 3))) for i in range(120)]
    extra = [(30_000, None), (30_001, ""), (30_001, ""), (None, "null key"), (30_002, "calm word " * 20000)]
    both = docs.unionByName(spark.createDataFrame(clean + toxic + extra, "doc_id long, text string")).withColumn("score", F.lit(0.5)).withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in clean] + [(k, 1, 1) for k, _ in toxic] + [(10_000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return both, labels


def test_toxicity(spark):
    docs, labels = corpus(spark)
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = fit_toxicity(docs, labels, ~held)
    got = toxicity(docs, model, passages=True).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept_out = [r for r in got if r.doc_id and 10_000 <= r.doc_id < 30_000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.score >= 0.5) == (r.doc_id >= 20_000) for r in kept_out) and len(kept_out) > 40
    assert all(r.n_passages == len(r.passages) >= 1 for r in kept_out if r.doc_id >= 20_000)
    assert all(r.score < 0.5 for r in got if r.doc_id is None or r.doc_id >= 30_000)
    kept = toxicity(docs, model, keep=lambda p: p < 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    none = fit_toxicity(docs, labels.where("toxic = 0"), ~held)
    assert isinstance(none, Model) and toxicity(docs.limit(3), none).where("score >= 0.5").count() == 0
    assert toxicity(docs.limit(0), model).count() == 0


def test_quality(spark):
    docs, _ = corpus(spark)
    junk = [(40_000 + i, " ".join(f"BUY{chr(65 + (i * k) % 26)}!!" for k in range(1, 40)) if i % 2 else "again " * 60) for i in range(150)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(junk, "doc_id long, text string")).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(10_000 + i, 1) for i in range(300)] + [(k, 0) for k, _ in junk] + [(None, 1), (40_000, 0), (40_001, None)], "doc_id long, quality int")
    docs = docs.unionByName(docs.where("doc_id in (10000, 40000)"))
    held = crc_mod(F.col("doc_id"), 4) == 2
    vectors, network = fit_quality(docs, labels, ~held)
    got = quality(docs, vectors, network).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept_out = [r for r in got if r.doc_id and (10_000 <= r.doc_id < 10_300 or r.doc_id >= 40_000) and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == (r.doc_id < 40_000) for r in kept_out]) > 0.97
    kept = quality(docs, vectors, network, keep=lambda p: p >= 0.7)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.7 for r in got)
    flat = fit_quality(docs, labels.where("quality = 1"), ~held)
    assert quality(docs.limit(3), *flat).where("score < 0.9").count() == 0
    assert quality(docs.limit(0), vectors, network).count() == 0
    tally = Q.tallied(docs, bags=True)  # the same from stored bags
    assert (Q.word_vectors(docs, tally) == vectors).all()
    ordered = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rows)
    again = ordered(quality(docs, vectors, network, tally=tally).collect())
    assert [r[:2] for r in again] == [r[:2] for r in ordered(got)] and np.allclose(again, ordered(got), rtol=1e-9, atol=0)
    empty = Q.tallied(docs.limit(0), bags=True)
    assert not Q.word_vectors(docs.limit(0), empty).any() and quality(docs, vectors, network, tally=empty).count() == 0


def test_shapes():
    assert [shape(w) for w in ("The", "THE!!", "the%%%", "|", "a1,", "Él", "WORD", "aB", "x.")] == ["Aa", "A!", "a%", "|", "a9,", "a", "A", "aA", "a."]
    blob = "aB3-" * 500
    assert shape(blob) == shape("aB3-" * 511) != shape(blob[:-1] + "%") and shape(blob[:64]) != shape(blob)


def test_word_vectors_and_pooling_against_brute_force(spark, monkeypatch):
    texts = ["The the cat, sat", "", "cat CAT cat", "one", "  sat on\tthe mat! " * 3, "the cat, sat"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    vectors = Q.word_vectors(docs.repartition(1))
    many = docs.orderBy(F.desc("doc_id")).repartition(5)
    assert (vectors == Q.word_vectors(many)).all()  # exact, whatever the order
    monkeypatch.setattr(Q, "FAN", 2)
    assert (vectors == Q.word_vectors(many)).all()  # and however many sums meet at a time
    bucket = lambda w: zlib.crc32(Q.form(w).encode()) % Q.BUCKETS
    look = lambda w: Q.BUCKETS + zlib.crc32(b"\x00" + shape(w).encode()) % Q.SHAPES
    index = lambda w: Q.index_vectors([Q.form(w).encode()])[0].astype(int)
    seen = lambda w: Q.index_vectors([b"\x00" + shape(w).encode()])[0].astype(int)
    again = Q.index_vectors([b"\x00same"])[0].astype(int)
    sums = {}
    for t in texts:
        w = t.split()
        same = [i > 0 and (bucket(w[i]), shape(w[i])) == (bucket(w[i - 1]), shape(w[i - 1])) for i in range(len(w))]
        own = [index(x) + seen(x) + (again if s else 0) for x, s in zip(w, same)]
        for i, x in enumerate(w):
            around = sum((own[j] for j in range(max(0, i - Q.WINDOW), min(len(w), i + Q.WINDOW + 1)) if j != i), np.zeros(Q.DIM, int))
            for unit in [bucket(x), look(x)] + [Q.SAME] * same[i]:
                sums[unit] = sums.get(unit, 0) + around
    for unit in range(Q.UNITS):
        if unit in sums and np.abs(sums[unit]).sum():
            assert np.allclose(vectors[unit], sums[unit] / np.linalg.norm(sums[unit]), atol=1e-6)
    got = Q.pooled(texts, vectors, Q.Units())
    for t, x in zip(texts, got):
        w, scale = t.split(), 1 / np.sqrt(Q.NONZERO)
        same = [i > 0 and (bucket(w[i]), shape(w[i])) == (bucket(w[i - 1]), shape(w[i - 1])) for i in range(len(w))]
        left = sum((vectors[bucket(y)] + index(y) * scale for y in w), np.zeros(Q.DIM)) / max(1, len(w))
        right = sum((vectors[look(y)] + seen(y) * scale + (3 * (vectors[Q.SAME] + again * scale) if s else 0) for y, s in zip(w, same)), np.zeros(Q.DIM)) / max(1, len(w))
        assert np.allclose(x, np.concatenate([left, right]), atol=1e-5)


def test_network_against_a_slow_version():
    r = np.random.default_rng(4)
    net = Q.Network(r.normal(size=3), r.random(3) + 1, r.normal(size=(3, 2)), r.normal(size=2), r.normal(size=2), 0.3, 1.7)
    x = r.normal(size=(5, 3))
    for row, p in zip(x, net.probability(x)):
        hidden = [math.tanh(sum((row[i] - net.mean[i]) / net.spread[i] * net.w1[i, k] for i in range(3)) + net.b1[k]) for k in range(2)]
        assert math.isclose(p, 1 / (1 + math.exp(-(hidden[0] * net.w2[0] + hidden[1] * net.w2[1] + 0.3) / 1.7)), rel_tol=1e-9)


def test_language_model(spark):
    docs, _ = corpus(spark)
    held = crc_mod(F.col("doc_id"), 7) == 2
    got = lm.score(docs, ~held).collect()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            counts.update(split(r.text) + ["end"])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for r in rows:
        tokens = split(r.text) + ["end"]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want.setdefault((r.doc_id, len(tokens)), (sum(counts[t] > 0 for t in tokens), base))
    for r in got:
        known, base = want[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens) == (known, n) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm.score(docs.limit(0), ~held).count() == 0
    untaught = lm.score(docs.limit(2), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untaught)


def test_language_model_is_normalised_and_learns():
    g = np.random.default_rng(8)
    ids = np.where(np.arange(12000) % 2 == 0, g.integers(2, 90, 12000), 1).astype(np.int32)
    model = lm.LogBilinear(np.bincount(ids, minlength=90) + 1.0, 5)
    own = np.ones(len(ids) - lm.CONTEXT, np.float32)
    model.begin()
    before = model.log_probabilities(ids).mean()
    for i in range(0, len(own), 512):
        model.learn(ids[i : i + 512 + lm.CONTEXT], own[i : i + 512], g)
    assert model.log_probabilities(ids).mean() > before + 0.3
    some = ids[:40]
    assert abs(sum(np.exp(model.log_probabilities(np.r_[some, w].astype(np.int32))[-1]) for w in range(125)) - 1) < 1e-4
    # a slow version, leaf by leaf
    for at in range(lm.CONTEXT, 40):
        h = sum(model.c[j].astype(float) * model.r[some[at - 1 - j]] for j in range(lm.CONTEXT))
        h[-1], want = 1, 0.0
        for level in (0, 1, 2):
            child = some[at] // 5 ** (2 - level)
            scores = model.q[level][child // 5 * 5 : child // 5 * 5 + 5].astype(float) @ h
            want += scores[child % 5] - np.log(np.exp(scores).sum())
        assert abs(model.log_probabilities(some)[at - lm.CONTEXT] - want) < 1e-4


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 20_000)
    monkeypatch.setattr(lm, "HEAD", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in lm.score(docs.repartition(n), crc_mod(F.col("doc_id"), 7) != 2).collect()} for n in (1, 8))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) <= 1e-6 * max(1, abs(one[k])) for k in one)


def test_vocabulary_is_proper(spark, monkeypatch):
    """Head words by whole bands, then by hash; every word's place adds up to one, the unseen one of each shared leaf included."""
    monkeypatch.setattr(lm, "HEAD", 100)
    counts = spark.createDataFrame([(f"w{i}", 1 + 50 // (i + 1)) for i in range(600)], "word string, c long")
    v = lm.vocabulary(counts, 10)
    assert 40 <= len(v.words) <= 100 and v.tails == lm.TAILS and (v.total, v.different) == (10 + sum(1 + 50 // (i + 1) for i in range(600)), 601)
    inside = sum(10 ** v.logs[k] for k in v.words.values()) + 11
    shared = sum(2 + 50 // (i + 1) for i in range(600) if f"w{i}".encode() not in v.words) + lm.TAILS
    assert math.isclose(inside + shared, v.weight.sum(), rel_tol=1e-9) and min(1 + 50 // (int(w[1:]) + 1) for w in v.words) >= 1


def test_word_ids(monkeypatch):
    import random

    import pyarrow as pa

    from quarry.llm import bytewords

    r = random.Random(1)
    texts = ["", "  ", " a", "b ", "A\x00b a\x00", "a\x85b\xa0c É\x1cx"] + ["".join(r.choice("aAb \t\n\x0b\x1c é") for _ in range(r.randrange(9))) for _ in range(2000)]
    for piece in (bytewords.PIECE, 50):
        monkeypatch.setattr(bytewords, "PIECE", piece)
        bytewords.tables.cache_clear()
        got = []
        for sizes, ids, words in word_ids(pa.array(["first", *texts]).slice(1)):
            at = 0
            for n in sizes.tolist():
                got.append([words[i] for i in ids[at : at + n].tolist()])
                at += n
        assert got == [split(t) for t in texts]
    bytewords.tables.cache_clear()


def test_summed():
    r = np.random.default_rng(0)
    for _ in range(100):
        n = int(r.integers(1, 200))
        edge = np.unique(np.r_[0, r.integers(0, n, r.integers(0, 60))])
        x = r.normal(size=(n, 3)).astype(np.float32)
        assert np.allclose(lm.summed(x, edge, np.diff(np.r_[edge, n])), np.add.reduceat(x, edge, axis=0), atol=1e-4)


def test_words_are_split_in_pieces_that_a_cache_holds(spark, monkeypatch):
    """Pieces of 4 MB were split at once, 32 MB an array; the counts must not depend on the pieces."""
    asked = []

    def noted(texts, fold=True, most=None):
        asked.append(most)
        return word_ids(texts, fold, most)

    monkeypatch.setattr(lm, "word_ids", noted)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([f"w{k % 7} W{k % 3}, x" for k in range(400)])], names=["text"])

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.rows = [(r["word"], r["c"]) for b in run(iter([batch])) for r in b.to_pylist()]
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self.rows

    want = dict(Counter(w for t in batch.column(0).to_pylist() for w in t.lower().split()))
    assert dict(lm.count_words(Docs())) == want and max(asked) <= 1 << 20
    monkeypatch.setattr(lm, "CACHED", 64)
    assert dict(lm.count_words(Docs())) == want
