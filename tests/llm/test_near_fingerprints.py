"""The SimHash step of near-dedup: which fingerprints meet, and that the stage joins by them."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import near

SF = "/root/testdata/sf0.001"


def test_fingerprints_within_five_bits_meet(spark):
    g = np.random.default_rng(6)
    fps = []
    for k in range(120):  # twins that differ by 0 to 5 bits, then some by 13
        x = int(g.integers(-(2**63), 2**63 - 1))
        y = x
        for b in g.choice(64, k % 6 if k < 90 else 13, replace=False):
            y ^= 1 << int(b)
        fps += [x, (y + 2**63) % 2**64 - 2**63]
    reps = spark.createDataFrame([(i, 9, x) for i, x in enumerate(fps)], "node long, n int, fp long")
    got = {(r.a, r.b) for r in near.fingerprint_pairs(reps).collect()}
    assert got >= {(2 * k, 2 * k + 1) for k in range(90)}
    assert all(((fps[a] ^ fps[b]) % 2**64).bit_count() <= near.APART for a, b in got)


def test_stage_joins_by_fingerprints(spark, monkeypatch):
    """With nothing from the lists of shingles, texts with a changed word are still one group; texts of no common shingle are not."""
    g = np.random.default_rng(7)
    base = [f"w{x}" for x in g.integers(0, 1000, 300)]
    copies = [" ".join(base[:at] + [f"new{at}"] + base[at + 1 :]) for at in (40, 150, 260)]
    rows = [(7, " ".join(base)), *((10 + k, t) for k, t in enumerate(copies)), (20, " ".join(f"v{x}" for x in g.integers(0, 1000, 300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "candidates", lambda lists, *_: lists.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [7, 20]
