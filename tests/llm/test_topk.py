import math

import numpy as np

from quarry.llm import sharding
from quarry.llm.sharding import Ring, assign
from quarry.llm.topk import Block, top_k


def brute(rows, asked, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qid, q in {i: v for i, v in sorted(fine, key=lambda x: x[1], reverse=True) if asked(i)}.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in fine if i != qid and len(v) == len(q))
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 480)]  # ties
    rows += [(7, rows[7][1]), (500, None), (501, [None] + [0.1] * 7), (502, [math.inf] * 8), (503, [math.nan] * 8), (600, []), (700, [0.1, 0.2]), (701, [0.3, 0.4]), (None, [0.1] * 8), (800, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, score long")
    ask = lambda i: i is not None and i % 100 == 0
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in top_k(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], ask)
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_stops_only_on_proof():
    r = np.random.default_rng(5)
    for scale in (1, 1000, 2**40):
        x = np.floor(r.standard_t(2, (3000, 16)) * scale)
        q = np.floor(r.standard_t(2, (20, 16)) * 50)
        for at, ids, scores in Block(np.arange(3000), x).search(q, np.full(20, -1), np.full(20, -np.inf), 10):
            all_ = sorted(((-sum(int(a) * int(b) for a, b in zip(v, q[at])), i) for i, v in enumerate(x)))[:10]
            assert sorted(zip((-scores).tolist(), ids.tolist()))[:10] == all_


def test_ring_is_even_and_moves_little():
    counts = {p: 1 + p % 7 for p in range(0, 1 << 16, 11)}
    runs8 = Ring(8).lay_out(counts)
    total = sum(counts.values())
    held = [sum(b - a for _, a, b, s, _ in runs8 if s == k) for k in range(8)]
    assert sum(held) == total and max(held) - min(held) <= 1
    owner = lambda runs: {(p, i): s for p, a, b, s, _ in runs for i in range(a, b)}
    a, b = owner(runs8), owner(Ring(9).lay_out(counts))
    assert sum(a[x] != b[x] for x in a) < 0.5 * total


def test_shards(spark, monkeypatch):
    import zlib

    rows = [(i, f"text {i % 5}") for i in range(1003)] + [(7, "copy")] * 300 + [(None, None)] * 5 + [(2000, ""), (2001, "é" * 50000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, shard string")
    for part in (50_000, 40):  # ranks counted in one part, or in several
        monkeypatch.setattr(sharding, "PART_ROWS", part)
        got = assign(docs, 8).collect()
        assert len(got) == len(rows)
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((k or (-1 if k is None else 0) or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
        held = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
        assert max(map(len, held)) - min(map(len, held)) <= 1
        assert all(h == list(range(len(h))) for h in held)
    assert assign(docs.limit(0), 8).count() == 0
    assert sorted(r.slot for r in assign(docs.limit(3), 8).collect()) == [0, 0, 0]
