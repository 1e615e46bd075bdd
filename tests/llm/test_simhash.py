import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.components import connected
from quarry.llm.simhash import fingerprint, fingerprints, hex_of, keep_one, links, list_links, simhash_components


def brute(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB ÄÉ\n\t\x1c .x", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == brute(text)


def test_long_text_in_blocks(monkeypatch):
    import quarry.llm.simhash as m

    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = fingerprint(text)
    monkeypatch.setattr(m, "BLOCK", 7)
    assert fingerprint(text) == whole == (brute(text) + 2**63) % 2**64 - 2**63


def components_of(fps, bits=2):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= bits:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_lists_of_any_size():
    r = np.random.default_rng(1)
    for n in (2, 30, 64, 65, 400):
        rest = r.choice(1 << 12, n, replace=False).astype(np.int64)
        assert same(list_links(rest, 2).tolist(), components_of(rest.tolist()))


def test_links_and_components(spark):
    r = np.random.default_rng(2)
    fps = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 60)]
    for _ in range(140):  # chains and bunches around some of them
        x = fps[int(r.integers(len(fps)))]
        for b in r.choice(64, int(r.integers(1, 4)), replace=False):
            x ^= 1 << int(b)
        fps.append((x + 2**63) % 2**64 - 2**63)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    root = {r.node: r.root for r in connected(links(df)).collect()}
    assert same([root.get(x, x) for x in fps], components_of(fps))


def test_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in connected(e).collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_frames(spark):
    rows = [(5, "The quick brown fox jumps over it", 1), (3, "the QUICK brown fox jumps over it", 2), (9, None, 3), (8, "", 4), (9, None, 3), (None, " \n", 5), (1, "one", 6), (2, "w " * 30000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = simhash_components(docs).collect()
    assert sorted((r.doc_id or -1, r.fp % 2**64, r.component_id) for r in got) == sorted((k or -1, brute(t), {5: 3, 3: 3, 1: 1, 2: 2}.get(k, 8)) for k, t, _ in rows)
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 2, 3, 8]
    assert keep_one(docs).columns == docs.columns
    assert simhash_components(docs.limit(0)).count() == 0
    assert fingerprints(docs).select(hex_of("fp").alias("h")).where("length(h) <> 16").count() == 0
