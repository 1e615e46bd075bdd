import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm.trie import Sweep, prefix_trie, rebuilt, trie


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def sequences(rows):
    """conv_id: rebuilt turns, by the contract's words."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, turn_id(role, text), (role, text)))
    turns = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(seqs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", -1) for r in rows], "conv_id long, turn long, role string, text string, depth string, p int")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(None, 1, "user", "x")]
    for c in range(-40, 200, 3 if seed == 2 else 1):
        for t in range(r.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "bot", None]), r.choice(["a", "b", "", None, "é" * r.randint(0, 3)])))
    rows += rows[:7]  # repeated rows
    assert got(prefix_trie(table(spark, rows))) == brute(sequences(rows))


def test_hot_conversation_crosses_partitions(spark):
    """One conversation, and one first turn, in most rows: their nodes reach over many partitions, their ends over many strings."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 900) for t in range(3)]
    rows += [(c, t, "user", "same 0" if t == 0 else f"own {c}") for c in range(900, 1200) for t in range(2)]
    rows += [(1300, 0, "user", "alone"), (1301, 0, "user", "alone" * 50_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        seqs = sequences(rows)
        assert got(trie(rebuilt(table(spark, rows)), chunk=40)) == brute(seqs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_edges(spark):
    assert prefix_trie(table(spark, []).limit(0)).count() == 0
    turnless = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:3]
    rows = [(c, 0, "user", "gone") for c in turnless]  # no conversation to take turns from, none of their own left
    assert got(prefix_trie(table(spark, rows))) == brute(sequences(rows)) and len(brute(sequences(rows))) == 1
    long_ = [(0, t, "user", f"turn {t}") for t in range(700)]
    assert got(prefix_trie(table(spark, long_))) == brute(sequences(long_))


def test_sweep_holds_only_its_stack():
    """Whatever the rows: open nodes are the last row's path, and the ids held at one of them are a string's worth."""
    sweep = Sweep(0, 200)
    for conv in range(5000):
        sweep.row(conv, [b"a" * 32, bytes([conv // 2500]) * 32], [1, 1])
        assert len(sweep.stack) == 3 and sum(n.held for n in sweep.stack) < 3 * 200
        sweep.taken()
