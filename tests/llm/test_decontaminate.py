import hashlib
import re

from quarry.llm import grams
from quarry.llm.decontaminate import contamination, drop_contaminated
from quarry.llm.licenses import license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for win, who in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= who
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "Élan vital É"), (10, "one"), (3, None), (4, ""), (5, "a a a a a a a a a a a a"), (1, LONG), (None, "null item here"), (6, " ".join(f"w{i}" for i in range(5, 19)))]
DOCS = [
    (1, f"start {LONG.upper()} end"), (2, None), (3, ""), (4, "élan VITAL é"), (5, "Élan, vital; É!"), (6, "one two ONE"), (7, " ".join(f"w{i}" for i in range(9))),
    (8, " ".join(f"w{i}" for i in range(3, 14)) + " x " + " ".join(f"w{i}" for i in range(11, 25))), (9, "a " * 40), (9, "a " * 40), (None, "so one"), (11, "q " * 30000 + LONG), (12, "w1 w2 w3 " * 10),
]


def test_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size, sent in ((20_000, 0), (3, 4_000_000), (3, 0)):  # looked up in a set, joined where texts are read, or shuffled
        monkeypatch.setattr(grams, "SET_SIZE", size)
        monkeypatch.setattr(grams, "BROADCAST_KEYS", sent)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(docs, items).collect()), key=str)
        assert got == brute(DOCS, ITEMS)
    kept = sorted((r.doc_id for r in drop_contaminated(docs, items).collect()), key=str)
    assert kept == sorted((k for k, _, hit, _ in brute(DOCS, ITEMS) if not hit), key=str)
    one_key = spark.createDataFrame([(5, DOCS[0][1], 0), (5, "clean", 1), (None, DOCS[0][1], 2), (None, "clean too", 3), (6, None, 4)], "doc_id long, text string, _row long")
    hits = [not hit for _, _, hit, _ in brute([(i, t) for i, (_, t, _) in enumerate([(r.doc_id, r.text, 0) for r in one_key.collect()])], ITEMS)]
    assert sorted(r._row for r in drop_contaminated(one_key, items).collect()) == [i for i, clean in enumerate(hits) if clean]
    assert contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert contamination(docs.limit(0), items).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licences(spark):
    rows = [
        (1, "Released under the MIT License. And the mit, license again: mit mit license"), (2, None), (3, ""), (3, ""), (4, "GNU General Public License gnu general public"), (5, "gnu general license public apache\nlicense CC-BY cc by"),
        (6, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files (the Software)"), (7, "License mit. cc. by the way " * 4000), (None, "ALL RIGHTS RESERVED"), (9, "MİT license"),
    ]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in rows], "doc_id long, text string, score double")
    got = sorted(license_scan(docs).collect(), key=lambda r: (str(r.doc_id), r.n_words))
    assert len(got) == len(rows)
    for r, (key, text) in zip(got, sorted(rows, key=lambda x: (str(x[0]), len(words(x[1]))))):
        w, at, labels = words(text), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels)) == (key, len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels))
        assert labels <= set(r.labels) and (r.score == 1 if at else 0 <= r.score <= 1)
    by = {r.doc_id: r for r in got}
    assert list(by[6].labels) == ["mit"] and by[6].n_base == 0 and 0.8 <= by[6].score < 1
    assert list(by[None].labels) == ["all-rights-reserved"]
    assert license_scan(docs.limit(0)).count() == 0
