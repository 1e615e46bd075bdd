"""Notices that stand word for word must be found whatever stands beside them."""

from quarry.llm.licenses import NOTICES, PHRASES, license_scan


def test_repeats_and_stray_beginnings(spark):
    apache = "licensed under the apache license version 2 0"
    texts = ["all rights reserved " * 3, "all rights reserved " * 50, "all rights all rights reserved", f"licensed under {apache}", apache, "licensed under the new apache license version 2 0", "all rights", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (set(r.labels), r.score) for r in license_scan(docs).collect()}
    for k in (0, 1, 2):
        assert got[k] == ({"all-rights-reserved"}, 1.0)
    assert got[3] == got[4] and "apache-2.0" in got[4][0] and got[4][1] == 1.0
    assert "apache-2.0" in got[5][0]
    assert got[6] == got[7] == (set(), 0.0)


def test_every_notice_gets_its_own_label_and_no_relative(spark):
    """Alone, thrice in a row, and with a word before, between and after."""
    docs, want = [], {}
    for text, label in NOTICES.items():
        base = {v for k, v in PHRASES.items() if f" {k} " in f" {text} "}
        for form in (text, f"{text} " * 3, f"see {text} then {text} end"):
            want[len(docs)] = ({label} | base, base)
            docs.append((len(docs), form.title()))
    got = {r.doc_id: (set(r.labels), set(r.base_labels), r.score) for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (labels, base) in want.items():
        assert got[k] == (labels, base, 1.0), (docs[k][1], got[k])


def test_many_notices_in_one_text(spark):
    long = " ".join(f"{t} w{i}" for i in range(200) for t in NOTICES)
    r = license_scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert set(r.labels) == set(NOTICES.values()) | {v for k, v in PHRASES.items() if any(f" {k} " in f" {t} " for t in NOTICES)}


def test_a_licence_of_a_family_is_never_taken_for_a_relative(spark):
    """Labels besides the base ones; none where a version is unknown."""
    want = {
        "Creative Commons Attribution 4.0 International": {"cc-by-4.0"},
        "a Creative Commons Attribution 3.0 Unported License": {"cc-by-3.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": {"cc-by-nc-4.0"},
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": {"cc-by-nd-4.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": {"cc-by-nc-sa-4.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 License": {"cc-by-nc-nd-3.0"},
        "This work is licensed under a Creative Commons Attribution 5.0 International License": set(),
        "licensed under CC BY-NC-SA 4.0": {"cc-by-nc-sa-4.0"},
        "CC BY 4.0": {"cc-by-4.0"},
        "CC BY-ND 3.0": {"cc-by-nd-3.0"},
        "This work is licensed under the GNU General Public License, version 2": {"gpl-2.0"},
        "This work is licensed under the GNU General Public License, version 3": {"gpl-3.0"},
        "This work is licensed under the GNU General Public License, version 9": set(),
        "GNU Lesser General Public License version 3": {"lgpl-3.0"},
        "GNU Lesser General Public License version 2.1": {"lgpl-2.1"},
        "GNU Affero General Public License version 3": {"agpl-3.0"},
        "Licensed under the Apache License, Version 2.0": {"apache-2.0"},
        "the Apache Software License, version 1.1": {"apache-1.1"},
        "Licensed under the Apache License, Version 3.0": set(),
        "the BSD 2-Clause license": {"bsd-2-clause"},
        "the BSD-3-Clause license": {"bsd-3-clause"},
        "Mozilla Public License, version 1.1": {"mpl-1.1"},
    }
    docs = list(enumerate(want))
    got = {r.doc_id: set(r.labels) - set(r.base_labels) for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in docs} == want


def test_labels_and_scores_equal_plain_voting(spark):
    """On texts whose notices stand apart: single diagonals counted word by word, for all templates."""
    import random
    import re

    from quarry.llm.licenses import GRAM, SHARE, TELLING

    r = random.Random(5)
    fill = lambda: [f"w{r.randint(0, 50)}" for _ in range(40)]
    docs = []
    for i, text in enumerate(NOTICES):
        w = text.split(" ")
        if len(w) > 9 and i % 2:
            w[r.randrange(len(w))] = "other"
        docs.append((i, " ".join(fill() + w + fill())))

    def voted(words, template):
        t = template.split(" ")
        grams = [tuple(t[k : k + GRAM]) for k in range(len(t) - GRAM + 1)]
        best = None
        for at in range(-len(t), len(words)):
            hit = [0 <= at + k and tuple(words[at + k : at + k + GRAM]) == g for k, g in enumerate(grams)]
            if sum(hit) >= SHARE * len(grams) and all(h for h, g in zip(hit, grams) if any(x.isdigit() or x in TELLING for x in g)):
                places = [at + k for k, h in enumerate(hit) if h]
                best = max(best or (0, 0), (sum(hit) / len(grams), sum(hit), places[0], places[-1] + GRAM - 1))
        return best

    want = {}
    for i, text in docs:
        words = re.findall("[a-z0-9]+", text)
        found = {t: v for t in NOTICES if (v := voted(words, t))}
        kept = {t: v for t, v in found.items() if not any(o[:2] > v[:2] and o[2] <= v[3] and v[2] <= o[3] for o in found.values())}
        base = {v for k, v in PHRASES.items() if f" {k} " in f" {text} "}
        want[i] = ({NOTICES[t] for t in kept} | base, round(max([v[0] for v in kept.values()] + [1.0] * bool(base), default=0.0), 9))
    got = {x.doc_id: (set(x.labels), round(x.score, 9)) for x in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
