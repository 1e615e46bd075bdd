import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import EXPANSIONS, sparse_tokens
from quarry.operators import answers, bm25, fusion, vectors


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(sparse_tokens(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert tokens(spark, "MOP") == ["mop", "MOP", "minimum", "occupation", "period"]
    assert tokens(spark, "the Minimum–Occupation-Period") == ["the", "minimum", "occupation", "period", "mop"]
    assert tokens(spark, "Étion 4A 2 HFE") == ["tion", "4a", "4A", "2", "hfe", "HFE", "hdb", "flat", "eligibility"]
    assert tokens(spark, "") == [] and len(EXPANSIONS) == 11


def test_bm25_against_brute_force(spark):
    docs = [(1, "the minimum occupation period applies"), (2, "grants and loans"), (3, "the MOP is five years the"), (4, ""), (5, "the the the")]
    queries = [(10, "MOP the"), (11, "nothing known"), (12, "loans loans")]
    got = bm25.top_k(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    bags = {k: tokens(spark, t) for k, t in docs}
    avg, n = sum(map(len, bags.values())) / 5, 5
    df = Counter(t for b in bags.values() for t in set(b))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    want = []
    for q, text in queries:
        scored = sorted((-sum(idf.get(t, 0) * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for t in tokens(spark, text)), k) for k, b in bags.items())
        want += [(q, i + 1, k, round(-s, 9)) for i, (s, k) in enumerate(scored[:3])]
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in got) == want


def test_nearest(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for metric, sign in (("cosine", -1), ("l2", 1)):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in vectors.nearest(df, df.where("vec_id in (0, 7)"), 4, metric).collect())
        want = []
        for q in (0, 7):
            a = rows[q][1]

            def score(b):
                return math.dist(a, b) if metric == "l2" else sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)

            ranked = sorted((sign * round(score(b), 9), i) for i, b in rows[:40] if i != q)
            want += [(q, n + 1, i) for n, (_, i) in enumerate(ranked[:4])]
        assert got == want
    with pytest.raises(ValueError):
        vectors.nearest(df, df, metric="dot")


def test_nearest_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 2.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (9, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.nearest(df, df, 5).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 3, -1.0), (2, 1, 1, 0.0), (2, 2, 3, 0.0), (3, 1, 2, 0.0), (3, 2, 1, -1.0), (4, 1, 5, 0.0), (5, 1, 4, 0.0)]
    named = df.select(F.concat(F.lit("k"), "vec_id").alias("vec_id"), "embedding")
    assert [(r.query_id, r.vec_id) for r in vectors.nearest(named, df.where("vec_id = 4"), 5, "l2").orderBy("rank").collect()] == [(4, "k4"), (4, "k5")]
    assert vectors.nearest(df, df.limit(0)).count() == vectors.nearest(df.limit(0), df).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    """More queries than go with the code: the same rows, ties included."""
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = sorted(map(tuple, vectors.nearest(df, df.where("vec_id < 30"), 4).collect()))
    monkeypatch.setattr(vectors, "CHUNK", 7)
    monkeypatch.setattr(vectors, "ROWS", 16)
    assert sorted(map(tuple, vectors.nearest(df, df.where("vec_id < 30"), 4).collect())) == one and len(one) == 120


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_list_index(spark, tmp_path, metric):
    """Every row is in a list; recall against brute force, scores exact, and with all lists probed the exact answer."""
    from quarry.operators.vectors import ListIndex

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(10_000, [1.0, 2.0]), (10_001, [1.0, 2.5]), (10_002, None)], "vec_id long, embedding array<float>")
    both = df.unionByName(odd)
    ListIndex(spark, f"file://{tmp_path}/lists").build(both, metric)
    index = ListIndex(spark, f"file://{tmp_path}/lists")
    assert index.rows().count() == both.where("embedding is not null").count() and len(index.means) == round(math.sqrt(df.count()))
    asked = both.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.vec_id): round(r.score, 9) for r in vectors.nearest(both, asked, 10, metric).collect()}
    found = {(r.query_id, r.vec_id): round(r.score, 9) for r in index.search(asked, 10).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact) and all(exact[p] == found[p] for p in exact.keys() & found.keys())
    assert {(r.query_id, r.vec_id) for r in index.search(asked, 10, probes=len(index.means)).collect()} == exact.keys()
    one = index.search(df.where("vec_id = 50"), 3, probes=1)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan.split("PartitionFilters: [")[-1].split("]")[0]


def test_fusion(spark):
    make = lambda keys: spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(keys)], "query_id long, doc_id string, rank int")
    got = fusion.fuse([(make(["a", "b"]), 0.4), (make(["b", "c"]), 0.6)]).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["b", "c", "a"]
    assert math.isclose(got[0].score, 0.4 / 62 + 0.6 / 61)
    tie = fusion.fuse([(make(["x"]), 0.5), (make(["y"]), 0.5)]).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == ["x", "y"]
    hits = spark.createDataFrame([(1, 1, 1, "b"), (1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 2, "c"), (2, 0, 1, "b")], "query_id long, ordinal int, rank int, doc_id string")
    assert [(r.query_id, r["rank"], r.doc_id) for r in fusion.union_of_queries(hits).orderBy("query_id", "rank").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "b")]


def test_ranking_repair(spark):
    cases = [([2, 2, 99, -1, 0], 3, [2, 0, 1]), ([], 2, [0, 1]), (None, 2, [0, 1]), ([0], 0, []), ([1, None], 1, [0])]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, ids array<int>, n int")
    assert [list(r.x) for r in df.select("i", fusion.repaired(F.col("ids"), F.col("n")).alias("x")).orderBy("i").collect()] == [c[2] for c in cases]
    docs = spark.createDataFrame([(["A", "B", "C"], [2, 2, 99, -1, 0])], "d array<string>, ids array<int>")
    assert docs.select(fusion.reranked(F.col("d"), F.col("ids"), 2).alias("x")).first().x == ["C", "A"]


def test_context_and_citations(spark):
    rows = [(1, 1, "T", "u1", "body", "c", "html"), (1, 2, None, "u2", "more", "c", "html"), (1, 3, "T3", "u1", "again", "c", "html"), (1, 4, "T4", "", "x", "c", "html")]
    df = spark.createDataFrame(rows, "query_id long, rank int, title string, source_url string, page_content string, category string, doc_type string")
    assert answers.context_text(df.where("rank < 3")).first().context == "[1] T (u1)\nbody\n\n---\n\n[2]  (u2)\nmore"
    assert [(r["rank"], r.url, r.title) for r in answers.cited_sources(df).orderBy("rank").collect()] == [(1, "u1", "T"), (2, "u2", "u2")]
    doc = F.array(F.struct(F.lit("").alias("title"), F.lit(None).cast("string").alias("section_title"), F.lit("u").alias("source_url"), F.lit("x").alias("page_content")))
    assert spark.range(1).select(answers.rerank_prompt(doc).alias("p")).first().p == "Document ID: 0\nTitle: Untitled\nSection: Untitled\nURL: u\nContent:\n```x```\n\nDocuments = [Document ID: 0, ..., Document ID: 0]"


def test_history(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c")], "conv_id long, turn int, role string, text string")
    got = answers.chat_history(turns).orderBy("turn").collect()
    assert [(r.question, [m.content for m in r.history]) for r in got] == [("a", []), ("c", ["a", "b"])]


def test_trace(spark):
    hits = spark.createDataFrame([(1, 0, "q0", 2, 5), (1, 0, "q0", 1, 4), (1, 1, "q1", 1, 4)], "query_id long, ordinal int, query string, rank int, k long").withColumn("doc", F.struct("k"))
    r = fusion.diagnostics(hits, hits.where("ordinal = 1").select("query_id", "rank", "doc")).first()
    assert list(r.generated_queries) == ["q0", "q1"] and [x["rank"] for x in r.retrieved_by_query[0].results] == [1, 2] and r.final_reranked[0].doc.k == 4


def test_tokens_of_a_batch_are_those_of_each_text(spark):
    """Texts are cut together: no token, phrase or acronym may reach over the end of a text, and plain Python agrees."""
    import random
    import re

    r = random.Random(5)
    parts = ["build", "to", "order", "hdb", "HDB", "Mop", "CPF", "A", "A1", "1A", "12", "flat", "eligibility", "café", "你好", "x‑y", "sale of balance flats", "executive", "condominium", "İec"]
    texts = [None, "", " ", "build", "to order", "hdb", *("".join(r.choice(parts) + r.choice([" ", " ", "-", "", "\n", "—"]) for _ in range(r.randint(0, 12))) for _ in range(1500))]

    def plain(t):
        raw = re.findall("[A-Za-z0-9]+", t or "")
        out = [y for x in raw for y in (x.lower(), *([x] if len(x) > 1 and x == x.upper() and re.search("[A-Z]", x) else []), *EXPANSIONS.get(x.lower(), ()))]
        return out + [a for a, p in EXPANSIONS.items() if f" {' '.join(p)} " in f" {' '.join(raw).lower()} "]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = dict(rows.select("i", sparse_tokens(F.coalesce("t", F.lit(""))).alias("x")).collect())
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_tokens_are_cut_in_one_pass(spark):
    """Array functions of the plan looked at every text once for each phrase and token."""
    plan = spark.range(1).select(sparse_tokens(F.lit("a b"))).select("*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 0


def test_groups_of_queries_are_bounded(spark, monkeypatch):
    """A block of rows met all queries at one time, so a task's memory grew with their number."""
    import numpy as np

    monkeypatch.setattr(vectors, "CHUNK", 8)
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    whole = sorted(vectors.nearest(rows, rows, 3).collect())
    monkeypatch.setattr(vectors, "CHUNK", 2048)
    assert [(a.query_id, a["rank"], a.vec_id) for a in whole] == [(a.query_id, a["rank"], a.vec_id) for a in sorted(vectors.nearest(rows, rows, 3).collect())]
    monkeypatch.setattr(vectors, "CHUNK", 8)
    asked = vectors.usable(rows, "vec_id", "embedding")
    dealt, sent = vectors._tiles(asked, asked, 120)
    assert max(x["count"] for x in sent.groupBy("tile").count().collect()) <= 24 and dealt.count() == 15 * 120


def test_queries_of_many_lists_are_not_repeated_in_python(spark):
    """A batch of queries was copied once for each list probed before it left the task's Python."""
    import numpy as np

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [1.0])], "id long, v array<double>")
    found = vectors.ListIndex._assigned(rows, np.array([[0.0, 1.0], [3.0, 1.0], [6.0, 1.0]]), 2, "l2", 3)
    assert sorted((x.id, x["list"]) for x in found.collect()) == [(i, c) for i in range(6) for c in range(3)] + [(9, -1)]
    assert "MapInArrow" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and plan.index("Generate explode") < plan.index("MapInArrow")
