"""The stored index against scoring from scratch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.operators.index import Bm25Index, index_of, part, scored

WORDS = ["the", "of", "and", "river", "stone", "lamp", "MOP", "grant", "loan", "cedar", "quartz", "violin", "umbra", "zephyr"]


def text(r):
    return " ".join(r.choices(WORDS, [20, 15, 12, 5, 4, 3, 2, 2, 2, 1, 1, 1, 0.3, 0.2], k=r.randint(0, 30)))


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def best(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "the zephyr"), (2, "cedar quartz quartz MOP"), (3, "nothing known"), (4, "the of and"), (5, None), (6, "umbra violin loan grant the")], "query_id long, text string")


def same(spark, index, docs, queries):
    whole = frame(spark, docs)
    assert index.n == len(docs)
    assert best(index.search(queries, 4)) == best(bm25.top_k(whole, queries, 4))
    a, b = ({(r.query_id, r.doc_id): round(r.score, 9) for r in x.collect()} for x in (index.scores(queries), bm25.scores(whole, queries)))
    assert a == b
    own = bm25.tokenised(whole)
    for mine, theirs in ((index.postings(), bm25.postings(own)), (index.terms(), bm25.document_frequency(own)), (index.lengths(), own.select("doc_id", F.size("tokens").alias("dl")))):
        assert sorted(map(str, mine.select(*theirs.columns).collect())) == sorted(map(str, theirs.collect()))


def test_equals_a_rebuild_after_changes(spark, tmp_path, queries):
    r = random.Random(3)
    docs = {i: text(r) for i in range(280)}
    index = Bm25Index(spark, f"file://{tmp_path}/index", buckets=4)
    index.write(frame(spark, docs))
    for n in (40, 1):  # replaced and new ones, then some taken away
        some = {r.randint(0, 400): text(r) for _ in range(n)}
        index.write(frame(spark, some))
        docs |= some
        gone = [*r.sample(sorted(docs), 30), 9999]
        index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id int"))
        docs = {k: v for k, v in docs.items() if k not in gone}
    index.write(frame(spark, {gone[0]: "the zephyr came back"}))
    docs[gone[0]] = "the zephyr came back"
    same(spark, index, docs, queries)
    reader = Bm25Index(spark, f"file://{tmp_path}/index")
    index.compact()
    assert len(index.now["segments"]) == 1 and best(reader.search(queries, 4)) == best(index.search(queries, 4))  # an old version stays readable
    index.clean()
    same(spark, Bm25Index(spark, f"file://{tmp_path}/index"), docs, queries)


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    r = random.Random(4)
    index = Bm25Index(spark, f"file://{tmp_path}/index", buckets=8)
    index.write(frame(spark, {i: text(r) for i in range(100)}))
    _, buckets = index._asked(spark.createDataFrame([(1, "zephyr")], "query_id long, text string"))
    assert len(buckets) == 1
    files = index._blocks(buckets).select("term").inputFiles()
    plan = index._blocks(buckets)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert files and len({f.split("bucket=")[1].split("/")[0] for f in index._blocks().inputFiles()}) > 1


def test_keys(spark, tmp_path, queries):
    index = Bm25Index(spark, f"file://{tmp_path}/index")
    assert index.search(queries, 3).count() == 0 and index.scores(queries).count() == 0
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            index.write(spark.createDataFrame(rows, "doc_id long, text string"))
    named = spark.createDataFrame([("b", "the zephyr"), ("a", "the zephyr"), ("c", ""), ("d", None)], "chunk string, body string")
    index.write(named, "chunk", "body")
    got = [(r["rank"], r.doc_id) for r in index.search(queries.where("query_id = 1"), 3).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_two_writers_and_one_that_dies(spark, tmp_path, queries):
    path = f"file://{tmp_path}/index"
    a, b = Bm25Index(spark, path), Bm25Index(spark, path)
    a.write(frame(spark, {1: "the zephyr"}))
    with pytest.raises(RuntimeError):
        b.write(frame(spark, {2: "umbra"}))
    b = Bm25Index(spark, path)
    b.versions.commit = lambda *_: (_ for _ in ()).throw(RuntimeError("died"))
    with pytest.raises(RuntimeError):
        b.write(frame(spark, {2: "umbra"}))
    c = Bm25Index(spark, path)  # sees nothing of it
    same(spark, c, {1: "the zephyr"}, queries)
    c.clean()
    c.write(frame(spark, {3: "cedar quartz"}))
    assert best(c.search(queries, 2)) == best(bm25.top_k(frame(spark, {1: "the zephyr", 3: "cedar quartz"}), queries, 2))


def test_blocks_are_skipped(spark, tmp_path):
    """A rare word decides: blocks without it can't reach the k-th score, and their postings are not scored."""
    docs = {i: "the of and " * (1 + i % 3) + ("zephyr " * 3 if i % 400 == 7 else "") for i in range(4000)}
    index = Bm25Index(spark, f"file://{tmp_path}/index", buckets=2)
    index.write(frame(spark, docs))
    query = spark.createDataFrame([(1, "the zephyr of")], "query_id long, text string")
    assert best(index.search(query, 3)) == best(bm25.top_k(frame(spark, docs), query, 3))
    got = index.search(query, 3, counts=True).first()
    assert got.whole == 2 * 4000 + 10 and got.touched < 0.5 * got.whole


def test_scored_is_exact_for_any_bound_to_beat():
    r = np.random.default_rng(0)
    n_docs, n_terms, size, avgdl, k = 400, 12, 20, 30.0, 3
    tf, dl = r.poisson(0.4, (n_terms, n_docs)), r.integers(5, 80, n_docs)
    w = r.normal(1, 1, (6, n_terms)) * (r.random((6, n_terms)) < 0.5)
    adds = part(tf.astype(float), dl, avgdl)
    whole = w @ adds
    rows = [(t, b, [d for d in range(b * size, b * size + size) if tf[t, d]]) for t in range(n_terms) for b in range(n_docs // size)]
    rows = [x for x in rows if x[2]]
    starts = np.concatenate([[0], np.cumsum([len(x[2]) for x in rows])])
    flat = np.array([d for x in rows for d in x[2]])
    of = np.array([x[0] for x in rows])
    args = (starts, tf[np.repeat(of, np.diff(starts)), flat], dl[flat], flat, of, np.array([x[1] for x in rows]), np.array([adds[t, d].max() for t, _, d in rows]))
    match = (w != 0).astype(float) @ (tf > 0) > 0
    kth = np.array([sorted(whole[q][match[q]])[-k] for q in range(6)])
    counts = []
    for beat in (np.full(6, np.nan), kth - 1, kth):
        out, touched, all_ = scored(*args, w, beat, k, 0, avgdl)
        q, d, s = (np.concatenate(c) for c in zip(*out))
        for i in range(6):
            mine = sorted(((-round(x, 9), y) for x, y in zip(s[q == i], d[q == i])))[:k]
            assert mine == sorted((-round(whole[i, y], 9), y) for y in range(n_docs) if match[i, y])[:k]
        counts.append(touched.sum())
    assert counts[0] == all_.sum() > counts[2]


def test_index_of_a_table(spark, tmp_path, queries):
    path = f"file://{tmp_path}/docs.parquet"
    frame(spark, {1: "the zephyr", 2: "umbra"}).write.parquet(path)
    first = index_of(spark, path)
    assert index_of(spark, path).now == first.now
    frame(spark, {3: "the cedar"}).write.mode("append").parquet(path)
    assert index_of(spark, path).n == 3 and first.n == 2


def test_a_pass_and_the_lists_agree(spark, tmp_path, queries, monkeypatch):
    """Common words are scored where the documents lie, rare ones by their lists: with equal results, deleted documents left out."""
    r = random.Random(6)
    docs = {i: text(r) for i in range(700)}
    index = Bm25Index(spark, f"file://{tmp_path}/index", buckets=4)
    index.write(frame(spark, docs))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 700, 9)], "doc_id long"))
    docs = {k: v for k, v in docs.items() if k % 9}
    monkeypatch.setattr("quarry.operators.index.POOL", 50)
    same(spark, index, docs, queries)
    assert index._few(index._asked(queries)[0]) is not None
    monkeypatch.setattr("quarry.operators.index.PASSED", 0)
    assert index._few(index._asked(queries)[0]) is None
    same(spark, index, docs, queries)


def test_scores_of_common_words_shuffle_no_postings(spark, tmp_path, queries):
    """Every query meets nearly every document: pairs of both must not go through a shuffle to be added up."""
    index = Bm25Index(spark, f"file://{tmp_path}/index")
    r = random.Random(7)
    index.write(frame(spark, {i: text(r) for i in range(200)}))
    assert "Exchange" not in index.scores(queries)._jdf.queryExecution().executedPlan().toString()
