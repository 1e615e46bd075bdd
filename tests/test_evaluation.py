import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.sources import tables

RESULT = "id int, question string, category string, expected_behavior string, answer string, retrieval_pass boolean, faithfulness_pass boolean, relevance_pass boolean, citation_pass boolean, refusal_pass boolean, mode string"


def test_metrics(spark):
    rows = [
        ("answer", ["/Grant"], "Yes.", ["https://x/GRANT"], ["https://x/b"], "yes.", "no"), ("answer", None, "Yes.", [], [], "YES", "YES"),
        ("refuse", [], "I'M SORRY, no", ["u"], ["u"], "YES", "YES"), ("refuse", ["u"], "Sure", [None], [], None, None),
    ]
    df = spark.createDataFrame(rows, "expected_behavior string, must_cite_url_contains array<string>, answer string, retrieved_urls array<string>, source_urls array<string>, faithful string, relevant string")
    got = [tuple(r[f"{m}_pass"] for m in E.METRICS) for r in E.scored(df).collect()]
    assert got == [(True, True, False, False, True), (None, None, True, None, True), (None, None, None, None, True), (False, None, None, False, False)]


def test_summary_and_failures(spark):
    rows = [(i, "q", "c", "answer", "x" * 300, i == 0, None, True, None, i < 7, "best") for i in range(8)] + [(9, "q", "c", "refuse", "a", None, None, None, None, True, "fast")]
    df = spark.createDataFrame(rows, RESULT)
    best = E.summary(df).where("mode = 'best'").first()
    assert (best.retrieval, best.faithfulness, best.relevance, best.refusal) == ("12%", "—", "100%", "88%")
    bad = E.failures(df).orderBy("id").collect()
    assert [r.id for r in bad] == list(range(1, 8)) and bad[-1].failed == "retrieval, refusal" and len(bad[0].shown) == 201
    text = E.report(df, "2026-01-02T03:04:05")
    assert "2026-01-02" in text and "| best | 12% | — | 100% | — | 88% |" in text and "**#7** (c, failed: retrieval, refusal)" in text


def test_resume(spark):
    cases = spark.createDataFrame([(1, "a", "c", "answer"), (2, "b", "c", "answer"), (3, "d", "c", "refuse")], "id int, question string, category string, expected_behavior string")
    saved = spark.createDataFrame([(1, "a", "c", "answer", "old", 1), (1, "a", "c", "answer", "new", 2), (2, "b?", "c", "answer", "x", 3), (9, "z", "c", "answer", "x", 4)], "id int, question string, category string, expected_behavior string, answer string, line_no long")
    assert [(r.id, r.answer) for r in E.latest_saved(cases, saved).collect()] == [(1, "new")]
    assert sorted(r.id for r in E.todo(cases, saved).collect()) == [2, 3]


def test_result_log(spark, tmp_path):
    path = f"{tmp_path}/results"
    assert tables.read_results(spark, path).count() == 0
    row = spark.createDataFrame([(1, "q", "c", "answer", "é", None)], "id int, question string, category string, expected_behavior string, answer string, retrieval_pass boolean")
    full = row.select("*", F.lit(None).cast("array<struct<url:string,title:string,category:string,doc_type:string>>").alias("sources"), *(F.lit(True).alias(f"{m}_pass") for m in E.METRICS[1:]), F.lit(None).cast("string").alias("retrieval_diagnostics"))
    tables.append_results(full, path)
    with open(f"{path}/torn.txt", "w") as f:
        f.write('{"id": 2, "question": "tor\n')
    got = tables.read_results(spark, path).collect()
    assert [(r.id, r.answer, r.retrieval_pass, r.refusal_pass) for r in got] == [(1, "é", None, True)]


def test_appended_last_counts(spark, tmp_path):
    """A short append and then a longer one: files are read by size, results must not be."""
    path = f"{tmp_path}/results"
    cases = spark.createDataFrame([(1, "q", "c", "answer")], "id int, question string, category string, expected_behavior string")
    none = {n: F.lit(None) for n in ("sources", "retrieval_diagnostics")}
    for text, mode in (("old", "best"), ("new " * 3000, "best"), ("other", "fast")):
        row = cases.withColumns({"answer": F.lit(text), **{f"{m}_pass": F.lit(True) for m in E.METRICS}, **none})
        tables.append_results(row, path, mode)
    saved = tables.read_results(spark, path)
    assert [r.answer[:3] for r in E.latest_saved(cases, saved.where("mode = 'best'")).collect()] == ["new"]
    assert {r["mode"]: r.retrieval for r in E.summary(saved).collect()} == {"best": "100%", "fast": "100%"}
    with pytest.raises(Exception):
        tables.read_results(spark, "nostore://x/y")


def test_chunk_cache(spark, tmp_path):
    chunks = spark.createDataFrame([("text é", "u", None, "c1", 0)], "page_content string, source_url string, title string, chunk_id string, chunk_index int")
    tables.write_chunks(chunks, f"{tmp_path}/c")
    r = tables.read_chunks(spark, f"{tmp_path}/c").first()
    assert (r.page_content, r.source_url, r.title, r.chunk_index) == ("text é", "u", None, 0)
    for bad in ('{"metadata": {}}', "{broken"):
        (tmp_path / "bad").write_text(bad + "\n")
        with pytest.raises(Exception, match="invalid chunk record"):
            tables.read_chunks(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "bare").write_text('\n{"page_content": "x"}\n')
    assert [x.page_content for x in tables.read_chunks(spark, f"{tmp_path}/bare").collect()] == ["x"]
    with pytest.raises(FileNotFoundError):
        tables.read_chunks(spark, f"{tmp_path}/absent")


def test_cases(spark, tmp_path):
    (tmp_path / "e.yaml").write_text("cases:\n- {id: 1, question: q, expected_behavior: answer, category: buying, must_cite_url_contains: [/a]}\n- {id: 2, question: r, expected_behavior: refuse, category: x}\n")
    assert [(r.id, r.must_cite_url_contains) for r in tables.read_cases(spark, f"{tmp_path}/e.yaml").collect()] == [(1, ["/a"]), (2, None)]
    (tmp_path / "n.yaml").write_text("other: []\n")
    assert tables.read_sources(spark, f"{tmp_path}/n.yaml").count() == 0
    with pytest.raises(KeyError):
        tables.read_cases(spark, f"{tmp_path}/n.yaml")
