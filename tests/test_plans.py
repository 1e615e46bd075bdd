import json
import sys
import uuid

import pandas as pd
import pytest
from pyspark import cloudpickle

from quarry.__main__ import parser
from quarry.plans import chain, evaluate, ingest
from quarry.plans.config import Config
from quarry.plans.replies import logged
from quarry.sources import tables, web
from quarry.sources.store import HashingEmbedder, VectorStore, embedded
from quarry.streaming import ingest as streaming

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
EMBED = HashingEmbedder(64)
PAGES = {f"https://x/{n}": f"<main><h1>{n.title()} rules</h1><p>{(n + ' text about it. ') * 40}</p></main>" for n in ("grants", "loans", "permits")}


def fetch(url):
    if url.endswith("robots.txt"):
        return 200, "User-agent: *\nDisallow: /denied"
    if url not in PAGES:
        raise OSError("gone")
    return 200, PAGES[url]


def sources(spark, extra=()):
    return spark.createDataFrame([(u, "html", "c", u.rsplit("/", 1)[1].title()) for u in [*PAGES, *extra]], tables.SOURCE)


def run(spark, tmp_path, **more):
    store = VectorStore(spark, f"{tmp_path}/store")
    rows = ingest.run(spark, sources(spark, ["https://x/denied/a", "https://x/gone"]), fetch, f"{tmp_path}/cache", store, more.pop("embed", EMBED), f"{tmp_path}/marker", "2026-01-01", config=Config(request_delay=0.0), **more)
    return store, rows


def test_ingest(spark, tmp_path):
    store, rows = run(spark, tmp_path)
    assert {r.source_url for r in rows.collect()} == set(PAGES) and store.rows().count() == rows.count() >= 3
    assert (tmp_path / "marker").exists() and len(store.rows().first().embedding) == 64


def test_cache_comes_before_vectors(spark, tmp_path):
    def broken(texts):
        raise RuntimeError("no embedder")

    with pytest.raises(Exception, match="no embedder"):
        run(spark, tmp_path, embed=broken)
    assert (tmp_path / "cache").exists() and not (tmp_path / "marker").exists()


def test_chunks_only(spark, tmp_path):
    run(spark, tmp_path, chunks_only=True, limit=1)
    assert (tmp_path / "cache").exists() and not (tmp_path / "store").exists() and not (tmp_path / "marker").exists()


def test_unknown_type(spark):
    rows = web.fetched(spark.createDataFrame([("https://x/grants", "doc", "c", "t")], tables.SOURCE), fetch, "bot", 0.0)
    with pytest.raises(Exception, match="unknown source type"):
        web.documents(rows, "now").collect()


def test_store(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorStore(spark, "x", "other")
    store = VectorStore(spark, f"{tmp_path}/s", "orc")
    one = spark.createDataFrame([("a", "x")], "chunk_id string, page_content string")
    store.reset(embedded(one, EMBED))
    store.add(embedded(one.unionByName(spark.createDataFrame([("b", "y")], one.schema)), EMBED))
    assert sorted(r.chunk_id for r in store.rows().collect()) == ["a", "b"]


def counting(folder):
    """An embedder that notes each text it is asked for, in files, as tasks run in other processes."""

    def embed(texts):
        for t in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return EMBED(texts)

    return embed


def chunk_rows(spark, pages):
    rows = [(f"{url}#{i}#{hash(t)}", url, t) for url, ts in pages.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "chunk_id string, source_url string, page_content string")


def test_store_merges_by_source(spark, tmp_path):
    store, seen = VectorStore(spark, f"{tmp_path}/s"), tmp_path / "seen"
    seen.mkdir()
    asked = lambda: sorted(f.read_text() for f in seen.iterdir())
    held = lambda version=None: sorted(((r.source_url, r.page_content) for r in store.rows(version).collect()), key=str)
    with pytest.raises(FileNotFoundError):
        store.rows()
    store.merge(chunk_rows(spark, {"a": ["a1", "a2"], "b": ["b1"], None: ["n1"]}), counting(seen))
    assert asked() == ["a1", "a2", "b1", "n1"]
    first = store.versions.numbers()[-1]
    store.merge(chunk_rows(spark, {"a": ["a1", "new"], None: ["n2"]}), counting(seen))  # b is not in the batch and stays
    assert set(held()) == {("a", "a1"), ("a", "new"), ("b", "b1"), (None, "n2")}
    assert asked() == ["a1", "a2", "b1", "n1", "n2", "new"]  # a1 was not embedded again
    assert set(held(first)) == {("a", "a1"), ("a", "a2"), ("b", "b1"), (None, "n1")}
    store.merge(chunk_rows(spark, {}), EMBED, spark.createDataFrame([("b",)], "source_url string"))  # b has no text now
    store.merge(chunk_rows(spark, {"a": ["a1", "a2"]}), EMBED, whole=True)  # what once was there comes back, all else goes
    assert held() == [("a", "a1"), ("a", "a2")]
    with pytest.raises(Exception, match="no embedder"):
        store.merge(chunk_rows(spark, {"a": ["x"]}), lambda t: (_ for _ in ()).throw(RuntimeError("no embedder")))
    assert held() == [("a", "a1"), ("a", "a2")]
    store.compact()
    store.clean()
    assert held() == [("a", "a1"), ("a", "a2")] and len(list((tmp_path / "s" / "parts").iterdir())) == 1


def test_two_writers_of_a_store(spark, tmp_path):
    a = VectorStore(spark, f"{tmp_path}/s")
    before = a._now()
    a.merge(chunk_rows(spark, {"a": ["a1"]}), EMBED)
    with pytest.raises(RuntimeError, match="another writer"):
        a._commit(before, {"parts": [], "gone": [], "schema": "{}"})
    assert a.rows().count() == 1


def test_ingest_again(spark, tmp_path):
    """A changed page leaves no old chunk, a page that is gone none, and unchanged chunks are not embedded again."""
    seen = tmp_path / "seen"
    seen.mkdir()
    run(spark, tmp_path, embed=counting(seen))
    first = len(list(seen.iterdir()))
    kept = dict(PAGES)
    try:
        PAGES["https://x/loans"] = "<main><h1>Loans rules</h1><p>Other words altogether.</p></main>"
        del PAGES["https://x/permits"]
        store, rows = run(spark, tmp_path, embed=counting(seen))
    finally:
        PAGES.clear()
        PAGES.update(kept)
    assert sorted(r.chunk_id for r in store.rows().collect()) == sorted(r.chunk_id for r in rows.collect())
    assert not store.rows().where("page_content like '%loans text%'").count() and len(list(seen.iterdir())) == first + rows.where("source_url like '%loans'").count()


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "f.pdf").write_bytes(b"one|  |three ")
    got = web.read_pdf(spark, f"{tmp_path}/f.pdf", lambda b: b.decode().split("|")).orderBy("page_number").collect()
    assert [(r.page_number, r.page_content) for r in got] == [(1, "one"), (3, "three")]
    (tmp_path / "p.html").write_text("<p>é</p><nav>n</nav>")
    assert web.read_html(spark, f"{tmp_path}/p.html").first().page_content == "é"


def model(prompts):
    out = []
    for p in prompts:
        if p.startswith("Rewrite"):
            out.append("loans rules")
        elif p.startswith("Give exactly"):
            out.append("one variant\n\nloans text")
        elif p.startswith("Sort all"):
            out.append("[2, 2, 99, -1, 0]")
        else:
            out.append("answer to " + p.rsplit("user: ", 1)[1])
    return out


def test_chain(spark, tmp_path):
    store, _ = run(spark, tmp_path)
    history = "array<struct<role:string,content:string>>"
    asked = spark.createDataFrame([(1, "grants rules", []), (2, "and loans?", [("user", "hello")])], f"query_id long, question string, history {history}")
    for mode, n in (("fast", 5), ("best", 5)):
        done, found = chain.answered(asked, store.rows(), EMBED, model, model, mode)
        rows = {r.query_id: r for r in done.collect()}
        assert rows[1].standalone_question == "grants rules" and rows[2].standalone_question == "loans rules"
        assert rows[1].answer == "answer to grants rules" and rows[2].answer == "answer to and loans?"
        ranks = found.toPandas().groupby("query_id")["rank"].apply(lambda s: sorted(s.tolist()))
        assert all(r == list(range(1, len(r) + 1)) and len(r) <= n for r in ranks) and rows[1].context.startswith("[1] ")
    variants = chain.expanded(chain.standalone(asked, model), model).orderBy("query_id", "ordinal").collect()
    assert [r.text for r in variants if r.query_id == 1] == ["one variant", "loans text", "grants rules"]


def test_pdf_and_errors(spark, tmp_path):
    more = spark.createDataFrame([("https://x/a.pdf", "pdf", "c", "A"), ("https://x/denied/b.pdf", "pdf", "c", "B"), ("https://x/broken.pdf", "pdf", "c", "C")], tables.SOURCE)

    def download(url):
        if "broken" in url:
            raise OSError("torn")
        return b"first page of the file|  |third page"

    store = VectorStore(spark, f"{tmp_path}/store")
    rows = ingest.run(spark, sources(spark, ["https://x/gone"]).unionByName(more), fetch, f"{tmp_path}/cache", store, EMBED, f"{tmp_path}/marker", "w", config=Config(request_delay=0.0), download=download, pages_of=lambda b: b.decode().split("|"), errors=f"{tmp_path}/errors")
    assert sorted((r.page_number, r.page_content, r.doc_type) for r in rows.where("source_url = 'https://x/a.pdf'").collect()) == [(1, "first page of the file", "pdf"), (3, "third page", "pdf")]
    wrong = {r.url: r.error for r in spark.read.json(f"{tmp_path}/errors").collect()}
    assert wrong == {"https://x/gone": "gone", "https://x/denied/b.pdf": "denied by robots rules", "https://x/broken.pdf": "torn"}


def test_discover(spark):
    pages = {"https://x/robots.txt": (200, "User-agent: *\nDisallow: /private"), "https://x/map.xml": (200, "<urlset><url><loc>https://x/buying-a-flat/fees</loc></url><url><loc>https://x/other</loc></url></urlset>")}
    got = web.discover(spark, "https://x/map.xml", pages.__getitem__, "bot", ("/buying-a-flat/",)).collect()
    assert [r.url for r in got] == ["https://x/buying-a-flat/fees"]
    with pytest.raises(PermissionError):
        web.discover(spark, "https://x/private/map.xml", pages.__getitem__, "bot", ())


def judge(prompts):
    return ["YES" if "loans" in p or "context" in p else "NO" for p in prompts]


def test_evaluation_run(spark, tmp_path):
    store, _ = run(spark, tmp_path)
    cases = spark.createDataFrame([(1, "loans rules", "answer", ["/loans"], "c"), (2, "weather?", "refuse", None, "c")], tables.CASE)
    text = evaluate.run(cases, store.rows(), EMBED, model, model, judge, f"{tmp_path}/log", "2026-02-03", commit="abc")
    assert "| best | 100% | 100% | 100% | 100% | 50% |" in text and "| fast | 100%" in text and "**#2** (c, failed: refusal)" in text
    saved = tables.read_results(spark, f"{tmp_path}/log")
    trace = json.loads(saved.where("mode = 'best' and id = 1").first().retrieval_diagnostics)
    assert saved.count() == 4 and trace["final_reranked"][0]["rank"] == 1 and trace["original_query"] == trace["standalone_query"] == "loans rules"
    assert trace["generated_queries"] == ["one variant", "loans text", "loans rules"] == [x["query"] for x in trace["retrieved_by_query"]]
    assert all([r["rank"] for r in x["results"]] == list(range(1, len(x["results"]) + 1)) for x in trace["retrieved_by_query"])
    text = evaluate.run(cases, store.rows(), EMBED, model, model, judge, f"{tmp_path}/log", "2026-02-03", ("fast",))
    assert "| best | 100% |" in text and "| fast | 100%" in text  # the other mode's saved results are in the report
    changed = cases.replace("weather?", "rain?", "question")
    evaluate.run_mode(changed, store.rows(), EMBED, model, model, judge, "fast", f"{tmp_path}/log")
    assert tables.read_results(spark, f"{tmp_path}/log").count() == 5  # only the case that changed was asked again


def test_a_model_that_fails_is_not_asked_again(spark, tmp_path):
    """At the 7th of 10 cases: six results are saved, and a rerun asks for the other four alone."""
    store, _ = run(spark, tmp_path)
    cases = spark.createDataFrame([(i, f"loans rules {i}", "answer", ["/loans"], "c") for i in range(1, 11)], tables.CASE)
    asked = tmp_path / "asked"
    asked.mkdir()

    def answers(prompts, fails=None):
        for p in prompts:
            if fails and fails in p:
                raise RuntimeError("model is down")
            (asked / uuid.uuid4().hex).write_text(p)
        return ["a reply" for _ in prompts]

    go = lambda m, batch: evaluate.run_mode(cases, store.rows(), EMBED, model, m, judge, "fast", f"{tmp_path}/log", batch=batch)
    with pytest.raises(Exception, match="model is down"):
        go(lambda p: answers(p, "user: loans rules 7"), 1)
    assert sorted(r.id for r in tables.read_results(spark, f"{tmp_path}/log").collect()) == [1, 2, 3, 4, 5, 6] and len(list(asked.iterdir())) == 6
    assert go(answers, 1).count() == 10 and len(list(asked.iterdir())) == 10
    assert go(answers, 1).count() == 10 and len(list(asked.iterdir())) == 10


def test_replies_are_kept_one_by_one(tmp_path):
    calls = []

    def slow(prompts):
        calls.extend(prompts)
        if "c" in prompts:
            raise RuntimeError("down")
        return [p and p.upper() for p in prompts]

    log = f"file://{tmp_path}/log"
    with pytest.raises(RuntimeError):
        logged(slow, log, "x")(["a", "b", "c", "d"])
    assert logged(slow, log, "x")(["b", "a", "é", None]) == ["B", "A", "É", ""] and calls == ["a", "b", "c", "é", None]
    assert logged(slow, log, "y")(["a"]) == ["A"] and calls[-1] == "a"


def test_settings_and_command_line():
    got = Config.from_environment({"QUARRY_CHUNK_SIZE": "77", "QUARRY_BM25_WEIGHT": "0.5", "QUARRY_SCOPE_PATHS": "/a/,/b/"})
    assert (got.chunk_size, got.bm25_weight, got.scope_paths, got.chunk_overlap) == (77, 0.5, ("/a/", "/b/"), 150)
    a = parser().parse_args(["evaluate", "cases.yaml", "--mode", "fast", "--results", "r", "--folder", "f", "--fast", "json:dumps", "--model", "json:dumps", "--judge", "json:dumps"])
    assert a.mode == ["fast"] and callable(a.judge)


def test_stream(spark, tmp_path):
    folder, store = tmp_path / "in", VectorStore(spark, f"{tmp_path}/store")
    folder.mkdir()
    page = lambda i: pd.DataFrame({"page_id": [i], "url": [f"https://x/{i}"], "html": [f"<p>{'text. ' * 50}{i}</p>"]})
    counts = []
    held = lambda: {r.page_content for r in store.rows().collect()}
    for i in (1, 2, 1):
        page(i).to_parquet(folder / f"{len(counts)}.parquet")
        streaming.stream(spark, str(folder), store, EMBED, f"{tmp_path}/ckpt").awaitTermination()
        counts.append(store.rows().count())
    assert counts[0] >= 1 and counts[1] == 2 * counts[0] == counts[2]
    pd.DataFrame({"page_id": [1, 1], "url": ["https://x/1"] * 2, "html": ["<p>the fee is old</p>", "<p>the fee is new</p>"]}).iloc[1:].to_parquet(folder / "3.parquet")
    pd.DataFrame({"page_id": [2], "url": ["https://x/2"], "html": [""]}).to_parquet(folder / "4.parquet")
    streaming.stream(spark, str(folder), store, EMBED, f"{tmp_path}/ckpt").awaitTermination()
    assert held() == {"the fee is new"}  # the changed page has its new text alone, the emptied one none
