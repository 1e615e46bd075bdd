"""Every registered query of the subpackage over a whole small table: columns and types of its contract, one row where it says so."""

import zlib
from collections import Counter

import duckdb
import pytest

from quarry.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_log_bilinear": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op7_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_ring_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "pipeline": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.fixture(scope="module")
def got(spark):
    return {name: (df := f(spark, SF), df.collect()) for name, f in queries.QUERIES.items()}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, got, name):
    df, rows = got[name]
    kinds = [f"{n} {t}" for n, t in df.dtypes]
    assert kinds[: len(COLUMNS[name].split(", "))] == COLUMNS[name].split(", ")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    if name not in ("op7_top_k", "op11_html_extraction", "op12_whitening", "op13_prefix_trie", "pipeline"):
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    for column, n, rest in (("op1_log_bilinear", 7, 2), ("op2_toxicity", 5, 0), ("op10_quality", 4, 2)):
        if name == column:
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
    if name in ("op2_toxicity", "op10_quality"):
        cut = 0.5 if name == "op2_toxicity" else 0.7
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    if name == "op8_ring_shards":
        counts = Counter(r.shard for r in rows)
        assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)
        assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode()), "rows", None) for r in rows)
    if name == "op9_token_files":
        start = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert r.start == start
            start += r.n_tokens


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(got, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got[name][1])
