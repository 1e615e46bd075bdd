"""The pipeline, stage by stage: each on what its predecessor kept, held against brute force."""

import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_decontaminate import brute

import corpus_pipeline
from quarry.llm import queries
from quarry.llm.common import crc_mod

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_odd_rows(spark, tmp_path):
    """Null and repeated keys, null and empty texts, other columns, and an empty table go through all five stages."""
    full = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text with a null key that is like no other one here", "x"), (None, None, "x"), (5, "", None), (900_001, "two rows under one key, the first of them speaks of rivers and of hills", "x"), (900_001, "two rows under one key, the second is about other things, such as bread", "x")], "doc_id long, text string, _row string")
    docs = full.withColumn("_row", F.lit("y")).unionByName(odd, allowMissingColumns=True)
    for start in (docs, docs.limit(0)):
        now, n = start, start.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, SF).write.parquet(f"{tmp_path}/{n}-{k}")
            before, now = now, spark.read.parquet(f"{tmp_path}/{n}-{k}")
            assert k == 4 or now.columns == docs.columns
            assert now.count() <= before.count() and (n or not now.count())
        assert now.count() == before.count()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept["toxicity"]
    left = {r.doc_id for r in after}
    judged = [(labels[r.doc_id].toxic, r.doc_id in left) for r in before if r.doc_id in labels]
    assert sum(t == 0 and not s for t, s in judged) <= 0.02 * len(judged)  # so few toxic rows teach nothing; clean ones stay
    before, after = kept["quality classifier"]
    left = {r.doc_id for r in after}
    judged = [(labels[r.doc_id].quality, r.doc_id in left) for r in before if r.doc_id in labels]
    assert sum((q == 1) != s for q, s in judged) <= 0.1 * len(judged)
    before, after = kept["SimHash near-dedup"]
    sets = [shingles(r.text) for r in before]
    roots = list(range(len(before)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                low, high = sorted((roots[i], roots[j]))
                roots = [low if k == high else k for k in roots]
    assert sorted(r.doc_id for r in after) == sorted(min(r.doc_id for r, k in zip(before, roots) if k == root) for root in set(roots))
    before, after = kept["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after) == sorted(k for k, _, hit, _ in brute([(r.doc_id, r.text) for r in before], items) if not hit)
    before, after = kept["SentencePiece encoding and decoding"]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: lib.encode(r.text, add_eos=True) for r in before}
    assert {r.doc_id: r.ids_sha256 for r in after} == {k: hashlib.sha256(" ".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


def test_run_is_registered(spark):
    assert set(queries.QUERIES) >= {"pipeline"} and len([q for q in queries.QUERIES if q.startswith("op")]) == 10
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.where(crc_mod(F.col("doc_id"), 5) == 0).count() < docs.count()
