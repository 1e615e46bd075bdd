import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.binary import PerfectHash, Shard, WordEncoder, find_documents, packed, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = WordEncoder(PATH)


def ids_of(text):
    return LIB.encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\x0b\x0cabTHE's.,!'%1éÉßñ́"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_words(text):
    got = OWN.encode(pa.array([text]), np.array([2], "<u2").tobytes())[0]
    assert np.frombuffer(got, "<u2").tolist() == ids_of(text)


def test_added_tokens_as_the_library_has_them():
    some = ["hello <|endoftext|> world", "<|startoftext|>a", "x<|ENDOFTEXT|>y", "<|endof text|>", " <|endoftext|><|endoftext|>  b", "plain"]
    assert [np.frombuffer(x, "<u2").tolist() for x in OWN.encode(pa.array(some), b"\2\0")] == [ids_of(t) for t in some]
    assert 49407 in ids_of(some[0])


def test_more_words_than_remembered(monkeypatch):
    import quarry.llm.binary as m

    monkeypatch.setattr(m, "CACHE_PARTS", 8)
    own = WordEncoder(PATH)
    all_texts = [" ".join(f"w{i}" for i in range(50)), "a b c", " ".join(f"x{i}." for i in range(9))]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(pa.array(all_texts), b"\2\0")] == [ids_of(t) for t in all_texts]


def test_words_of_the_older_generation(monkeypatch):
    import quarry.llm.binary as m

    monkeypatch.setattr(m, "CACHE_PARTS", 20)
    own = WordEncoder(PATH)
    for k in range(12):
        some = [f" q{i}. zürich\t{'É' * (i % 3)}x{i % 7}, " for i in range(k, k + 9)] + ["", " ", "\x0b", "a\x00b\x1c c\xa0D\u2003e"]
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(pa.array(["cut", *some]).slice(1), b"\2\0")] == [ids_of(t) for t in some]
    assert own.older


def test_no_call_for_each_word():
    """Each new word took ten calls of Python functions and more, and each of its forms with signs was remembered by itself."""
    import cProfile
    import pstats

    own = WordEncoder(PATH)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mé", "ni") for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"]
    some = [" ".join(w + sign for w in words) for sign in ("", ",", "...", "!?")]
    with cProfile.Profile() as calls:
        got = own.encode(pa.array(some), b"\2\0")
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [ids_of(t) for t in some]
    assert set(own.known) == {*words, ",", "...", "!?"}
    assert pstats.Stats(calls).total_calls < len(words)


def test_generation_that_ends_between_two_lookups(monkeypatch):
    """Places belong to the generation that the lookup leaves, not to the one before."""
    import quarry.llm.binary as m

    monkeypatch.setattr(m, "CACHE_PARTS", 30)
    own = WordEncoder(PATH)
    for k in range(0, 60, 5):
        text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}zq{',' * (i % 3)} it's{i}" for i in range(k, k + 12))
        before = own.known
        assert np.frombuffer(own.encode(pa.array([text]), b"\2\0")[0], "<u2").tolist() == ids_of(text)
        assert before is own.known or own.older is before
    assert own.older


def test_perfect_hash():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(r.integers(-(2**40), 2**40, n))
        turns = np.zeros(len(keys), np.uint32)
        assert sorted(PerfectHash.build(keys, turns).lookup(keys, turns)) == list(range(len(keys)))


def test_shard_access():
    keys = list(range(0, 3000, 3))
    shard = Shard(packed(0, 0, keys, [0] * 1000, [np.array([k, k + 1], "<u2").tobytes() for k in keys], 2))
    assert all(shard.get(k).tolist() == [k, k + 1] for k in keys)
    assert sum(shard.get(k) is None for k in range(1, 3000, 3)) == 1000


def counted(text):
    ids = np.array(ids_of(text or ""), "<u4")
    return len(ids), zlib.crc32(ids.tobytes())


def test_round_trip(spark, tmp_path):
    rows = [(7, "The quick, brown fox!", 1), (2, None, 2), (None, "null key", 3), (7, "again", 4), (4, "", 5), (1, "word " * 9000, 6), (7, "again", 4), (-(2**63), "least <|endoftext|>", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    write_tokens(docs, f"{tmp_path}/t", PATH, shard_ids=20)
    got = sorted(read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -(2**63), 1, 2, 4, 7, 7, 7]
    left = [(k, *counted(t)) for k, t, _ in rows]
    start = 0
    for r in got:  # repeated keys in any order, each once
        left.remove((r.doc_id, r.n_tokens, r.ids_crc32))
        assert r.start == start
        start += r.n_tokens
    found = find_documents(spark, f"{tmp_path}/t", [7, 4, 3, -(2**63)]).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((k, ids_of(t or "")) for k, t, _ in rows if k in (7, 4, -(2**63)))
    assert find_documents(spark, f"{tmp_path}/t", []).count() == 0
    write_tokens(docs.limit(0), f"{tmp_path}/e", PATH)
    assert read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_batches_are_looked_up_together(monkeypatch):
    """Each batch of 1,000 rows looked its words up anew."""
    import pyarrow as pa

    from quarry.llm import binary

    batches = [pa.RecordBatch.from_arrays([pa.array([k, None], pa.int64()), pa.array([f"a b {k}" * 50, ""])], names=["doc_id", "text"]) for k in range(7)]
    (keys, some), = binary.together(iter(batches))
    assert keys.to_pylist() == [x for k in range(7) for x in (k, None)] and some.to_pylist()[2] == "a b 1" * 50
    monkeypatch.setattr(binary, "TOGETHER", 600)
    parts = list(binary.together(iter(batches)))
    assert 2 < len(parts) < 7 and [x for p in parts for x in p[1].to_pylist()] == some.to_pylist()
    assert list(binary.together(iter([]))) == []
