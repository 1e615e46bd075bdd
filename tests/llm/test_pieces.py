import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.pieces import PrefixTableEncoder, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = PrefixTableEncoder(MODEL)
CASES = ["", " ", "  ", "\n", "a", "Hello world", " lead", "trail ", "a  b   c    d", " " * 37, "\n\n \n", "\t x", "▁", "▁▁a ▁", "naïve café", "日本語 text", "😀 smile", "\x00", "<s> </s> <unk> <0x0A>", "x" * 500, "the " * 300, "!!??..,,", "don't 1234567890", "á", "⁇ �", "ab" * 4000, "=" * 100 + " " * 50 + "#"]


def agrees(text):
    ids = LIB.encode(text, add_eos=True)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIB.decode(ids).encode()


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    agrees(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁abcdethinonre.,!'%1"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_decoding_any_ids(ids):
    assert OWN.decode(ids) == LIB.decode(ids).encode()


def test_decoding_stray_bytes():
    for ids in ([228, 131], [3 + 0xF0, 3 + 0x9F, 3 + 0x98, 22557], [3 + 0xC3, 3 + 0xA9, 3 + 0xC3]):
        assert OWN.decode(ids) == LIB.decode(ids).encode()


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "y"), (2, None, None), (None, "", "z"), (3, "word " * 20000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in encode_pieces(docs, MODEL, with_ids=False).collect()}
    assert encode_pieces(docs, MODEL, with_ids=False).count() == 5
    for key, text, _ in rows:
        ids = LIB.encode(text or "", add_eos=True)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_pieces(docs.limit(0), MODEL).count() == 0
    assert encode_pieces(docs.where("doc_id = 1"), MODEL).first().ids == LIB.encode("Hello world", add_eos=True)


def test_frequent_units_outlive_a_full_cache(monkeypatch):
    """All units went when there were too many, so frequent ones were encoded again each time: 41 here, not 2."""
    from quarry.llm import pieces

    monkeypatch.setattr(pieces, "CACHE_UNITS", 40)
    own, asked = PrefixTableEncoder(MODEL), []
    part_ids = own.part_ids
    monkeypatch.setattr(own, "part_ids", lambda part: asked.append(part) or part_ids(part))
    text = " ".join(f"often oft, wor{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]} often." for k in range(400))
    assert own.encode(text) == LIB.encode(text, add_eos=True)
    assert asked.count("▁often") <= 2 and asked.count(",") <= 2
    assert len(own.cache) <= 40 and len(own.older) <= 40
