import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import splitting as S
from quarry.functions.text import min_chunk_chars
from quarry.operators import chunking
from quarry.operators.chunking import chunk_documents, lines, section_bounds

#: A guide to beekeeping: three sections of different length, the second under the size of the smallest chunk.
GUIDE = "Keep bees with patience.\n\nThe hive\nA hive is a stack of boxes. The queen lives in the lowest one, and honey is stored above her.\n\nTools\nA smoker.\n\nThe year of a colony\nIn winter the bees sit tight. In spring they fly out for willow. By midsummer there are sixty thousand of them."
TITLE = "Ferry timetable"


def cards(n, gap=None, after=True):
    """A page that begins with its title and n cards of two lines; a blank line before card `gap`."""
    out = [f"{TITLE} and fares", "Next steps"]
    for i in range(n):
        out += [""] * (i == gap) + [f"Pier {chr(65 + i)} crossings", f"See when boats leave pier {chr(65 + i)}."]
    return "\n".join(out + ["", "Winter service", "Boats run every second hour from November on, if the lake does not freeze."] * after)


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()[:16]


def test_smallest_chunk():
    assert [min_chunk_chars(n) for n in (80, 160, 350, 1000, 2000)] == [80, 160, 200, 250, 350]


def test_headings():
    yes = ["Eligibility", "2 rooms", "Über uns", "Step 1: apply"]
    no = ["", "A sentence.", "1. first", "a) x", "- x", "• x", "https://x.y", "WWW.x.y", "Next Steps", "(see)", "123", "w " * 13, "x" * 91]
    assert all(map(S.is_heading, yes)) and not any(map(S.is_heading, no))


def titles(text, title, size, overlap=0):
    return [(c["section_index"], c["section_title"]) for c in S.chunks(text, title, size, overlap)]


def test_each_section_gets_a_chunk_once_it_is_large_enough():
    own = [(0, "Bees"), (1, "The hive"), (2, "Tools"), (3, "The year of a colony")]
    assert [(i, n) for i, (n, _) in enumerate(S.sections(GUIDE, "Bees"))] == own
    assert titles(GUIDE, "Bees", 2000) == [own[3]]  # all fits into one chunk, and the longest section names it
    small = S.chunks(GUIDE, "Bees", 90, 0)
    assert {c["section_title"] for c in small} >= {"The hive", "The year of a colony"} and all(len(c["text"]) <= 90 for c in small)
    assert "".join(GUIDE.split()) == "".join("".join(c["text"] for c in small).split())  # without overlap nothing is lost or repeated


def test_a_small_section_goes_with_the_next_one():
    chunk = next(c for c in S.chunks(GUIDE, "Bees", 130, 13) if "A smoker." in c["text"])
    assert chunk["text"].startswith("Tools") and len(chunk["text"]) > len("Tools\nA smoker.")


@pytest.mark.parametrize("n", [1, 4, 9])
def test_cards_under_next_steps_are_no_headings(n):
    found = [name for name, _ in S.sections(cards(n), TITLE)]
    assert found == [f"{TITLE} and fares", "Winter service"]


def test_limits_of_navigation():
    first = f"{TITLE} and fares"
    assert [n for n, _ in S.sections(cards(3, after=False), TITLE)] == [first]  # without a blank line all the rest are cards
    assert [n for n, _ in S.sections(cards(3, gap=0), TITLE)] == [first, "Pier A crossings", "Pier B crossings", "Pier C crossings", "Winter service"]
    assert [n for n, _ in S.sections(cards(3, gap=2), TITLE)] == [first, "Pier C crossings", "Winter service"]
    twice = cards(2).replace("Pier B crossings", "NEXT  steps")
    assert [n for n, _ in S.sections(twice, TITLE)] == [first, "Winter service"]
    assert "Pier A crossings" in [n for n, _ in S.sections(cards(2), "Tram timetable")]  # the page does not begin with its title
    late = cards(2).replace("\nNext steps", "".join(f"\nNote {i}" for i in range(6)) + "\nNext steps")
    assert "Pier A crossings" in [n for n, _ in S.sections(late, TITLE)]  # not among the first lines


def test_link_lists_fall_together():
    """Many headings with a line each are joined until a chunk is full, the fixed phrases being none."""
    text = "\n".join(f"Plot {i}\nThe soil of plot {i} is {'clay' if i % 2 else 'sand'}." for i in range(14)).replace("Plot 3\n", "Related topics\n")
    assert "Related topics" not in [n for n, _ in S.sections(text, "Soils")] and len(S.sections(text, "Soils")) == 13
    found = S.chunks(text, "Soils", 180, 20)
    assert len(found) == 3 and all(45 <= len(c["text"]) <= 200 for c in found)


def test_no_heading():
    text = "Rain fell all night; by morning the lower fields were under water. Nobody was hurt."
    assert set(titles(text, "Weather", 40, 5)) == {(0, "Weather")} and set(titles(text, "", 40, 5)) == {(0, "Untitled")}
    assert S.chunks("", "x") == [] and S.chunks(None, None) == []
    with pytest.raises(ValueError):
        S.chunks("x", "y", 10, 20)


def test_recursive_split():
    assert list(S.recursive("aa bb cc dd", 5, 0)) == ["aa bb", "cc", "dd"]
    assert list(S.recursive("aa bb cc dd", 6, 3)) == ["aa bb", "bb cc", "cc dd"]
    assert list(S.recursive("abcdefgh", 3, 1)) == ["abc", "cde", "efg", "gh"]
    assert list(S.recursive("a\n\nb", 10, 0)) == ["a\n\nb"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n\r \x1cHÜ1-"), max_size=300), st.integers(10, 120), st.integers(0, 10))
def test_spans(text, size, overlap):
    body = S.normalise(text)
    found = S.chunks(text, "T", size, overlap)
    assert [c["chunk_index"] for c in found] == list(range(len(found)))
    for c in found:
        assert body[c["start"] : c["end"]] == c["text"] and 0 < len(c["text"]) <= size + overlap
    assert not body or found


def test_frame(spark):
    rows = [("Sentence. " * 100, "https://x", "T", None, "keep"), ("Heads\n" + "Text of it. " * 9, None, "", 3, None), ("", "u", "t", 1, "")]
    docs = spark.createDataFrame(rows, "page_content string, source_url string, title string, page_number int, category string")
    got = chunk_documents(docs, 200, 20).collect()
    assert [r.chunk_index for r in got if r.source_url] == list(range(sum(1 for r in got if r.source_url)))
    for r in got:
        doc = h(f"{r.source_url or ''}#{r.page_number}")
        assert (r.source_doc_id, r.chunk_content_hash) == (doc, h(r.page_content))
        assert r.chunk_id == h(f"{doc}:{r.chunk_index}:{r.chunk_content_hash}") and r.chunk_char_count == len(r.page_content) == r.chunk_end_char - r.chunk_start_char
        assert (r.chunking_strategy, r.chunk_size, r.chunk_overlap) == ("section_recursive_v3", 200, 20)
    assert {r.section_path for r in got} == {"T", "Untitled > Heads"} and {r.category for r in got} == {"keep", None}


def test_native_agrees_with_spans(spark):
    texts = [cards(3).replace("Next steps", "More"), GUIDE, "  Intro text here.\nHead One\n x y.\nHead Two", "No heading.", "\r\n A\r\rB. \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    native = {}
    for r in lines(docs).orderBy("doc_id", "line_no").collect():
        native.setdefault(r.doc_id, []).append((r.start, r.stop))
    assert native == {i: S.lines_of(S.normalise(t)) for i, t in enumerate(texts)}
    titles = {}
    for r in section_bounds(docs).orderBy("doc_id", "section_index").collect():
        titles.setdefault(r.doc_id, []).append((r.title or "", r.start))
    assert titles == {i: [(n, s[0]) for n, s in S.sections(S.normalise(t), "")] for i, t in enumerate(texts)}


def test_rows_of_one_key_keep_lines_of_their_own(spark):
    docs = spark.createDataFrame([(1, "aaa\nbbb"), (1, "dddd\n\n eee"), (None, "ccc"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.line_no, r.line, r.start, r.stop) for r in lines(docs).collect()) == [("1", 0, "aaa", 0, 3), ("1", 0, "dddd", 0, 4), ("1", 1, "bbb", 4, 7), ("1", 2, "eee", 7, 10), ("None", 0, "ccc", 0, 3)]
    assert sorted((str(r.doc_id), r.section_index, r.title, r.start, r.stop) for r in section_bounds(docs).collect()) == [("1", 0, "aaa", 0, 4), ("1", 0, "dddd", 0, 7), ("1", 1, "bbb", 4, 7), ("1", 1, "eee", 7, 10), ("None", 0, "ccc", 0, 3)]


def test_lines_of_a_long_text_take_no_longer_each():
    import time

    from quarry.operators.chunking import _line_spans

    took = []
    for n in (20_000, 200_000):
        began = time.perf_counter()
        assert len(_line_spans("a line\n" * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 60 * took[0]


def test_section_of_chunk_against_all_pairs(spark):
    """Chunks and sections with gaps between, empty ones, chunks before the first section and after the last."""
    r = random.Random(14)
    chunks, sections, want = [], [], {}
    for doc in range(60):
        edges = sorted(r.sample(range(5, 90), 2 * r.randrange(1, 7)))
        own = list(zip(edges[::2], edges[1::2])) if doc % 2 else list(zip(edges, edges[1:]))
        sections += [(doc, i, a, b) for i, (a, b) in enumerate(own)]
        for k in range(12):
            a = r.randrange(100)
            b = a + r.choice((0, 1, 5, 20, 60))
            chunks.append((doc, k, a, b))
            shared = [min(b, y) - max(a, x) for x, y in own]
            before = [i for i, (x, _) in enumerate(own) if x <= a]
            want[doc, k] = shared.index(max(shared)) if max(shared) > 0 else max(before, default=0)
    chunks.append((99, 0, 0, 5))  # of a document without sections
    got = chunking.section_of_chunk(
        spark.createDataFrame(chunks, "doc_id long, chunk_index int, start long, stop long"),
        spark.createDataFrame(sections, "doc_id long, section_index int, start long, stop long"),
    )
    assert {(x.doc_id, x.chunk_index): x.section_index for x in got.collect()} == want


def test_lines_of_a_batch_are_columns():
    """A batch of many texts is not held as objects: lines come as columns, text by text."""
    from quarry.operators import chunking

    texts = [None, "", "  a \n\n b", "one", "x\r\ny\r"] * 3
    got = chunking._lines_of(texts)
    assert [[tuple(x.values()) for x in row] for row in got.to_pylist()] == [chunking._line_spans(t) for t in texts]
    assert got.nbytes < 60 * 24 and chunking._lines_of([]).to_pylist() == []
