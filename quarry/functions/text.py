"""Column functions over text: trimming, identities, headings, and tokens for sparse retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind; Java's own class lacks the four separators.
SPACE = r"[\s\x1c-\x1f]"

# Limits and patterns that tell a heading.
HEADING_CHARS, HEADING_WORDS = 90, 12
BULLET = r"^(\d+[.)]|[a-z][.)]|[-*•])\s+"
WEB = r"(?i)^(https?://|www\.)"
BOILERPLATE = r"(?i)^(go to e-services|next steps|related topics|tools and resources|visit hdb flat portal)$"
SENTENCE_END = r"[.!?]$"

# Acronyms and the phrases that they stand for.
EXPANSIONS: dict[str, tuple[str, ...]] = {
    "bto": ("build", "to", "order"),
    "cpf": ("central", "provident", "fund"),
    "ec": ("executive", "condominium"),
    "ehg": ("enhanced", "cpf", "housing", "grant"),
    "eip": ("ethnic", "integration", "policy"),
    "hdb": ("housing", "development", "board"),
    "hfe": ("hdb", "flat", "eligibility"),
    "mop": ("minimum", "occupation", "period"),
    "phg": ("proximity", "housing", "grant"),
    "sbf": ("sale", "of", "balance", "flats"),
    "spr": ("singapore", "permanent", "resident"),
}
#: Of a byte: 1 a digit, UPPER and SMALL a letter, 0 what tokens do not hold (hyphens and all signs beyond ASCII are among it).
UPPER, SMALL = 2, 3
KIND = np.array([1 if 48 <= c <= 57 else UPPER if 65 <= c <= 90 else SMALL if 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPACED = np.where(KIND > 0, LOWER, 32).astype(np.uint8)
#: Texts that are cut at one time.
TEXTS = 512


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def normalised(text: Column) -> Column:
    """Line feeds only, trimmed."""
    return strip(F.regexp_replace(text, "\r\n?", "\n"))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(length))


def source_doc_id(url: Column, page: Column) -> Column:
    """Identity of a page of a source; a missing page number is spelled out."""
    return short_hash(F.concat(F.coalesce(url, F.lit("")), F.lit("#"), F.coalesce(page.cast("string"), F.lit("None"))))


def chunk_id(doc: Column, index: Column, content_hash: Column) -> Column:
    return short_hash(F.concat_ws(":", doc, index.cast("string"), content_hash))


def or_untitled(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))


def section_path(title: Column, section: Column) -> Column:
    whole = or_untitled(title)
    return F.when(F.coalesce(section, F.lit("")).isin("") | (section == whole), whole).otherwise(F.concat_ws(" > ", whole, section))


def is_heading(line: Column) -> Column:
    """A short line that begins with a letter or digit and is no sentence, bullet, address or boilerplate."""
    s = strip(line)
    words = F.size(F.split(s, rf"(?U){SPACE}+"))
    return F.coalesce(
        (s != "") & (F.length(s) <= HEADING_CHARS) & (words <= HEADING_WORDS) & ~s.rlike(BULLET) & ~s.rlike(WEB) & ~s.rlike(BOILERPLATE) & ~s.rlike(SENTENCE_END) & s.rlike(r"^[\p{L}\p{N}]") & s.rlike(r"\p{L}"),
        F.lit(False),
    )


def min_chunk_chars(size: int) -> int:
    """Chunks under it are merged: a quarter of the size between 200 and 350, never over the size."""
    return min(size, max(200, min(350, size // 4)))


def _rows_tokens(text: pa.Array, expansions: Mapping[str, Sequence[str]]) -> pa.ListArray:
    """The tokens of every text of a batch, by passes over the bytes of all; what acronyms and phrases add is put between them."""
    text = pc.fill_null(text, "").cast(pa.large_binary())
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    raw = np.insert(raw, edges[1:-1] - edges[0], 32)  # no token or phrase goes on in the next text
    kind = KIND[raw]
    alnum = kind > 0
    turns = np.flatnonzero(np.diff(alnum, prepend=False, append=False))
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    n, offsets = len(starts), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    ends = np.searchsorted(starts, edges - edges[0] + np.arange(len(edges)))  # tokens before each text's begin
    own, low = (pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(x)) for x in (raw[alnum], LOWER[raw[alnum]]))
    upper = np.flatnonzero((np.maximum.reduceat(kind[alnum], offsets[:-1]) == UPPER) & (sizes > 1)) if n else np.empty(0, int)
    alnum[turns[1::2][turns[1::2] < len(raw)]] = True  # one sign between tokens
    joined = np.concatenate([[32], SPACED[raw[alnum]], [32]]).astype(np.uint8)
    words, at, what = [], [upper + 1], [np.arange(len(upper)) + n]
    some = np.flatnonzero(np.isin(sizes, [len(a) for a in expansions]))
    known = pc.index_in(low.take(pa.array(some)), value_set=pa.array([*expansions], pa.string())).fill_null(-1).to_numpy()
    for k, (acronym, phrase) in enumerate(expansions.items()):
        hits = some[known == k]
        at.append(np.repeat(hits + 1, len(phrase)))
        what.append(np.tile(np.arange(len(phrase)) + n + len(upper) + len(words), len(hits)))
        words += phrase
    for acronym, phrase in expansions.items():
        first = np.array(_places(joined.tobytes(), f" {' '.join(phrase)} ".encode()), int)
        first = np.searchsorted(offsets[:-1] + np.arange(n), first)
        of = np.searchsorted(ends, first, "right")
        rows = np.unique(of[first + len(phrase) <= ends[of]])
        at.append(ends[rows])
        what.append(np.full(len(rows), n + len(upper) + len(words)))
        words.append(acronym)
    at, what = np.concatenate(at), np.concatenate(what)
    if not len(at):
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), low)
    every = pa.concat_arrays([low, own.take(pa.array(upper)), pa.array(words, pa.string())]).take(pa.array(np.insert(np.arange(n), at, what)))
    added = np.bincount(np.searchsorted(ends, at), minlength=len(ends))  # what stands after a token belongs to its text
    return pa.ListArray.from_arrays(pa.array(ends + np.cumsum(added), pa.int32()), every)


def _places(whole: bytes, part: bytes) -> list[int]:
    out, at = [], whole.find(part)
    while at >= 0:
        out.append(at)
        at = whole.find(part, at + 1)
    return out


def sparse_tokens(text: Column, expansions: Mapping[str, Sequence[str]] = EXPANSIONS) -> Column:
    """Lower-case ASCII tokens; an acronym also as written; a known one also as its phrase's words; and
    for each known phrase among the tokens its acronym, once, at the end."""
    expansions = dict(expansions)

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [_rows_tokens(b.slice(low, TEXTS), expansions) for low in range(0, len(b), TEXTS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return cut(text)


#: Counts are all that scoring needs.
sparse_bag = sparse_tokens
