"""Words of many texts at once: runs of bytes other than ASCII white space, with A-Z in lower case if folded.

Words are told apart by 64 bits of a polynomial hash and their length, all in numpy over the bytes of an Arrow
column, so that only different words become Python objects. Texts too long for that are split one by one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at once.
PIECE = 4 << 20
SPACES = b"\t\n\x0b\x0c\r "


def split(text: str, fold: bool = True) -> list[bytes]:
    return (text.encode().lower() if fold else text.encode()).split()


@functools.cache
def tables(fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to words, the value of each byte, powers of an odd number and of its inverse (mod 2^64)."""
    word = np.ones(256, bool)
    word[list(SPACES)] = False
    value = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        value[65:91] = value[97:123]
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, b, np.uint64)])) for b in (base, pow(base, -1, 2**64))]
    return word, value, *powers


def local(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for some in words for w in some], np.int64)
    return np.array([len(some) for some in words], np.int64), ids, list(known)


def word_ids(texts: pa.Array, fold: bool = True, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """For runs of texts (no nulls), in order: the number of words of each text, an id for each word, the different words by id."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i, most = 0, min(most or PIECE, PIECE)
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        if offsets[j] - offsets[i] > PIECE:
            yield local([split(texts[i].as_py(), fold)])
        else:
            some = data[offsets[i] : offsets[j]]
            got = pieces(some, offsets[i : j + 1] - offsets[i], fold)
            yield got if got else local([split(t, fold) for t in texts.slice(i, j - i).to_pylist()])
        i = j


def pieces(data: np.ndarray, bounds: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]] | None:
    """The same for the bytes of some texts; None in the rare case that hashes don't tell words apart."""
    inside, value, power, inverse = tables(fold)
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(value[data], power[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    order = np.argsort(h)
    sorted_ = h[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    length = (ends - starts)[order]
    if (length[1:] != length[:-1])[~new[1:]].any():
        return None
    ids = np.empty(len(h), np.int64)
    ids[order] = np.cumsum(new) - 1
    one = order[new]
    blob = data.tobytes().lower() if fold else data.tobytes()
    words = [blob[a:z] for a, z in zip(starts[one].tolist(), ends[one].tolist())]
    return np.diff(np.searchsorted(starts, bounds)), ids, words


def dictionary_words(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """As word_ids, folded, but by Arrow's own split and hash table, with the different words as a column of strings. The
    empty word stands beside white space at the ends of a text, and in an empty one."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(i, j - i)))
        words = pc.dictionary_encode(lists.flatten())
        yield lists.value_lengths().to_numpy().astype(np.int64), words.indices.to_numpy(), words.dictionary
        i = j
