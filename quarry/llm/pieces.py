"""Operator 3: SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a text there is exactly one last token in the encoding of that prefix. The table
holds that token for each prefix: an automaton lists the pieces that end at a position, and of these
the one holds whose left neighbour (the last token of the prefix before it) it can stand beside, that
is, whose concatenation the merges would leave as this pair. Ids are then recovered from the end
backwards. Linear in the text; no priority queue over the text is kept.

Merges never cross two adjacent characters that no piece has side by side, so a text falls apart into
units there; a worker keeps the ids of units it has met (bounded: two generations of them).

Defined results: a null text counts as empty; an empty text has the end id alone and decodes to
the empty text; repeated rows each give a row; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import REMEMBERED, bounded_batches, texts

SPACE = "▁"
#: Every byte that is no UTF-8 becomes a replacement character of its own.
codecs.register_error("quarry-bytewise", lambda e: ("\ufffd", e.start + 1))
CACHE_UNITS, CACHE_PAIRS, LONGEST_CACHED = 300_000, 2_000_000, 64


class PrefixTableEncoder:
    """Encodes and decodes with the pieces of a byte-fallback BPE model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with identity normalisation, dummy prefix and byte fallback is needed")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.surface: list[bytes] = []
        #: Whose leading space decoding keeps; ids without a surface.
        self.kept: list[bool] = []
        self.silent: set[int] = set()
        self.end_id = 2
        for i, p in enumerate(model.pieces):
            self.kept.append(p.type in (2, 6))
            self.surface.append(b"")
            if p.type == 1:
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.surface[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.surface[i] = i, bytes([value])
            elif p.type == 2:
                self.surface[i] = " ⁇ ".encode()
            elif p.type == 3:
                self.silent.add(i)
            else:
                raise ValueError(f"piece type {p.type} is not handled")
        beside = {a + b for piece in self.score for a, b in zip(piece, piece[1:])}
        self.beside = beside
        self.alone = "\n" if not any("\n" in p for p in self.score) else ""
        if any(b == SPACE and a != SPACE for a, b in beside):
            raise ValueError("a piece has a space after another character")
        self.units = re.compile(f"{SPACE}+[^{SPACE}{self.alone}]*|[^{SPACE}{self.alone}]+" + (f"|[{self.alone}]+" if self.alone else ""))
        chars = {c for piece in self.score for c in piece}
        if not chars <= self.score.keys():
            raise ValueError("a piece has a character that is no piece")
        self.chars = chars
        self.automaton = ahocorasick.Automaton()
        #: By id, the merges that make a piece: (score, its last symbol, its first symbol) after each.
        self.steps: list[list[tuple[float, str, str]]] = [[] for _ in model.pieces]
        for piece, i in self.id.items():
            parts, steps = self.merged(piece)
            self.steps[i] = [(float("inf"), piece[-1], piece[0]), *steps]
            if parts == [piece]:  # pieces that merging can end in
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.length = [0] * len(model.pieces)
        for piece, i in self.id.items():
            self.length[i] = len(piece)
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The merges on a short text: best score first, leftmost of equals."""
        parts, steps, score = list(text), [], self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[-1], parts[0]))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces side by side.

        What happens inside either is known; they take turns by score, leftmost of equals, and
        the pair fails once the merge across the middle is the best there is.
        """
        left, right, score = self.steps[a], self.steps[b], self.score
        i = j = 1
        while True:
            across = score.get(left[i - 1][1] + right[j - 1][2])
            x = left[i][0] if i < len(left) else None
            y = right[j][0] if j < len(right) else None
            if x is not None and (y is None or x >= y):
                if across is not None and across > x:
                    return False
                i += 1
            elif y is not None:
                if across is not None and across >= y:
                    return False
                j += 1
            else:
                return across is None

    def part_ids(self, part: str) -> list[int]:
        """The prefix table of a text, read backwards. Every character is a piece, or it is one character."""
        n = len(part)
        if n == 1:
            piece = self.id.get(part)
            return [piece] if piece is not None else [self.byte_id[b] for b in part.encode()]
        fits, length = self.fits, self.length
        last = [0] * (n + 1)
        for end, (piece, size) in self.automaton.iter(part):
            end += 1
            if last[end]:
                continue
            if size < end:
                pair = last[end - size] << 20 | piece
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    fit = fits[pair] = self.compatible(pair >> 20, piece)
                if not fit:
                    continue
            last[end] = piece
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]

    def unit_ids(self, unit: str) -> list[int]:
        """Characters at the end that nothing can merge with stand alone, so that a word with signs after it is known as the word."""
        stop, beside = len(unit), self.beside
        while stop > 1 and unit[stop - 2 : stop] not in beside:
            stop -= 1
        if stop < len(unit):
            ids = [*self.remembered(unit[:stop])]
            for c in unit[stop:]:
                ids += self.remembered(c)
            return ids
        if self.chars.issuperset(unit):
            return self.part_ids(unit)
        ids, begin = [], 0
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1] + unit[i] not in beside:
                ids += self.part_ids(unit[begin:i])
                begin = i
        return ids

    def remembered(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit, kept in two generations: where there would be too many, those go that the younger one has not met."""
        found = self.cache.get(unit)
        if found is None:
            found = self.older.get(unit)
            if found is None:
                found = tuple(self.unit_ids(unit))
            if len(unit) <= LONGEST_CACHED:
                if len(self.cache) >= CACHE_UNITS:
                    self.older, self.cache = self.cache, {}
                self.cache[unit] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        ids: list[int] = []
        if text:
            get = self.cache.get
            for unit in self.units.findall(SPACE + text.replace(" ", SPACE)):
                known = get(unit)
                if known is None:
                    known = self.remembered(unit)
                    get = self.cache.get
                ids += known
        ids.append(self.end_id)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text: one leading space goes, bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        while ids and ids[0] in self.silent:
            ids = ids[1:]
        if raw[:1] == b" " and not self.kept[ids[0]]:
            raw = raw[1:]
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="quarry-bytewise").encode()


@functools.lru_cache(maxsize=2)
def encoder(model_file: str) -> PrefixTableEncoder:
    """One for each worker process."""
    return PrefixTableEncoder(model_file)


REMEMBERED.append(encoder.cache_clear)


def encode_pieces(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids array<int> (with the end id), decoded string; without with_ids their digests instead:
    n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, ids array<int>, decoded string" if with_ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        decimal = [str(i) for i in range(len(enc.surface))]
        for batch in batches:
            all_ids, decoded = [], []
            hashes, counts = [], []
            for text in batch.column(1).to_pylist():
                ids = enc.encode(text)
                if with_ids:
                    all_ids.append(ids)
                    decoded.append(enc.decode(ids).decode())
                else:
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "ids", "decoded"] if with_ids else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(run, schema)
