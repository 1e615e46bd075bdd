"""Operator 9: token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is one row of a Parquet table that Spark writes and reads, so any store it knows will do:
    part, seq      the range and the place in it: order of the shard
    first, last    smallest and largest key
    n_tokens       ids in the shard
    nulls          how many of its first keys are null
    keys           the keys in ascending order (<i8), null ones as the smallest value
    turns          how many equal keys came before in the range (<u4): repeated keys stay separate, known by part, key and turn
    ids            the raw payload, all documents one after another (<u2, or <u4 for large vocabularies)
    levels         the perfect hash: bit arrays, one after another (uint8)
    level_bits     their sizes in bits
    prints         a 32-bit fingerprint for each hash value
    offsets        for each hash value, first id of its document in the payload
    lengths        and the number of its ids

The perfect hash is a cascade: each level sets the bits that exactly one of the keys left hits, the
others go on to the next; a key's value is the number of set bits before its own. Lookup takes a
few probes whatever the shard's size; an absent key is told by its fingerprint.

Defined results: a null text counts as empty and has the end id alone; repeated rows are kept, told
apart by turn; null keys sort first; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bytewords import dictionary_words
from quarry.llm.common import bounded_batches, keep_heap, texts, written

SHARD_IDS = 2_000_000
#: Parts of words that one generation remembers; parts that the library sees at once, and as one line.
CACHE_PARTS, AT_ONCE, LINE = 600_000, 20_000, 64
#: Bytes of texts whose words are looked up together.
TOGETHER = 16 << 20
NULL_KEY = -(2**63)
SCHEMA = "part int, seq int, first long, last long, n_tokens long, width int, nulls int, keys binary, turns binary, ids binary, levels binary, level_bits binary, prints binary, offsets binary, lengths binary"


def mixed(keys: np.ndarray, turns: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each (key, turn)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)
        x ^= turns.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct (key, turn) to 0..n-1 in a few probes."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = np.concatenate([[0], np.cumsum(flat)]).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, turns: np.ndarray, room: float = 1.5) -> PerfectHash:
        bits = []
        while len(keys):
            size = max(8, int(len(keys) * room))
            at = (mixed(keys, turns, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = ~alone[at]
            keys, turns = keys[left], turns[left]
            if len(bits) > 200:
                raise ValueError("equal keys can't be told apart")
        return cls(bits)

    def lookup(self, keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The value of each key; absent keys get any value or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = (mixed(keys[left], turns[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.rank[self.begin[level] + at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def prints_of(keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return (mixed(keys, turns, 1_000_003) >> np.uint64(32)).astype("<u4")


class Shard:
    """Keyed access to one row of the table."""

    def __init__(self, row: dict):
        self.keys, self.turns = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["turns"], "<u4")
        self.ids = np.frombuffer(row["ids"], f"<u{row['width']}")
        sizes = np.frombuffer(row["level_bits"], "<u4")
        flat, bits = np.unpackbits(np.frombuffer(row["levels"], np.uint8), bitorder="little"), []
        at = 0
        for n in sizes.tolist():
            bits.append(flat[at : at + n].astype(bool))
            at += -(-n // 8) * 8
        self.hash = PerfectHash(bits)
        self.prints, self.offsets, self.lengths = (np.frombuffer(row[c], "<u4") for c in ("prints", "offsets", "lengths"))

    def find(self, keys: np.ndarray, turns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, its offset and its length, in constant time each."""
        turns = np.zeros(len(keys), np.uint32) if turns is None else turns
        at = self.hash.lookup(keys, turns)
        there = at >= 0
        there[there] = self.prints[at[there]] == prints_of(keys[there], turns[there])
        at = np.where(there, at, 0)
        return there, self.offsets[at] if len(self.offsets) else at, self.lengths[at] if len(self.lengths) else at

    def first_turns(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the keys (ascending) that stand here, and the turn each begins with: 0, but for a key that the shard before ends with."""
        if len(keys) and len(self.keys) and self.turns[0] and keys[0] == self.keys[0]:
            return keys, np.where(keys == self.keys[0], self.turns[0], 0)
        return keys, np.zeros(len(keys), np.int64)

    def get(self, key: int, turn: int = 0) -> np.ndarray | None:
        there, offset, length = self.find(np.array([key], np.int64), np.array([turn], np.uint32))
        return self.ids[offset[0] : offset[0] + length[0]] if there[0] else None


def packed(part: int, seq: int, keys: list[int], turns: list[int], payloads: list[bytes], width: int, nulls: int = 0) -> dict:
    k, t = np.array(keys, np.int64), np.array(turns, np.uint32)
    lengths = np.array([len(p) // width for p in payloads], np.int64)
    offsets = np.cumsum(lengths) - lengths
    ph = PerfectHash.build(k, t)
    at = ph.lookup(k, t)

    def ordered(values: np.ndarray) -> bytes:
        out = np.zeros(len(values), "<u4")
        out[at] = values
        return out.tobytes()

    return {
        "part": part, "seq": seq, "first": keys[0], "last": keys[-1], "n_tokens": int(lengths.sum()), "width": width, "nulls": nulls,
        "keys": k.astype("<i8").tobytes(), "turns": t.astype("<u4").tobytes(), "ids": b"".join(payloads),
        "levels": b"".join(np.packbits(b, bitorder="little").tobytes() for b in ph.bits), "level_bits": np.array([len(b) for b in ph.bits], "<u4").tobytes(),
        "prints": ordered(prints_of(k, t)), "offsets": ordered(offsets), "lengths": ordered(lengths),
    }


def strings(some: pa.Array) -> list[str]:
    return some.to_numpy(zero_copy_only=False).tolist()


def byte_lengths(some: pa.Array) -> np.ndarray:
    return pc.binary_length(some).to_numpy()


def gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans of flat that begin there and are so long, one after another."""
    begin, length = begin[length > 0], length[length > 0]
    if not len(length):
        return flat[:0]
    at = np.ones(length.sum(), np.int64)  # steps, summed in place: one array of this size, not three
    at[0] = begin[0]
    at[np.cumsum(length[:-1])] = begin[1:] - begin[:-1] - length[:-1] + 1
    return flat[np.cumsum(at, out=at)]


class Remembered(dict):
    """Places of parts in the order in which they came; ids of all of them, one part after another."""

    def __init__(self, kind: str):
        super().__init__()
        self.ids, self.stops = np.zeros(0, kind), np.zeros(1, np.int64)

    def places(self, parts: list[str]) -> np.ndarray:
        """The place of each part, -1 for one that is not here."""
        return np.fromiter(map(self.get, parts, repeat(-1)), np.int64, len(parts))

    def spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these places begin, and their numbers."""
        return self.stops[places], self.stops[places + 1] - self.stops[places]

    def add(self, parts: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        """Different parts that are not here yet, and their ids."""
        self.update(zip(parts, range(len(self), len(self) + len(parts))))
        self.ids = np.concatenate([self.ids, ids])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(length)])


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each part of a word once while it is remembered. All that is
    done for each word is done by Arrow and numpy for the different words of many texts at once.

    White space only separates, so the ids of a text are those of its words in order. A word of plain
    letters followed by plain punctuation is two parts, as in the library's own pattern; any other
    word is one. A-Z are lower-cased first, as the library would. Texts that hold an added token of the
    library go to it whole.
    """

    LETTERS = "".join(c for c in map(chr, range(256)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
    SIGNS = "".join(c for c in map(chr, range(128)) if re.match(r"[!-&(-/:-@\[-`{-~]", c))

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values() if t.content]
        self.width, self.code = (2, "H") if self.lib.get_vocab_size() <= 1 << 16 else (4, "I")
        suffix = json.loads(self.lib.to_str())["model"].get("end_of_word_suffix")
        vocab = self.lib.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[k for w, k in vocab.items() if suffix and w.endswith(suffix)]] = True
        self.kind = f"<u{self.width}"
        self.known, self.older = Remembered(self.kind), Remembered(self.kind)

    def ids(self, text: str) -> bytes:
        return array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def library(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of these texts, one text after another, and their numbers."""
        each = [e.ids for e in self.lib.encode_batch_fast(some, add_special_tokens=False)]
        length = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), self.kind, int(length.sum())), length

    def encoded_parts(self, lines: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these parts, one part after another, and their numbers. The first, of letters alone, go to the library LINE
        at a time, with spaces between, where its last tokens of words show which ids are whose."""
        joined = [" ".join(lines[k : k + LINE]) for k in range(0, len(lines), LINE)]
        ids, _ = self.library(joined)
        length = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
        if len(length) != len(lines) or length.sum() != len(ids):
            ids, length = self.library(lines)
        more, its = self.library(rest)
        return np.concatenate([ids, more]), np.concatenate([length, its])

    def learn(self, parts: pa.Array) -> np.ndarray:
        """Places of these different parts among the remembered ones. New ones are remembered, in two generations: where there
        would be too many, those go that the younger one has not met."""
        words = strings(parts)
        places = self.known.places(words)
        new = np.flatnonzero(places < 0)
        if not len(new):
            return places
        if self.known and len(self.known) + len(new) > CACHE_PARTS:
            self.older, self.known = self.known, Remembered(self.kind)
            new = np.arange(len(words))
        before = self.older.places([words[i] for i in new.tolist()])
        met, unmet = new[before >= 0], new[before < 0]
        begin, length = self.older.spans(before[before >= 0])
        self.known.add([words[i] for i in met.tolist()], gathered(self.older.ids, begin, length), length)
        left = parts.take(pa.array(unmet))
        plain = (byte_lengths(pc.utf8_ltrim(left, self.LETTERS)) == 0) & (byte_lengths(left) > 0) & self.last.any()
        for k in range(0, len(unmet), AT_ONCE):
            now, line = unmet[k : k + AT_ONCE], plain[k : k + AT_ONCE]
            some = [[words[i] for i in x.tolist()] for x in (now[line], now[~line])]
            self.known.add([*some[0], *some[1]], *self.encoded_parts(*some))
        places[new] = self.known.places([words[i] for i in new.tolist()])
        return places

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words, one word after another, and their numbers."""
        signs = pc.utf8_ltrim(words, self.LETTERS)
        whole = pa.array(byte_lengths(pc.ascii_ltrim(signs, self.SIGNS)) > 0)
        two = pc.and_(pc.invert(whole), pa.array(byte_lengths(signs) > 0))
        first = pc.if_else(whole, words, pc.ascii_rtrim(words, self.SIGNS))
        parts = pc.dictionary_encode(pa.concat_arrays([first, signs.filter(two)]))
        places = self.learn(parts.dictionary)  # may begin a new generation
        begin, length = self.known.spans(places[parts.indices.to_numpy()])
        spans = np.zeros((2, len(words), 2), np.int64)
        spans[:, :, 0] = begin[: len(words)], length[: len(words)]
        spans[:, two.to_numpy(zero_copy_only=False), 1] = begin[len(words) :], length[len(words) :]
        return gathered(self.known.ids, spans[0].ravel(), spans[1].ravel()), spans[1].sum(1)

    def encode(self, texts_: pa.Array, end: bytes) -> list[bytes]:
        """Payloads of the texts, each with the end."""
        out: list[bytes] = []
        for sizes, local, words in dictionary_words(texts_, TOGETHER):
            flat, length = self.word_ids(words)
            of_each = length[local]
            ids = gathered(flat, (np.cumsum(length) - length)[local], of_each)
            stops = np.concatenate([[0], np.cumsum(of_each)])
            edge = stops[np.concatenate([[0], np.cumsum(sizes)])].tolist()
            out += [ids[a:z].tobytes() + end for a, z in zip(edge, edge[1:])]
        # all hold a sign that few texts have, or none is known: then each is sought
        marks = set.intersection(*(set(re.sub(r"[A-Za-z]", "", t)) for t in self.added)) if self.added else set()
        mark = min(marks, default="")
        none = bool(mark) and not pc.any(pc.match_substring(texts_, mark)).as_py()
        for token in [] if none else self.added:
            for i in np.flatnonzero(pc.match_substring(texts_, token, ignore_case=True).to_numpy(zero_copy_only=False)).tolist():
                out[i] = self.ids(texts_[i].as_py()) + end
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of several batches, until these have TOGETHER bytes: their texts share most words, each to be looked up once."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        waiting.append(b)
        if sum(x.nbytes for x in waiting) >= TOGETHER:
            yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in waiting))]
            waiting = []
    if waiting:
        yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in waiting))]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, ids (the payload of its text and the end) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        enc = word_encoder(tokenizer)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        for keys, some in together(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(enc.encode(some, end), pa.binary())], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def pack_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shards of all documents in ascending key order, one row each (see the module's text).

    Texts are encoded where they are read. Payloads, a fraction of their size, are dealt by range of key, rows of one
    key too by payload and row, and sorted inside each range, so a range is never held whole: a shard closes at shard_ids ids.
    """
    spark = docs.sparkSession
    ids = written(encoded(docs, tokenizer, end_id), "token-ids")
    order = (F.coalesce("doc_id", F.lit(NULL_KEY)), F.col("doc_id").isNotNull(), F.xxhash64("ids"), F.monotonically_increasing_id())
    keyed = ids.select(*(c.alias(n) for c, n in zip(order, ("key", "known", "h", "row"))), "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "key", "known", "h", "row").sortWithinPartitions("key", "known", "h", "row").select("key", "known", "ids")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width, part = word_encoder(tokenizer).width, TaskContext.get().partitionId()
        keys: list[int] = []
        turns: list[int] = []
        payloads: list[bytes] = []
        held, last, turn, seq, nulls = 0, None, 0, 0, 0
        close = lambda: pa.RecordBatch.from_pylist([packed(part, seq, keys, turns, payloads, width, nulls)], schema=schema)
        for batch in batches:
            for key, known, one in zip(*(c.to_pylist() for c in batch.columns)):
                turn = turn + 1 if key == last else 0
                last = key
                if payloads and held + len(one) // width > shard_ids:
                    yield close()
                    keys, turns, payloads, held, seq, nulls = [], [], [], 0, seq + 1, 0
                keys.append(key)
                turns.append(turn)
                payloads.append(one)
                held += len(one) // width
                nulls += not known
        if payloads:
            yield close()

    return dealt.mapInArrow(run, SCHEMA).select(*names)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    pack_tokens(docs, tokenizer, end_id, shard_ids).write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)


def find_documents(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id, turn, part, ids (array of long) of the documents with these keys: only shards whose first and last key
    enclose some are read, and each key is found by its shard's index."""
    bounded_batches(spark)
    wanted = np.unique(np.array(keys, np.int64))
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, turn int, part int, ids array<long>")
    near = F.lit(False)
    for some in np.array_split(wanted, min(64, len(wanted))):
        near = near | ((F.col("first") <= int(some[-1])) & (F.col("last") >= int(some[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, out = Shard(row), []
                held = wanted[(wanted >= row["first"]) & (wanted <= row["last"])]
                least = dict(zip(*(x.tolist() for x in shard.first_turns(held))))
                for key in least:
                    turn = least[key]
                    while (ids := shard.get(key, turn)) is not None:
                        if not (key == NULL_KEY and turn < row["nulls"]):
                            out.append((key, turn, row["part"], ids.tolist()))
                        turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), (), ()), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["doc_id", "turn", "part", "ids"])

    return spark.read.parquet(path).where(near).mapInArrow(run, "doc_id long, turn int, part int, ids array<long>")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone and each by its key through the index:
    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit little-endian ids)."""
    bounded_batches(spark)
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    inside = Window.partitionBy("part").orderBy("seq")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    base = sizes.withColumn("base", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("ahead")).alias("base"))
    joined = shards.join(F.broadcast(base) if shards.count() <= 100_000 else base, ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                there, offsets, lengths = shard.find(shard.keys, shard.turns)
                if not there.all():
                    raise ValueError(f"shard {row['part']}: a key is not in the index")
                ids = shard.ids.astype("<u4")
                ends = offsets + lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets.tolist(), ends.tolist())]
                keys = pa.array(shard.keys, pa.int64(), mask=np.arange(len(shard.keys)) < row["nulls"])
                yield pa.RecordBatch.from_arrays([keys, pa.array(offsets.astype(np.int64) + row["base"]), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
