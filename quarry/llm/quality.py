"""Operator 10: a quality classifier on random-indexing word vectors.

A word's form is it in lower case without punctuation around it. Every form has a sparse random index vector
from its hash, and so has every shape (runs of upper case, lower case, digits, and each other sign once), and so has
repetition of the word before. A unit's context vector is the sum of the index vectors of the words, shapes and
repetitions around it, WINDOW words either way in the same document, over all documents (random indexing). Forms of one of BUCKETS
buckets share a context vector, as shapes do in SHAPES. A word's vector is its context vector scaled to length 1, plus its own
index vector, so different words have different ones, however many there are. A document is the mean of its words' vectors and of its shapes' vectors.
A network with one hidden layer, trained in numpy, gives a logit, and a temperature fitted on
rows it was not trained on makes it a probability.

Index vectors hold whole numbers, so sums are exact and the same in any order of rows. The
vectors cover all documents; the network is fitted on a sample of at most PER_CLASS training
documents of each label, weighted to the labels' true shares.

Defined results: words are what white space separates; null and empty texts are the zero vector and get what
the network says of it; without a training row of either label every score is the share of good rows;
repeated rows each give a row; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, filtered, forget, giving_back, keep_heap, texts, written
from quarry.llm.labelled import labelled_sample

PER_CLASS = 4000
BUCKETS, SHAPES, DIM, NONZERO, WINDOW = 65_536, 1024, 32, 6, 2
#: Rows of the units: buckets of forms, shapes, repetition.
SAME, UNITS = BUCKETS + SHAPES, BUCKETS + SHAPES + 1
#: Words remembered, words that are worked on at once, units of a block.
CACHE_WORDS, SLICE, BLOCK = 600_000, 100_000, 4096
#: Partial sums of a block that are added up by one group.
FAN = 32
SAME_KEY = b"\x00same"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
RUNS = ((re.compile(r"[^\W\d_a-z]*[A-Z][^\W\d_a-z]*"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1"))


def shape(word: str) -> str:
    """Of the whole word. A long one, over eight signs, is told by which signs it has and how many."""
    core = word if word.isalnum() else word[:-1]
    if core.isalpha() and core.isascii():  # most words, with a sign behind or none; the patterns say the same of these
        rest = word[len(core) :]
        if core.islower():
            return "a" + rest
        if core[1:].islower():
            return "Aa" + rest
    for pattern, sign in RUNS:
        word = pattern.sub(sign, word)
    return word if len(word) <= 8 else f"{len(word).bit_length()}:{''.join(sorted(set(word)))}"


def form(word: str) -> str:
    return word.lower().strip(EDGES)


def index_vectors(keys: list[bytes]) -> np.ndarray:
    """The sparse random vectors (whole numbers) of keys: NONZERO places and signs from two checksums of each."""
    low = np.fromiter(map(zlib.crc32, keys), np.uint64, len(keys))
    high = np.fromiter((zlib.crc32(k, 0x9E3779B9) for k in keys), np.uint64, len(keys))
    bits = low | high << np.uint64(32)
    with np.errstate(over="ignore"):
        bits = (bits ^ (bits >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits ^= bits >> np.uint64(32)
    out, row = np.zeros((len(keys), DIM), np.int16), np.arange(len(keys))
    for k in range(NONZERO):
        some = bits >> np.uint64(7 * k)
        out[row, (some % np.uint64(DIM)).astype(np.int64)] += np.where((some >> np.uint64(6)) & np.uint64(1), 1, -1).astype(np.int16)
    return out


class Units:
    """Rows and index vectors of words, remembered."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.form, self.look, self.index = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros((1024, DIM), np.int16)
        self.looks: dict[str, int] = {}
        self.look_rows, self.look_index = np.zeros(0, np.int32), np.zeros((0, DIM), np.int16)
        self.same = index_vectors([SAME_KEY])[0]

    def learn(self, words: list[str]) -> None:
        """Remembers these different new words."""
        begin = len(self.slots)
        end = begin + len(words)
        if end > len(self.form):
            room = max(end, 2 * len(self.form))
            self.form, self.look, self.index = (np.concatenate([x, np.zeros((room - len(x), *x.shape[1:]), x.dtype)]) for x in (self.form, self.look, self.index))
        forms, looks = [form(w).encode() for w in words], list(map(shape, words))
        unseen = list(set(looks).difference(self.looks))
        self.looks.update(zip(unseen, range(len(self.looks), len(self.looks) + len(unseen))))
        keys = [b"\x00" + f.encode() for f in unseen]
        self.look_rows = np.concatenate([self.look_rows, np.array([BUCKETS + zlib.crc32(k) % SHAPES for k in keys], np.int32)])
        self.look_index = np.concatenate([self.look_index, index_vectors(keys)])
        self.form[begin:end] = np.fromiter(map(zlib.crc32, forms), np.int64, len(forms)) % BUCKETS
        self.look[begin:end] = list(map(self.looks.__getitem__, looks))
        self.index[begin:end] = index_vectors(forms)
        self.slots.update(zip(words, range(begin, end)))

    def batches(self, some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of texts: the number of words of each, each word's slot, and where a word repeats the one before in its text.
        A text of more words than SLICE is alone in its run."""
        i = 0
        while i < len(some):
            lists, held = [], 0
            while i < len(some) and (not held or held + len(some[i]) // 4 < SLICE):
                lists.append(some[i].split())
                held += len(lists[-1])
                i += 1
            words = [w for own in lists for w in own]
            new = set(words).difference(self.slots)
            if new and len(self.slots) > CACHE_WORDS:
                self.__init__()
                new = set(words)
            if new:
                self.learn(list(new))
            slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
            kind = self.form[slots].astype(np.int64) << 32 | self.look[slots]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            same = np.zeros(len(slots), bool)
            same[1:] = kind[1:] == kind[:-1]
            same[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
            yield sizes, slots, same


def contexts(sizes: np.ndarray, slots: np.ndarray, same: np.ndarray, units: Units) -> np.ndarray:
    """For each word the sum of the index vectors around it, in its own text."""
    own = units.index.take(slots, axis=0, mode="clip")
    own += units.look_index.take(units.look[slots], axis=0, mode="clip")
    own[same] += units.same
    at = np.arange(WINDOW, len(slots) + WINDOW) + np.repeat(np.arange(len(sizes)) * WINDOW, sizes)  # gaps between texts
    wide = np.zeros((len(slots) + WINDOW * (len(sizes) + 1), DIM), np.int16)
    wide[at] = own
    around = np.zeros_like(wide)
    for k in range(1, WINDOW + 1):
        around[k:] += wide[:-k]
        around[:-k] += wide[k:]
    return around.take(at, axis=0, mode="clip")


def added_up(sums: np.ndarray, sizes: np.ndarray, slots: np.ndarray, same: np.ndarray, units: Units) -> None:
    """Adds the context vectors of these words to sums, DIM x UNITS."""
    around = np.ascontiguousarray(contexts(sizes, slots, same, units).T)
    rows, looks = np.unique(units.form[slots], return_inverse=True), units.look[slots]
    for d in range(DIM):
        weights = around[d].astype(np.float64)
        sums[d, rows[0]] += np.bincount(rows[1], weights=weights)
        of_looks = np.bincount(looks, weights=weights, minlength=len(units.looks))
        sums[d, BUCKETS:SAME] += np.bincount(units.look_rows - BUCKETS, weights=of_looks, minlength=SHAPES)
    sums[:, SAME] += around[:, same].sum(axis=1)


@dataclass
class Bags:
    """What texts hold, without the order of their words: all that their numbers need beside the context vectors.

    words: how many each has; forms: the words' buckets, one text after another; looks, times: shapes' rows and how often,
    kinds of them for each text; own: the sums of the words' index vectors and of the shapes'; same: repetitions.
    """

    words: np.ndarray
    forms: np.ndarray
    looks: np.ndarray
    times: np.ndarray
    kinds: np.ndarray
    own: np.ndarray
    same: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, slots: np.ndarray, same: np.ndarray, units: Units) -> Bags:
        many, which = max(1, len(units.looks)), np.repeat(np.arange(len(sizes)), sizes)
        pair, times = np.unique(which * many + units.look[slots], return_counts=True)
        text, look = pair // many, pair % many
        own, full = np.zeros((len(sizes), 2 * DIM), np.int64), np.flatnonzero(sizes)
        if len(full):
            own[full, :DIM] = np.add.reduceat(units.index.take(slots, axis=0, mode="clip"), (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.int64)
            own[full, DIM:] = np.add.reduceat(units.look_index[look] * times[:, None], np.searchsorted(text, full), axis=0)
        kinds = np.bincount(text, minlength=len(sizes))
        return cls(sizes, units.form[slots].astype("<u2"), (units.look_rows[look] - BUCKETS).astype("<u2"), times.astype("<i4"), kinds, own, np.bincount(which[same], minlength=len(sizes)))

    def columns(self) -> list[pa.Array]:
        """As the columns words, same, forms, looks, times, own of a row each."""
        cut = lambda x, n: [x[z - k : z].tobytes() for k, z in zip(n.tolist(), np.cumsum(n).tolist())]
        own = [x.tobytes() for x in self.own.astype("<i8")]
        parts = (cut(self.forms, self.words), cut(self.looks, self.kinds), cut(self.times, self.kinds), own)
        return [pa.array(self.words, pa.int64()), pa.array(self.same, pa.int64()), *(pa.array(x, pa.binary()) for x in parts)]

    @classmethod
    def read(cls, columns: list[pa.Array]) -> Bags:
        words, same = (c.to_numpy(zero_copy_only=False) for c in columns[:2])
        forms, looks, times, own = (np.frombuffer(b"".join(c.to_pylist()), k) for c, k in zip(columns[2:], ("<u2", "<u2", "<i4", "<i8")))
        kinds = np.fromiter((len(x) // 2 for x in columns[3].to_pylist()), np.int64, len(words))
        return cls(words, forms, looks, times, kinds, own.reshape(-1, 2 * DIM), same)

    def numbers(self, vectors: np.ndarray) -> np.ndarray:
        """2 * DIM numbers a text: the mean of the words' vectors, and of the shapes' with repetition."""
        x, full = np.zeros((len(self.words), 2 * DIM)), np.flatnonzero(self.words)
        if len(full):
            scale = 1 / np.sqrt(NONZERO)
            x += self.own * scale
            begin = lambda n: (np.cumsum(n) - n)[full]
            x[full, :DIM] += np.add.reduceat(vectors.take(self.forms, axis=0, mode="clip"), begin(self.words), axis=0)
            x[full, DIM:] += np.add.reduceat(vectors[BUCKETS + self.looks.astype(np.int64)] * self.times[:, None], begin(self.kinds), axis=0)
            x[:, DIM:] += self.same[:, None] * 3.0 * (vectors[SAME] + index_vectors([SAME_KEY])[0] * scale)
            x[full] /= self.words[full, None]
        return x.astype(np.float32)


BAG = "words long, same long, forms binary, looks binary, times binary, own binary"
BAG_NAMES = [c.split()[0] for c in BAG.split(", ")]


def tallied(docs: DataFrame, bags: bool) -> DataFrame:
    """A written table: rows with a block are partial sums of context vectors (part: the task), the others, if asked for, the
    bags of all documents. Each text is split once."""
    bounded_batches(docs.sparkSession)
    sums_schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("v", pa.binary()), ("doc_id", pa.int64())])
    schema = pa.schema([*sums_schema, *((c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in BAG.split(", "))])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_heap()
        units, sums, part = Units(), np.zeros((DIM, UNITS)), TaskContext.get().partitionId()
        for b in batches:
            at = 0
            for sizes, slots, same in units.batches(b.column(1).to_pylist()):
                if len(slots):
                    added_up(sums, sizes, slots, same, units)
                if bags:
                    none = [pa.nulls(len(sizes), f.type) for f in list(sums_schema)[:-1]]
                    yield pa.RecordBatch.from_arrays([*none, b.column(0).slice(at, len(sizes)), *Bags.of(sizes, slots, same, units).columns()], schema=schema)
                at += len(sizes)
        whole = sums.T.astype(np.int64)
        met = np.flatnonzero(np.abs(whole).sum(axis=1))
        for block in np.unique(met // BLOCK).tolist():
            at = met[met // BLOCK == block]
            row = [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([whole[at].astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*row, *(pa.nulls(1, f.type) for f in list(schema)[4:])], schema=schema)

    return written(texts(docs).mapInArrow(run, f"block int, part int, at binary, v binary, doc_id long, {BAG}"), "quality-tally")


def word_vectors(docs: DataFrame, tally: DataFrame | None = None) -> np.ndarray:
    """UNITS x DIM context vectors, of length 1 or 0: random indexing over all documents. A table of fixed size reaches the driver.

    Partial sums of FAN tasks at most meet in one group, then those of FAN such groups, until one is left, so no task grows with the table.
    """

    def added(key, rows):
        out = np.zeros((BLOCK, DIM), np.int64)
        for at, v in zip(*(rows.column(c) for c in ("at", "v"))):
            out[np.frombuffer(at.as_buffer(), "<i4") % BLOCK] += np.frombuffer(v.as_buffer(), "<i8").reshape(-1, DIM)
        met = np.flatnonzero(np.abs(out).sum(axis=1))
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (met.astype("<i4"), out[met])]
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + binary, names=["block", "part", "at", "v"])

    own = tally if tally is not None else tallied(docs, bags=False)
    parts = own.where("block is not null").select("block", "part", "at", "v")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(added, "block int, part int, at binary, v binary")
        left = -(-left // FAN)
        if left == 1:
            break
    out = np.zeros((-(-UNITS // BLOCK) * BLOCK, DIM))
    for row in parts.collect():  # the units, in blocks
        out[row.block * BLOCK + np.frombuffer(row.at, "<i4")] = np.frombuffer(row.v, "<i8").reshape(-1, DIM)
    if tally is None:
        forget(own)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)[:UNITS]


def pooled(some: list[str], vectors: np.ndarray, units: Units) -> np.ndarray:
    """The numbers of texts, 2 * DIM each."""
    return np.concatenate([np.zeros((0, 2 * DIM), np.float32)] + [Bags.of(*got, units).numbers(vectors) for got in units.batches(some)])


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 11) -> Network:
    """Adam on weighted log loss; every fifth row is kept out for the temperature."""
    r = np.random.default_rng(seed)
    out = np.arange(len(x)) % 5 == 4 if len(x) >= 20 else np.zeros(len(x), bool)
    xt, yt, wt = x[~out], y[~out], weight[~out] / weight[~out].mean()
    net = Network(xt.mean(axis=0), xt.std(axis=0) + 1e-4, r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = (xt - net.mean) / net.spread
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(z))
        for i in range(0, len(order), 128):
            at = order[i : i + 128]
            h = np.tanh(z[at] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
            d = wt[at] * (p - yt[at]) / len(at)
            dh = d[:, None] * net.w2 * (1 - h * h)
            grads = [z[at].T @ dh + 1e-4 * net.w1, dh.sum(axis=0), h.T @ d + 1e-4 * net.w2, np.array([d.sum()])]
            step += 1
            moves = []
            for g, s in zip(grads, state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                moves.append(0.003 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    held = out if out.any() else ~out
    logits, yh, wh = net.logits(x[held]), y[held], weight[held]

    def loss(t: float) -> float:
        return float((wh * np.logaddexp(0, np.where(yh == 1, -logits, logits) / t)).sum())

    net.temperature = min((0.5 * 1.1**k for k in range(40)), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, trained: Column, label: str = "quality", per_class: int = PER_CLASS, tally: DataFrame | None = None) -> tuple[np.ndarray, Network]:
    """The context vectors over all documents and the network. tally: what tallied() wrote of docs, if it is there."""
    vectors = word_vectors(docs, tally)
    sample, totals = labelled_sample(docs, labels, label, trained, per_class)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(pooled(b.column(0).to_pylist(), vectors, units)), pa.list_(pa.float32())), b.column(1), b.column(2)], names=["x", "label", "doc_id"])

    rows = sorted(written(sample.mapInArrow(run, "x array<float>, label int, doc_id long"), "quality-sample").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))  # 2 * per_class at most
    y = np.array([r.label for r in rows], float)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not 0 < y.sum() < len(y):
        zero = np.zeros(2 * DIM)
        return vectors, Network(zero, zero + 1, np.zeros((2 * DIM, 1)), np.zeros(1), np.zeros(1), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    x = np.array([r.x for r in rows], np.float64)
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    return vectors, train(x, y, weight)


def quality(docs: DataFrame, vectors: np.ndarray, network: Network, keep: Callable[[float], bool] | None = None, tally: DataFrame | None = None) -> DataFrame:
    """doc_id, score of every row; with keep, the rows of docs, all columns, whose score it accepts. With the
    bags of tallied() texts are not split again."""
    bounded_batches(docs.sparkSession)
    if keep:

        def scores():
            keep_heap()
            units = Units()
            return lambda some: network.probability(pooled(some, vectors, units)).tolist()

        return filtered(docs, scores, keep)

    if tally is not None:

        @giving_back
        def of_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_heap()
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.probability(Bags.read(b.columns[1:]).numbers(vectors)), pa.float64())], names=["doc_id", "score"])

        return tally.where("block is null").select("doc_id", *BAG_NAMES).mapInArrow(of_bags, "doc_id long, score double")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        units = Units()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.probability(pooled(b.column(1).to_pylist(), vectors, units)), pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")
