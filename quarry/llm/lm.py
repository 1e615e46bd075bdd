"""Operator 1: language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The words before, weighted by position, add up to h = sum c_j * r(w_j), CONTEXT words at most. A word is a
leaf of a tree of three levels with equal fan-out, and each step down the tree is log-bilinear:
p(child | h) is proportional to exp(h . q(child) + b(child)) among the children of one node. So a
probability is normalised exactly over the whole vocabulary by three short products.

Leaves are the end, the HEAD most frequent words, each with vectors of its own, and, where there are more words than
these, TAILS leaves that the others share by hash. In a shared leaf a word has its add-one share by its exact
count, which is joined, and one place is left to any unseen word: every text has a proper probability.

Training is noise-contrastive at each step down: on the first level against FIRST children drawn by
their share, below against NOISE siblings drawn evenly (the same turn of the sibling circle for a whole step). Documents are dealt by a hash of key and text to groups of about GROUP
tokens (fewer where a corpus is small, for four at least), sorted in each; every group trains its own copy from the same start over all its tokens. Copies
are averaged row by row, weighted by how often each met a row, so the model depends on
the table alone and not on how its rows are partitioned.

Texts are split twice, to be counted and to become ids; training and scoring read the stored ids.

Defined results: null and empty texts are the end alone; without training rows N and V are 0, the base
of each token is log10(1 / 1) = 0 and the model is its start; repeated rows each give a row; extra columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import word_ids
from quarry.llm.common import bounded_batches, forget, keep_heap, written

#: Fan-out at most, words with a leaf of their own at most, shared leaves, numbers a vector with the constant, words before.
FAN, TAILS, DIM, CONTEXT = 48, 1024, 16, 5
HEAD = FAN**3 - TAILS - 1
STEP, FIRST, NOISE, RATE, HELD_WORDS = 8192, 16, 2, 0.15, 400_000
#: Tokens of a training group, groups at most, positions scored at once, rows of an averaged block.
GROUP, GROUPS, CHUNK, BLOCK = 3_000_000, 1024, 131_072, 4096
#: Bytes of texts that are split at once: several numbers a byte then stay in a core's cache.
CACHED = 1 << 20
END, NEVER = 0, -30.0
LOG10 = np.log(10.0)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over texts: counted in each partition first, a bounded number of different words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        counts: dict[bytes, int] = {}

        def flush():
            words = list(counts)
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in some], pa.int64())], names=["word", "c"])
            counts.clear()

        for b in batches:
            for _, ids, words in word_ids(b.column(0), most=CACHED):
                for w, c in zip(words, np.bincount(ids, minlength=len(words)).tolist()):
                    counts[w] = counts.get(w, 0) + c
                if len(counts) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tail_leaf(word: bytes, tails: int) -> int:
    return 1 + zlib.crc32(word) % tails


@dataclass
class Vocabulary:
    total: int  # N
    different: int  # V
    words: dict  # head word to leaf
    weight: np.ndarray  # of each leaf: occurrences and places, add-one
    logs: np.ndarray  # log10(c + 1) of each leaf that is a word or the end, else 0
    tails: int
    fan: int

    @property
    def rest(self) -> np.ndarray:
        """log10 of the weight of shared leaves, 0 of others: what their words' shares are of."""
        out = np.zeros(len(self.weight))
        out[1 : 1 + self.tails] = np.log10(self.weight[1 : 1 + self.tails])
        return out


def head_words(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], Column | None]:
    """The most frequent words (word, c), most first, `most` at most; and which rows they are, None for all.

    They are whole bands of like frequency, and of the band that fits no more a part chosen by hash, so no task
    sends the driver more than its share.
    """
    band = F.when(F.col("c") < 1000, F.col("c")).otherwise(F.floor(F.log("c") * 200))  # some thousand bands whatever the counts
    room, cut, part = most, 0, 0
    for r in sorted(counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.band):
        if r.n > room:
            cut, part = r.band, int(2**32 * max(0.0, room - 5 * room**0.5) / r.n)  # five deviations under the room
            break
        room -= r.n
    mine = (band > cut) | ((band == cut) & (F.crc32(F.col("word").cast("binary")) < part)) if cut else None
    found = (counts if mine is None else counts.where(mine)).toArrow()
    return sorted(zip(found.column("word").cast(pa.binary()).to_pylist(), found.column("c").to_pylist()), key=lambda r: (-r[1], r[0])), mine


def vocabulary(counts: DataFrame, rows: int) -> Vocabulary:
    """From the word counts and the number of training texts (each has an end)."""
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    total, different = int(whole[0] or 0) + rows, int(whole[1]) + (rows > 0)
    head, mine = head_words(counts, HEAD)
    tails = TAILS if len(head) < different - (rows > 0) else 1
    fan = next(f for f in range(4, FAN + 1) if f**3 >= 1 + tails + len(head))
    weight, logs = np.zeros(1 + tails + len(head)), np.zeros(1 + tails + len(head))
    weight[0], weight[1 : 1 + tails] = rows + 1, 1.0
    weight[1 + tails :] = [c + 1 for _, c in head]
    logs[weight > 0] = np.log10(weight[weight > 0])
    logs[1 : 1 + tails] = 0.0
    if mine is not None:
        leaf = F.crc32(F.col("word").cast("binary")) % tails
        for r in counts.where(~mine).groupBy(leaf.alias("leaf")).agg(F.sum(F.col("c") + 1).alias("w")).collect():  # TAILS rows at most
            weight[1 + r.leaf] += r.w
    return Vocabulary(total, different, {w: i for i, (w, _) in enumerate(head, 1 + tails)}, weight, logs, tails, fan)


def packed(ids: np.ndarray) -> bytes:
    """Leaf ids as three planes of bytes."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    p = np.frombuffer(planes, np.uint8).reshape(3, -1).astype(np.int32)
    return p[0] | p[1] << 8 | p[2] << 16


class LogBilinear:
    """Parameters, training and scoring in numpy. The last number of a vector is the constant's: h ends with 1."""

    def __init__(self, weight: np.ndarray, fan: int):
        self.fan, n = fan, fan**3
        full = np.zeros(n)
        full[: len(weight)] = weight
        g = np.random.default_rng(5)
        self.r = g.normal(0, 1 / np.sqrt(DIM), (n, DIM)).astype(np.float32)
        self.r[:, -1] = 0
        self.c = np.ones((CONTEXT, DIM), np.float32)
        self.q = []
        for level in (1, 2, 3):
            own = full.reshape(fan**level, -1).sum(axis=1)
            above = np.repeat(own.reshape(-1, fan).sum(axis=1), fan)
            q = np.zeros((fan**level, DIM), np.float32)
            q[:, -1] = np.where(own > 0, np.log(np.maximum(own, 1e-300) / np.maximum(above, 1e-300)), NEVER)
            self.q.append(q)
        self.share = np.exp(self.q[0][:, -1].astype(np.float64))
        self.edges = np.cumsum(self.share)

    def tables(self) -> list[np.ndarray]:
        return [self.r, self.c, *self.q]

    def contexts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of ids, and h of every position from CONTEXT on."""
        rows, n = picked(self.r, ids), len(ids) - CONTEXT
        h = self.c[0] * rows[CONTEXT - 1 : CONTEXT - 1 + n]
        for j in range(1, CONTEXT):
            h += self.c[j] * rows[CONTEXT - 1 - j : CONTEXT - 1 - j + n]
        h[:, -1] = 1
        return rows, h

    def begin(self) -> None:
        self.squares = [np.full(len(x), 1e-2, np.float32) for x in self.tables()]
        self.met = [np.zeros(len(x), np.float32) for x in self.tables()]
        self.start = [x.copy() for x in self.tables()]

    def move(self, k: int, rows: np.ndarray, grad: np.ndarray, times: np.ndarray | float, rate: float = RATE) -> None:
        """A step of Adagrad, with one sum of squares a row, on some rows of a table, each once."""
        table, s = self.tables()[k], picked(self.squares[k], rows)
        s += np.einsum("ij,ij->i", grad, grad) / DIM
        self.squares[k][rows] = s
        step = grad * (rate / np.sqrt(s))[:, None]
        step += picked(table, rows)
        table[rows] = step
        self.met[k][rows] += times

    def learn(self, ids: np.ndarray, own: np.ndarray, g: np.random.Generator) -> None:
        """One step on a run of leaves; own: which positions from CONTEXT on are targets."""
        fan, n = self.fan, len(ids) - CONTEXT
        rows, h = self.contexts(ids)
        at = np.flatnonzero(own)
        at = at[np.argsort(ids[CONTEXT:][at])]  # sorted, so that equal leaves lie together on every level
        t, h = ids[CONTEXT:][at], picked(h, at)
        scale, shift = np.float32(1 / 64), np.float32(np.log(NOISE / (fan - 1)))
        # first level: noise drawn by share, the same for the whole step
        a = t // fan**2
        level1 = self.q[0].copy()
        level1[:, -1] -= np.log(FIRST * np.maximum(self.share, 1e-13)).astype(np.float32)
        drawn = np.minimum(np.searchsorted(self.edges, g.random(FIRST)), fan - 1)
        own = picked(level1, a)
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", own, h)))
        down = -1 / (1 + np.exp(h @ -level1[drawn].T))
        own[:, -1] = self.q[0][a, -1]
        dh = up[:, None] * own + down @ self.q[0][drawn]
        first = np.zeros_like(self.q[0])
        np.add.at(first, drawn, down.T @ h)
        begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(a)]):
            first[a[lo]] += up[lo:hi] @ h[lo:hi]
        first *= scale
        # below: the child itself and siblings a turn of the circle away
        edge = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        leaves, spread = t[edge], np.diff(np.r_[edge, len(t)])
        turns = np.r_[0, 1 + g.permutation(fan - 1)[:NOISE]]
        sought = []
        for leaf in (leaves // fan, leaves):
            sought.append((leaf // fan * fan)[:, None] + (leaf[:, None] + turns) % fan)
        wide = np.concatenate([picked(self.q[level], rows_) for level, rows_ in zip((1, 2), sought)], axis=1)
        v = picked(wide, np.repeat(np.arange(len(edge)), spread))  # of each target: its own and its siblings' vectors on both levels
        x = np.einsum("nkd,nd->nk", v, h)
        x -= shift
        kind = np.tile(np.r_[1, np.full(NOISE, -1)].astype(np.float32), 2)
        u = kind / (1 + np.exp(x * kind))
        dh += np.einsum("nk,nkd->nd", u, v)
        np.multiply(u[:, :, None], h[:, None, :], out=v)
        grads = summed(v.reshape(len(t), -1), edge, spread).reshape(len(edge), 2, 1 + NOISE, DIM) * scale
        dh[:, -1] = 0
        back = np.zeros((n, DIM), np.float32)
        back[at] = dh
        drow, gc = np.zeros_like(rows), np.empty_like(self.c)
        for j in range(CONTEXT):
            to = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + n)
            gc[j] = np.einsum("ij,ij->j", back, rows[to]) * scale
            drow[to] += self.c[j] * back
        drow = picked(drow[CONTEXT:], at)
        self.move(0, leaves, summed(drow, edge, spread) * scale, spread)
        self.move(1, np.arange(CONTEXT), gc, n, RATE * 0.2)
        self.move(2, np.arange(fan), first, n)
        upper = np.flatnonzero(np.r_[True, sought[0][1:, 0] != sought[0][:-1, 0]])
        times = np.add.reduceat(spread, upper)
        sums = summed(grads[:, 0].reshape(len(edge), -1), upper, np.diff(np.r_[upper, len(edge)])).reshape(len(upper), 1 + NOISE, DIM)
        for k in range(1 + NOISE):
            self.move(3, sought[0][upper, k], sums[:, k], times)
            self.move(4, sought[1][:, k], grads[:, 1, k], spread)

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """log p of every leaf from CONTEXT on, normalised on every level."""
        fan, out = self.fan, np.empty(max(0, len(ids) - CONTEXT), np.float64)
        room, ones = np.empty((STEP, fan), np.float32), np.ones(fan, np.float32)
        for i in range(0, len(out), CHUNK):
            part = ids[i : i + CHUNK + CONTEXT]
            every = part[CONTEXT:]
            order = np.argsort(every)
            t, h = every[order], picked(self.contexts(part)[1], order)
            whole = np.zeros(len(t))
            for level in (0, 1, 2):
                child = t // fan ** (2 - level)
                node, place = child // fan, child % fan
                starts = np.r_[True, node[1:] != node[:-1]]
                starts[::STEP] = True  # tiles that stay in the cache
                edge = [*np.flatnonzero(starts).tolist(), len(t)]
                turned, tile = np.ascontiguousarray(self.q[level].reshape(-1, fan, DIM).transpose(0, 2, 1)), 0
                for lo, hi in zip(edge, edge[1:]):
                    np.matmul(h[lo:hi], turned[node[lo]], out=room[lo - tile : hi - tile])
                    if hi == tile + STEP or hi == len(t):
                        s = room[: hi - tile]
                        own = s[np.arange(len(s)), place[tile:hi]].astype(np.float64)
                        if (top := s.max()) > 60:  # else no exp is too large
                            own -= top
                            s -= top
                        np.exp(s, out=s)
                        whole[tile:hi] += own - np.log(np.maximum(s @ ones, 1e-37))
                        tile = hi
            out[i + order] = whole
        return out


def picked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at]: quicker without the bounds check, every place is inside."""
    return np.take(table, at, axis=0, mode="clip")


def summed(rows: np.ndarray, edge: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The sum of each run of rows: the first of all runs, the second of those that have one, and so on; what is left of long runs at once."""
    out, most = picked(rows, edge), 4
    for k in range(1, most):
        more = np.flatnonzero(spread > k)
        out[more] += picked(rows, edge[more] + k)
    more = np.flatnonzero(spread > most)
    if len(more):
        bounds = np.stack([edge[more] + most, edge[more] + spread[more]], axis=1).ravel()
        out[more] += np.add.reduceat(rows, bounds[:-1] if bounds[-1] == len(rows) else bounds, axis=0)[::2]
    return out


def runs(texts: Iterator[np.ndarray], most: int = 4 * STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf sequences of several texts, each with CONTEXT ends before it, and which positions count."""
    pad, none, held = np.full(CONTEXT, END, np.int32), np.zeros(CONTEXT, np.float32), 0
    ids: list[np.ndarray] = []
    own: list[np.ndarray] = []
    for text in texts:
        ids += [pad, text]
        own += [none, np.ones(len(text), np.float32)]
        held += CONTEXT + len(text)
        if held >= most:
            a, b = np.concatenate(ids), np.concatenate(own)
            i = 0
            while len(a) - i >= most:
                yield a[i : i + most], b[i + CONTEXT : i + most]
                i += most - CONTEXT
            ids, own, held = [a[i:]], [b[i:]], len(a) - i
    if held > CONTEXT:
        a = np.concatenate(ids)
        yield a, np.concatenate(own)[CONTEXT:]


DELTAS = pa.schema([("k", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("met", pa.binary()), ("v", pa.binary())])


def train(parts: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """One pass over the stored ids of all training rows: a copy for each group, averaged by rows."""
    weight, fan = vocab.weight, vocab.fan
    groups = int(max(1, min(GROUPS, max(vocab.total // GROUP, min(4, vocab.total // (GROUP // 4))))))
    step = int(min(STEP, max(512, vocab.total / groups / 400)))  # some hundred steps a group where there are few tokens
    dealt = parts.where("trained").select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(groups)).cast("int").alias("g"), "doc_id", "ids")
    model = LogBilinear(weight, fan)
    for some, parts_ in ((F.col("g") == 0, 1), (F.col("g") > 0, groups - 1))[: 1 + (groups > 1)]:
        own = dealt.where(some).repartition(parts_, "g").sortWithinPartitions("g", "doc_id", "ids")
        for row in copies_of(own, model, step).collect():  # the model's size, bounded by FAN
            model.tables()[row.k][np.frombuffer(row.at, "<u4")] += np.frombuffer(row.v, "<f4").reshape(-1, DIM)
    return model


def copies_of(dealt: DataFrame, start: LogBilinear, step: int) -> DataFrame:
    """What the groups' copies, each from this start, move the rows by on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        model, now, g, waiting = None, None, None, []

        def learned(texts) -> None:
            for ids, own in runs(texts):
                for i in range(0, len(own), step):
                    model.learn(ids[i : i + step + CONTEXT], own[i : i + step], g)

        def finished() -> Iterator[pa.RecordBatch]:
            learned(waiting)
            for k, (x, x0, met) in enumerate(zip(model.tables(), model.start, model.met)):
                touched = np.flatnonzero(met)
                for part in np.unique(touched // BLOCK).tolist():
                    at = touched[touched // BLOCK == part]
                    row = {"k": k, "part": part, "at": at.astype("<u4").tobytes(), "met": met[at].astype("<f4").tobytes(), "v": (x[at] - x0[at]).astype("<f2").tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=DELTAS)

        for b in batches:
            for group, planes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if group != now:
                    if model:
                        yield from finished()
                    now, g, model, waiting = group, np.random.default_rng(9), copy.deepcopy(start), []
                    model.begin()
                waiting.append(unpacked(planes))
                if sum(map(len, waiting[-1:])) >= STEP or len(waiting) >= 256:
                    learned(waiting)
                    waiting = []
        if model:
            yield from finished()

    def averaged(key, block):
        k, part = key[0].as_py(), key[1].as_py()
        n, v = np.zeros(BLOCK), np.zeros((BLOCK, DIM))
        rows = sorted(block.select(["at", "met", "v"]).to_pylist(), key=lambda r: (r["at"], r["met"], r["v"]))
        for r in rows:
            at, met = np.frombuffer(r["at"], "<u4") - part * BLOCK, np.frombuffer(r["met"], "<f4").astype(np.float64)
            n[at] += met
            v[at] += np.frombuffer(r["v"], "<f2").reshape(-1, DIM) * met[:, None]
        at = np.flatnonzero(n)
        mean = (v[at] / n[at][:, None]).astype("<f4")
        return pa.Table.from_pylist([{"k": k, "part": part, "at": (at + part * BLOCK).astype("<u4").tobytes(), "met": b"", "v": mean.tobytes()}], schema=DELTAS)

    copies = dealt.select("g", "ids").mapInArrow(run, "k int, part int, at binary, met binary, v binary")
    return copies.groupBy("k", "part").applyInArrow(averaged, "k int, part int, at binary, met binary, v binary")


def encoded(docs: DataFrame, vocab: Vocabulary, ends: int) -> DataFrame:
    """doc_id, trained, n_tokens, n_known and base (both of head words and the end), ids, tail (words without a leaf of their own)."""
    words, logs, tails = vocab.words, vocab.logs, vocab.tails
    kind = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("ids", pa.binary()), ("tail", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        get = words.get
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for sizes, local, some in word_ids(b.column(2), most=CACHED):
                leaf = np.fromiter(map(get, some, repeat(-1)), np.int32, len(some))
                new = np.flatnonzero(leaf < 0)
                unknown = np.zeros(len(some), bool)
                unknown[new] = True
                leaf[new] = [tail_leaf(some[i], tails) for i in new.tolist()]
                stop = 0
                for n in sizes.tolist():
                    own = local[stop : stop + n]
                    stop += n
                    ids = np.append(leaf[own], np.int32(END))
                    tail = [some[i] for i in own[unknown[own]].tolist()]
                    for o, x in zip(out, (n + 1, n - len(tail) + (ends > 0), float(logs[ids].sum()), packed(ids), tail)):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(o, t) for o, t in zip(out[:4], (pa.int64(), pa.int64(), pa.float64(), pa.binary()))), pa.array(out[4], pa.list_(pa.binary())).cast(pa.list_(pa.string()))], schema=kind)

    return docs.select("doc_id", "trained", "text").mapInArrow(run, "doc_id long, trained boolean, n_tokens long, n_known long, base double, ids binary, tail array<string>")


def score(docs: DataFrame, trained: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; trained: which rows teach."""
    bounded_batches(docs.sparkSession)
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    teaching = both.where("trained")
    counts = written(count_words(teaching), "word-counts")
    ends = teaching.count()
    vocab = vocabulary(counts, ends)
    parts = encoded(both, vocab, ends).withColumn("rid", F.monotonically_increasing_id())
    parts = written(parts, "lm-parts")
    model = train(parts, vocab)
    share = float(np.log10(vocab.total + vocab.different + 1))
    tail = parts.select("rid", F.explode("tail").alias("word")).join(counts, "word")
    found = written(tail.groupBy("rid").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("more")), "lm-tail")
    forget(counts)
    rest = vocab.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        pad = np.full(CONTEXT, END, np.int32)
        for b in batches:
            texts = [unpacked(x) for x in b.column("ids").to_pylist()]
            scores: list[float] = []
            waiting: list[np.ndarray] = []

            def judged() -> None:
                ids = np.concatenate([x for t in waiting for x in (pad, t)])
                logs = np.concatenate([np.zeros(CONTEXT), model.log_probabilities(ids) / LOG10]) - rest[ids]
                stops = np.cumsum([CONTEXT + len(t) for t in waiting])
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                scores.extend((sums[stops] - sums[stops - [len(t) for t in waiting]]).tolist())

            held = 0
            for t in texts:
                waiting.append(t)
                held += len(t)
                if held >= CHUNK:
                    judged()
                    waiting, held = [], 0
            if waiting:
                judged()
            names = ["rid", "doc_id", "n_tokens", "n_known", "base"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    scored = parts.select("rid", "doc_id", "n_tokens", "n_known", "base", "ids").mapInArrow(run, "rid long, doc_id long, n_tokens long, n_known long, base double, score double")
    zero = F.lit(0.0)
    return scored.join(found, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero) - F.col("n_tokens") * share).alias("base_score"), (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )
