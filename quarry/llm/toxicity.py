"""Operator 2: toxicity by maximum-scoring segments of token log-odds.

Words and their beginnings are weighed by the log-odds of toxic against clean documents under an
informative Dirichlet prior; those that stand out (by their z-score) form the lexicon, all of them. A text is a
sequence of scores: a word that stands out, in toxic or in clean text, has its own log-odds, any other a small loss
(its log-odds cannot be told from zero), which clean words have at least. One linear scan finds all
maximal-scoring segments. A segment's score is judged by extreme-value statistics: in n words of clean
text, K n exp(-lambda S) segments of score S or more are expected; lambda solves
sum p exp(lambda s) = 1 over clean words, K matches the rate in clean training documents. Segments
with an expectation under 0.05 are the significant passages; a text's evidence is the sum of
their -log expectations, which a logistic curve turns into a probability.

The classifier is fitted on a sample of at most PER_CLASS training documents of each label.

Defined results: null and empty texts have no evidence and the lowest score; without a toxic or a clean
training row no word stands out and every score is the share of toxic rows; repeated rows each
give a row; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, filtered, texts, written
from quarry.llm.labelled import labelled_sample, logistic

PER_CLASS = 5000
LEAST_Z, PRIOR, SIGNIFICANT = 2.5, 50.0, 0.05
BEGINNINGS = (4, 5, 6)
CACHE_WORDS = 300_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(word: str) -> tuple[str, ...]:
    """The word in lower case without punctuation around it, and its beginnings."""
    w = word.lower().strip(EDGES)
    return (w, *(w[:n] + "~" for n in BEGINNINGS if len(w) > n)) if w else ()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, one past the end, score) of a sequence of scores, in linear time.

    Each candidate keeps which one before it begins lower; the search for such a one follows these links, and a
    candidate that is passed over is never looked at again by those that pass it.
    """
    start, stop, left, right, lower = [], [], [], [], []
    after = 0.0
    for at, score in enumerate(scores):
        before, after = after, after + score
        if score <= 0:
            continue
        begin, j = at, len(start) - 1
        while j >= 0 and left[j] >= before:
            j = lower[j]
        while j >= 0 and right[j] < after:  # it begins lower and ends lower: one segment from its start
            begin, before, k = start[j], left[j], j
            j = lower[j]
            for x in (start, stop, left, right, lower):
                del x[k:]
        for x, v in zip((start, stop, left, right, lower), (begin, at + 1, before, after, j)):
            x.append(v)
    return [(a, b, r - low) for a, b, low, r in zip(start, stop, left, right)]


@dataclass
class Model:
    lexicon: dict[str, float]
    clean: dict[str, float] = field(default_factory=dict)  # words that stand out in clean text: negative scores
    loss: float = 0.05
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    curve: tuple[float, float] = (0.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        some = features(word)
        best = max((self.lexicon.get(f, 0.0) for f in some), default=0.0)
        return best if best > 0 else min(-self.loss, self.clean.get(some[0], 0.0) if some else 0.0)

    def scores(self, text: str) -> list[float]:
        words, cache = text.split(), self.cache
        scores = list(map(cache.get, words))
        if None in scores:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for i, s in enumerate(scores):
                if s is None:
                    scores[i] = cache[words[i]] = self.word(words[i])
        return scores

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the segments."""
        scores = self.scores(text)
        return len(scores), segments(scores) if scores and max(scores) > 0 else []

    def expected(self, n: int, score: float) -> float:
        """log of how many segments of this score or more are expected in n words of clean text."""
        return math.log(self.scale * n) - self.rate * score

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
        n, found = self.scan(text)
        judged = [(a, b, s, self.expected(n, s)) for a, b, s in found]
        passages = [x for x in judged if x[3] < math.log(SIGNIFICANT)]
        return math.log1p(sum(-x[3] for x in passages)), [(a, b, s, math.exp(max(-700.0, e))) for a, b, s, e in passages]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] * evidence + self.curve[1]))))


def fit(docs: DataFrame, labels: DataFrame, trained: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    bounded_batches(docs.sparkSession)
    sample, totals = labelled_sample(docs, labels, label, trained, per_class)
    sample = written(sample, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = set()
                words = text.split()
                for w in set(words):
                    own.update(features(w))
                by[y].update(own)
                by[y][""] += 1
                by[y]["\t"] += len(words)
        keys = list(by[0].keys() | by[1].keys())
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([by[0][k] for k in some], pa.int64()), pa.array([by[1][k] for k in some], pa.int64())], names=["f", "n0", "n1"])

    counts = written(sample.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-counts")
    whole = {r.f: r for r in counts.where(F.col("f").isin("", "\t")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    flat = math.log((share + 1e-3) / (1 - share + 1e-3))
    if "" not in whole or not whole[""].n0 or not whole[""].n1:
        return Model({}, curve=(0.0, flat))
    d0, d1 = float(whole[""].n0), float(whole[""].n1)
    prior = PRIOR * (F.col("n0") + F.col("n1")) / (d0 + d1)
    y0, y1 = F.col("n0") + prior, F.col("n1") + prior
    odds = F.log(y1 / (d1 + PRIOR - y1 + 1e-9)) - F.log(y0 / (d0 + PRIOR - y0 + 1e-9))
    z = odds / F.sqrt(1 / y0 + 1 / y1)
    strong = counts.where((F.col("f") != "") & (F.col("f") != "\t") & (F.col("n1") >= 3) & (F.col("n1") * d0 > 4 * d1 * F.col("n0"))).select("f", "n0", odds.alias("odds"), z.alias("z")).where(F.col("z") >= LEAST_Z)
    model = Model({r.f: r.odds for r in strong.where("odds > 0").collect()})  # of a sample of bounded size
    weak = counts.where((F.col("f") != "") & (F.col("f") != "\t") & ~F.endswith("f", F.lit("~"))).select("f", odds.alias("odds"), z.alias("z")).where(F.col("z") <= -LEAST_Z)
    model.clean = {r.f: r.odds for r in weak.collect()}
    model.loss = 0.0
    seen = _tallied(sample, model)
    words = [max(1, sum(n for (k, _), n in seen.items() if k == y)) for y in (0, 1)]
    share_of = [(sum(n for (k, s), n in seen.items() if k == y and s > 0) + 0.5) / (words[y] + 1) for y in (0, 1)]
    model.loss = max(0.01, math.log((1 - share_of[0]) / (1 - share_of[1])))
    model.cache = {}
    by_score = {s: n / words[0] for (k, s), n in seen.items() if k == 0}
    p = np.array([*by_score.values(), *(0.5 / words[0] / max(1, len(model.lexicon)) for _ in model.lexicon)])  # each lexicon word half a time more
    s = np.array([*(min(x, -model.loss) if x <= 0 else x for x in by_score), *model.lexicon.values()])
    mean = float((p * s).sum())
    if mean >= 0:  # else no lambda is positive
        more = 1e-3 + 2 * mean / max(1e-9, float(p[s <= 0].sum()))
        model.loss, s = model.loss + more, np.where(s <= 0, s - more, s)
    model.rate = _rate(p, s)
    floor = min(model.lexicon.values(), default=1.0)
    model.scale = (_long_segments(sample, model, floor) + 0.5) / words[0] * math.exp(min(700.0, model.rate * floor))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t)[0] for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "label"])

    judged = sample.mapInArrow(judge, "x double, label int").collect()  # 2 * per_class rows at most
    x, y = np.array([r.x for r in judged]), np.array([r.label for r in judged], float)
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    slope, constant = logistic(x[:, None], y, weight)
    model.curve = (max(0.0, float(slope)), float(constant))
    return model


def _tallied(sample: DataFrame, model: Model) -> dict[tuple[int, float], int]:
    """How often each label's words have each score: as many scores as the model has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: Counter = Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.update((y, s) for s in model.scores(text))
        keys = list(by)
        yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.float64()), pa.array([by[k] for k in keys], pa.int64())], names=["label", "s", "n"])

    return {(r.label, r.s): r.n for r in sample.mapInArrow(run, "label int, s double, n long").groupBy("label", "s").agg(F.sum("n").alias("n")).collect()}


def _long_segments(sample: DataFrame, model: Model, floor: float) -> int:
    """Segments of this score or more in clean documents of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = sum(s >= floor for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not y for *_, s in model.scan(text)[1])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return sample.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _rate(p: np.ndarray, s: np.ndarray) -> float:
    """lambda: the positive root of sum p exp(lambda s) = sum p over words of clean text, whose mean score is negative.
    1 where no word has a positive score."""
    if not (s > 0).any():
        return 1.0
    over = lambda x: float((p * np.expm1(np.minimum(x * s, 700))).sum()) >= 0
    low, high = 0.0, 1.0
    while not over(high):
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def toxicity(docs: DataFrame, model: Model, passages: bool = False, keep: Callable[[float], bool] | None = None) -> DataFrame:
    """doc_id, score, n_passages of every row; with passages also start, stop (words), score, expected of each.
    With keep: the rows of docs, all columns, whose score it accepts."""
    bounded_batches(docs.sparkSession)
    if keep:
        return filtered(docs, lambda: lambda some: [model.probability(model.evidence(t)[0]) for t in some], keep)
    extra = ", passages array<struct<start:int,stop:int,score:double,expected:double>>" if passages else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.evidence(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([model.probability(e) for e, _ in got], pa.float64()), pa.array([len(p) for _, p in got], pa.int32())]
            if passages:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
                columns.append(pa.array([[dict(zip(("start", "stop", "score", "expected"), x)) for x in p] for _, p in got], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_passages", "passages"][: len(columns)])

    return texts(docs).mapInArrow(run, "doc_id long, score double, n_passages int" + extra)
