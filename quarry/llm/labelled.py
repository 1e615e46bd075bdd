"""A bounded sample of labelled training rows for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import texts


LOTS = 1_000_000_007


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trained: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, doc_id) of up to per_class documents of each label, and how many each label has in all.

    trained tells from doc_id which rows may be learned from. A key is chosen if its hash is under a
    cut that gives just under per_class of them: the same ones every time, spread over all rows, and
    no task sends the driver more than its share. Keys with differing labels take the
    larger one, keys with several texts teach one of them, chosen by hash; null labels and keys don't count. At most
    2 * per_class keys are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & trained).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for k, n in totals.items():
        cut = LOTS if n <= per_class else int(LOTS * (per_class - 5 * per_class**0.5) / n)  # five deviations under the bound
        own = known.where((F.col("label") == k) & (F.pmod(F.xxhash64("doc_id"), LOTS) < cut))
        chosen += own.limit(per_class).collect()
    keys = [(r["doc_id"], r["label"]) for r in chosen]
    bounded = F.broadcast(docs.sparkSession.createDataFrame(keys, "doc_id long, label int"))
    rows = texts(docs).join(bounded, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return rows.select("one.text", "label", "doc_id"), totals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last one constant) of a logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w
