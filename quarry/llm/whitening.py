"""Operator 12: whitening of embeddings by cyclic Jacobi rotations of their covariance.

Vectors become whole numbers, floor(SCALE * c), so every sum below is exact and does not depend on order or partitions.
Each distinct vector counts once. The scatter is taken around the rounded mean, so products stay small, and moved to
the true mean in exact arithmetic; entries of the covariance are right to the last bit. The driver holds dim x dim
numbers only. Its rotations compare each off-diagonal entry with its own two diagonal ones, which keeps small eigenvalues
accurate to their own size; the matrix goes to the tasks with each task's code.

Defined results: a vector that is null, empty, or holds a null or non-finite entry takes no part, nor one that does not
have the commonest dimension (of equally common ones the largest); entries over 2^53 / SCALE lose their last bits as doubles do; repeated rows give
rows of their own; a component without variance has null whitened; fewer dimensions than components give fewer
components; deviation over 64 bits is an error; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, written

SCALE = 256
#: Rows of a product; products of whole numbers below EXACT are exact as doubles.
BLOCK, EXACT = 4096, 2**53
#: Eigenvalues under this share of the largest are taken for none: V's own entries are no more exact.
NONE = 1e-14


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x array<long> of every row that takes part."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(fine).select(F.col(key).alias("vec_id"), F.transform(v, lambda c: F.floor(scale * c)).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dim")).alias("top")).first()
    return rows.where(F.size("x") == (sizes["top"]["dim"] if sizes["top"] else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_product(y: np.ndarray) -> list[list[int]]:
    """y' y of whole numbers, without rounding: as doubles while sums stay below EXACT, else in Python's numbers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    most = int(np.abs(y).max(initial=0))
    rows = BLOCK if most * most * BLOCK < EXACT else EXACT // max(1, most * most)
    for at in range(0, len(y), max(rows, BLOCK if not rows else 1)):
        if rows:
            part = y[at : at + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        else:
            part = y[at : at + BLOCK].astype(object)
            total += part.T @ part
    return total.tolist()


def moments(fit: DataFrame) -> tuple[int, list[int], list[list[Fraction]]]:
    """n, the sum of each dimension, and the covariance (divisor n) of the fit list, all exact.

    Tasks send sums of their rows, which are added by place before and after one shuffle.
    """
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    mean = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean)
        total = np.zeros((d, d), object)
        for b in batches:
            if len(b):
                total += np.array(exact_product(_matrix(b.column(0)) - mean), object)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i in range(d) for j in range(i + 1)], pa.int32()), pa.array([j for i in range(d) for j in range(i + 1)], pa.int32()), pa.array([str(total[i, j]) for i in range(d) for j in range(i + 1)])], names=["i", "j", "v"]
        )

    parts = fit.select("x").mapInArrow(scatter, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    off = [v - n * int(m) for v, m in zip(s, mean)]
    cov = [[Fraction(0)] * len(s) for _ in s]
    for r in parts:
        i, j = r["i"], r["j"]
        cov[i][j] = cov[j][i] = Fraction(n * int(r["v"]) - off[i] * off[j], n * n)
    return n, s, cov


def jacobi(v: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix: rotations in cyclic order until every
    off-diagonal entry has vanished beside its own diagonal entries."""
    a, d = np.array(v, np.float64), len(v)
    q = np.eye(d)
    for _ in range(most_sweeps):
        rotated = False
        for i in range(d - 1):
            for j in range(i + 1, d):
                if abs(a[i, j]) <= 1e-17 * np.sqrt(abs(a[i, i]) * abs(a[j, j])) or a[i, j] == 0:
                    continue
                rotated = True
                theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.sqrt(t * t + 1)
                s, moved = t * c, t * a[i, j]
                ii, jj = a[i, i] - moved, a[j, j] + moved
                a[[i, j]] = np.array([[c, -s], [s, c]]) @ a[[i, j]]
                a[:, [i, j]] = a[:, [i, j]] @ np.array([[c, s], [-s, c]])
                q[:, [i, j]] = q[:, [i, j]] @ np.array([[c, s], [-s, c]])
                a[i, i], a[j, j], a[i, j], a[j, i] = ii, jj, 0.0, 0.0
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], q[:, order]


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken away exactly, the rest as doubles."""
    return (x - base).astype(np.float64) - rest


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to `components` rows for each vector."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(vectors, key, vector, scale)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    if fit.isEmpty():
        return spark.createDataFrame([], schema)
    n, s, cov = moments(fit)
    e, q = jacobi(np.array([[float(c) for c in r] for r in cov]))
    base = np.array([v // n for v in s], np.int64)
    rest = np.array([float(Fraction(v - n * (v // n), n)) for v in s])
    trace = float(sum(cov[i][i] for i in range(len(s))))
    there = e > NONE * max(e[0], 0.0)
    explained = np.where(trace > 0, np.maximum(e, 0.0) / (trace or 1.0), 0.0)
    scaled = q[:, there] / np.sqrt(e[there])  # one column for each component that varies

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = scaled.shape[1]
        total = np.zeros((d, d))
        for b in batches:
            if len(b):
                w = _centred(_matrix(b.column(0)), base, rest) @ scaled
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d).astype(np.int32)), pa.array(np.tile(np.arange(d), d).astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    got = np.eye(len(e))
    for r in fit.select("x").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        got[r["i"], r["j"]] = r["v"] / n
    error = float(np.abs(got[: there.sum(), : there.sum()] - np.eye(there.sum())).max(initial=0.0))
    shown = min(components, len(e))
    vector_of = np.zeros((len(s), shown))
    vector_of[:, : min(shown, there.sum())] = scaled[:, :shown]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(s, object)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(1))
            most = n * (int(np.abs(x).max()) + int(np.abs(base).max()) + 1)
            y = n * (x - base) - (total - n * base.astype(object)).astype(np.int64) if most < 2**62 else n * x.astype(object) - total
            if most * most * x.shape[1] >= 2**63:
                y = y.astype(object)
            w = _centred(x, base, rest) @ vector_of
            shape = (len(b), shown)
            mask = np.broadcast_to(~there[:shown], shape).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(len(b)), shown))).cast(pa.int64()), pa.array(np.tile(np.arange(1, shown + 1), len(b)).astype(np.int32)), pa.array(np.full(shape, n).ravel()),
                    pa.array(np.repeat((y * y).sum(1), shown).tolist(), pa.int64()), pa.array(w.ravel(), mask=mask), pa.array(np.tile(explained[:shown], len(b))), pa.array(np.full(shape, error).ravel()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
