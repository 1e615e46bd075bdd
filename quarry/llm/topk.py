"""Operator 7: exact top-k by inner product on an impact-ordered index, score at a time.

Vectors are cut into blocks. In a block, a component of a vector is a posting of its dimension; its
impact is its size, quantised to powers of two. Posting segments go by descending impact: the largest
first, for all dimensions and a batch of queries at once. After each, what is still to come is
bounded for a query by the largest components left in each dimension. A query stops there only on
proof: once all but a few vectors are bounded below the k-th best score already certain. Those few
are rescored exactly. Ties at the k-th score stay in until the exact scores decide.

Queries are dealt out in chunks of bounded size, each against all rows in one pass.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part; rows
with the query's vec_id are the query's own; a vec_id given more than once among the queries asks
once (with its smallest vector), among the candidates each of its rows competes; vectors of another
length than the query's aren't candidates; ties go to the smaller vec_id; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, written

BLOCK, CHUNK, FEW = 8192, 2048, 64


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * 1024.0)


class Block:
    """Posting segments of some vectors, by descending impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        size = np.abs(x)
        top = float(size.max()) if size.size else 0.0
        edges = [top / 2**k for k in range(1, 4)] + [-1.0]
        self.segments, self.left = [], []
        high = np.inf
        for low in edges:
            now = (size < high) & (size >= low)
            self.segments.append(np.where(now, x, 0.0))
            below = np.where(size < low, size, 0.0)
            self.left.append(below.max(axis=0) if len(below) else np.zeros(x.shape[1]))
            high = low

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores): every possible member of each query's k best. floor: scores that are certain already."""
        open_ = np.arange(len(q))
        partial = np.zeros((len(q), len(self.x)))
        mine = own[:, None] == self.ids[None, :]
        for segment, left in zip(self.segments, self.left):
            partial[open_] += q[open_] @ segment.T
            rest = np.abs(q[open_]) @ left
            seen = np.where(mine[open_], -np.inf, partial[open_])
            if len(self.x) > k:
                certain = np.maximum(floor[open_], -np.partition(-seen, k - 1, axis=1)[:, k - 1] - rest)
            else:
                certain = floor[open_]
            slack = 1e-9 * (np.abs(certain) + rest)
            possible = seen + rest[:, None] >= np.where(np.isfinite(certain), certain - slack, -np.inf)[:, None]
            possible &= ~mine[open_]
            last = segment is self.segments[-1]
            done = (possible.sum(axis=1) <= FEW) | last
            for i in np.flatnonzero(done):
                at = np.flatnonzero(possible[i])
                if len(at):
                    yield int(open_[i]), self.ids[at], exact(self.x[at], q[open_[i]])
            open_ = open_[~done]
            if not len(open_):
                return


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles while they hold every sum exactly, whole numbers of any size else."""
    if (np.abs(x) @ np.abs(q)).max() < 2.0**52:
        return (x @ q).astype(np.int64)
    own = [int(v) for v in q]
    return np.array([max(1 - 2**63, min(2**63 - 1, sum(int(a) * b for a, b in zip(row, own)))) for row in x], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).alias("vec_id"), v.alias("v")).where(v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the highest inner products for each row of queries."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, key, vector)
    asked = usable(queries, key, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "queries")
    found = None
    chunk: list[tuple[int, list[float]]] = []

    def scan(chunk: list[tuple[int, list[float]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(chunk)  # CHUNK vectors at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for n in {len(v) for _, v in sent.value}:
                some = [(i, v) for i, v in sent.value if len(v) == n]
                by_length[n] = np.array([i for i, _ in some], np.int64), quantised(np.array([v for _, v in some]))
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def search(ids: np.ndarray, x: np.ndarray) -> None:
                own, q = by_length[x.shape[1]]
                floor = np.array([float(held[i][1][-1]) if i in held and len(held[i][1]) == k else -np.inf for i in own.tolist()])
                for at, new, scores in Block(ids, x).search(q, own, floor, k):
                    i = int(own[at])
                    if i in held:
                        new, scores = np.concatenate([held[i][0], new]), np.concatenate([held[i][1], scores])
                    held[i] = best(new, scores, k)

            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for b in batches:
                ids, lists = b.column(0).to_numpy(), b.column(1)
                flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy()
                begin = np.cumsum(lengths) - lengths
                for n in np.unique(lengths).tolist():
                    if n in by_length:
                        of = np.flatnonzero(lengths == n)
                        x = quantised(flat[begin[of][:, None] + np.arange(n)[None, :]])
                        waiting.setdefault(n, []).append((ids[of], x))
                        if sum(len(w[0]) for w in waiting[n]) >= BLOCK:
                            search(*(np.concatenate(c) for c in zip(*waiting.pop(n))))
            for blocks in waiting.values():
                search(*(np.concatenate(c) for c in zip(*blocks)))
            if held:
                qs = np.concatenate([np.full(len(ids), i, np.int64) for i, (ids, _) in held.items()])
                yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(np.concatenate([h[0] for h in held.values()])), pa.array(np.concatenate([h[1] for h in held.values()]))], names=["query_id", "vec_id", "score"])

        return rows.mapInArrow(run, "query_id long, vec_id long, score long")

    for r in asked.toLocalIterator():
        chunk.append((r.vec_id, list(r.v)))
        if len(chunk) == CHUNK:
            found, chunk = scan(chunk) if found is None else found.unionByName(scan(chunk)), []
    if chunk or found is None:
        found = scan(chunk) if found is None else found.unionByName(scan(chunk))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
