"""Nearest neighbours for tables of queries: exact, and by a stored index of lists with exact scores inside the lists probed.

Vectors that are null, empty or hold null or non-finite entries take no part. A query is compared with vectors of its own
dimension alone. The cosine with a zero vector is 0. Keys are longs or strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.layout import spread
from quarry.sources.shared import Versions, fingerprint, shared_folder, store_of

#: Queries that go to the tasks with their code, rows of a block, queries of one product; scores are compared as rounded to DIGITS.
CHUNK, ROWS, PRODUCT, DIGITS = 2048, 8192, 512, 9
#: Scores that are held at one time, queries that are assigned to lists at one time.
SCORES, ASSIGNED = 1 << 20, 1024
METRICS = ("cosine", "l2")
#: Rows that the centroids are fitted on, lists at most, rounds of fitting, queries that set how many lists are probed and the recall aimed at.
SAMPLE, LISTS, FIT_ROUNDS, TRIED, AIM = 20_000, 4096, 12, 200, 0.97


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(fine).select(F.col(key).alias("id"), v.alias("v"))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, row ids, scores of the k best rows for each query."""
    out = []
    norm = np.linalg.norm(x, axis=1)
    step = max(1, min(PRODUCT, SCORES // max(1, len(x))))
    for low in range(0, len(q), step):
        some, names = q[low : low + step], q_ids[low : low + step]
        dots = some @ x.T
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.nan_to_num(dots / (np.linalg.norm(some, axis=1)[:, None] * norm), nan=0.0, posinf=0.0, neginf=0.0)
            rank = -s
        else:
            s = np.sqrt(np.maximum(0, (some * some).sum(1)[:, None] + norm * norm - 2 * dots))
            rank = s.copy()
        if not own and names.dtype.kind == ids.dtype.kind:
            rank[names[:, None] == ids[None, :]] = np.inf
        n = min(k, len(ids))
        edge = np.partition(rank, n - 1, axis=1)[:, n - 1 : n]
        at, row = np.nonzero((rank <= edge + 2 * 10.0**-DIGITS) & np.isfinite(rank))  # all that tie for the last place
        order = np.lexsort((ids[row], np.round(rank[at, row], DIGITS), at))
        at, row = at[order], row[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((names[at[keep]], ids[row[keep]], s[at[keep], row[keep]]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _by_dimension(ids: pa.Array, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    names = np.array(ids.to_pylist(), str if pa.types.is_string(ids.type) else np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    return {int(d): (names[at], flat[starts[at][:, None] + np.arange(d)]) for d in np.unique(sizes) if len(at := np.flatnonzero(sizes == d))}


def _pairs(asked: dict, rows: dict, k: int, metric: str, own: bool, types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    for d, (q_ids, q) in asked.items():
        if d in rows:
            a, b, s = best(q_ids, q, *rows[d], k, metric, own)
            yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), types[0]), pa.array(b.tolist(), types[1]), pa.array(s)], names=["query_id", "vec_id", "score"])


def _types(asked: DataFrame, rows: DataFrame) -> tuple[str, tuple[pa.DataType, pa.DataType]]:
    kinds = ["string" if df.schema["id"].dataType.simpleString() == "string" else "long" for df in (asked, rows)]
    return f"query_id {kinds[0]}, vec_id {kinds[1]}, score double", tuple(pa.string() if t == "string" else pa.int64() for t in kinds)


def _in_groups(rows: DataFrame, asked: DataFrame, keys: list[str], k: int, metric: str, own: bool) -> DataFrame:
    """Pairs of each group of rows with the queries that were sent to it."""
    schema, types = _types(asked, rows)
    empty = pa.schema([("query_id", types[0]), ("vec_id", types[1]), ("score", pa.float64())]).empty_table()

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        if not len(x) or not len(q):
            return empty
        x, q = ({"id": t.column("id").combine_chunks(), "v": t.column("v").combine_chunks()} for t in (x, q))
        got = list(_pairs(_by_dimension(q["id"], q["v"]), _by_dimension(x["id"], x["v"]), k, metric, own, types))
        return pa.Table.from_batches(got, empty.schema) if got else empty

    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, schema)


def _ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    rounded = F.round("score", DIGITS)
    order = Window.partitionBy("query_id").orderBy(F.desc(rounded) if metric == "cosine" else rounded, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _checked(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", own: bool = False, query_key: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query; ties go to the smaller key.

    metric: cosine (similarity) or l2 (distance). own: whether a query's own row may be an answer. Up to CHUNK queries go to the rows, which
    are read once and not shuffled; more are sent as a table to blocks of ROWS rows. Each task keeps k rows a query.
    """
    _checked(metric)
    rows, asked = usable(vectors, key, vector), usable(queries, query_key or key, vector)
    schema, types = _types(asked, rows)
    few = asked.limit(CHUNK + 1).toArrow()
    if len(few) <= CHUNK:
        known = _by_dimension(few.column("id").combine_chunks(), few.column("v").combine_chunks()) if len(few) else {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    yield from _pairs(known, _by_dimension(b.column(0), b.column(1)), k, metric, own, types)

        return _ranked(spread(rows).mapInArrow(run, schema), k, metric)
    blocks = max(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(vectors.count() / ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))  # a stated query set against all blocks
    return _ranked(_in_groups(*_tiles(dealt, sent, asked.count()), ["block", "tile"], k, metric, own), k, metric)


def _tiles(rows: DataFrame, sent: DataFrame, queries: int) -> tuple[DataFrame, DataFrame]:
    """Both with a tile: about CHUNK queries each, so that a group of rows meets so many at one time, however many there are."""
    tiles = max(1, math.ceil(queries / CHUNK))
    return rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))), sent.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(tiles)).cast("int"))


def centroids(x: np.ndarray, n: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Means of n groups of rows, by Lloyd's rounds from rows spread over the sample; a group that runs empty takes the row farthest from its own mean."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        distance = (c * c).sum(1)[None, :] - 2 * x @ c.T
        of = distance.argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        count = np.bincount(of, minlength=n)
        far = np.argsort(-(distance[np.arange(len(x)), of] + (x * x).sum(1)), kind="stable")
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], 0)
        c[count == 0] = x[far[: (count == 0).sum()]]
    return c


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _closest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n closest centroids of each row, closest first."""
    distance = (c * c).sum(1)[None, :] - 2 * x @ c.T
    some = np.argpartition(distance, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.take_along_axis(distance, some, 1).argsort(1, kind="stable"), 1)


class ListIndex:
    """Every row in the list of its closest centroid, stored by list; a query is compared with the rows of the lists that it probes.

    Centroids come from at most SAMPLE rows, chosen by hash; their number is the root of the row count, LISTS at most. How many lists are
    probed is set on the sample, for a recall of AIM there, and can be given with a search. Rows of another dimension than
    the commonest are in no list; a search scans them, as they are stored apart. A list over ROWS rows is split into parts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = Versions(spark, f"{self.path}/versions").read()
        if self.meta:
            self.means = np.array(self.meta["centroids"]).reshape(-1, self.meta["dim"] or 1)

    def build(self, vectors: DataFrame, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", lists: int | None = None, k: int = 10) -> None:
        _checked(metric)
        rows = usable(vectors, key, vector)
        sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dim")).alias("top")).first()["top"]
        n, dim = (sizes["n"], sizes["dim"]) if sizes else (0, 0)
        few = rows.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(10**9)) < int(10**9 * min(1.0, 0.95 * SAMPLE / max(n, 1))))).limit(SAMPLE)
        x = np.array([r["v"] for r in few.orderBy(F.xxhash64("id")).collect()], np.float64).reshape(-1, max(dim, 1))
        x = _unit(x, metric)
        number = max(1, min(LISTS, lists or round(math.sqrt(n)), max(1, len(x))))
        means = centroids(x, number) if len(x) else np.zeros((1, max(dim, 1)))
        self._assigned(rows, means, dim, metric, 1).repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / number / ROWS))))).write.partitionBy("list").parquet(f"{self.path}/rows")
        there = n and self.spark.read.parquet(f"{self.path}/rows").groupBy("list").count().collect()
        meta = {"metric": metric, "dim": dim, "centroids": means.ravel().tolist(), "sizes": {str(r["list"]): r["count"] for r in there or []}, "probes": self._calibrated(x, means, metric, k), "key": rows.schema["id"].dataType.simpleString()}
        Versions(self.spark, f"{self.path}/versions").commit(meta, 1)
        self.meta, self.means = meta, means

    @staticmethod
    def _calibrated(x: np.ndarray, means: np.ndarray, metric: str, k: int) -> int:
        """The least number of lists that finds AIM of the k nearest rows within the sample."""
        if not len(x):
            return 1
        step = max(1, len(x) // TRIED)
        of = _closest(x, means, 1)[:, 0]
        tried = x[::step]
        order = _closest(tried, means, len(means))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(means))[None, :].repeat(len(tried), 0), 1)
        wanted = []
        for i, q in enumerate(tried):
            d = ((x - q) ** 2).sum(1)
            d[i * step] = np.inf
            near = np.argpartition(d, min(k, len(x) - 1) - 1 if len(x) > 1 else 0)[:k]
            wanted += place[i, of[near]].tolist()
        return int(np.sort(wanted)[min(len(wanted) - 1, math.ceil(AIM * len(wanted)))]) + 1

    @staticmethod
    def _assigned(rows: DataFrame, means: np.ndarray, dim: int, metric: str, n: int) -> DataFrame:
        """id, v, list: a row for each of the n closest lists; -1 for rows of other dimensions. Vectors are repeated by the plan alone."""
        kind = pa.string() if rows.schema["id"].dataType.simpleString() == "string" else pa.int64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, len(batch), ASSIGNED):
                    b = batch.slice(low, ASSIGNED)
                    sizes = b.column(1).value_lengths().to_numpy()
                    fits = np.flatnonzero(sizes == dim)
                    lists = np.full((len(b), n), -1, np.int32)
                    if len(fits):
                        flat = b.column(1).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                        lists[fits] = _closest(_unit(flat, metric), means, n)
                    held = np.where(sizes == dim, n, 1)
                    keep = np.arange(n)[None, :] < held[:, None]
                    offsets = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(0).cast(kind), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(lists[keep]))], names=["id", "v", "lists"])

        found = rows.mapInArrow(run, f"id {'string' if kind == pa.string() else 'long'}, v array<double>, lists array<int>")
        return found.select("id", "v", F.explode("lists").alias("list"))

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"id {self.meta['key']}, v array<double>, list int").parquet(f"{self.path}/rows")
        return rows if lists is None else rows.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", own: bool = False, probes: int | None = None) -> DataFrame:
        """query_id, rank, vec_id, score: the k best rows of the lists probed. Only those lists are read."""
        n = max(1, min(len(self.means), probes or self.meta["probes"]))
        asked = usable(queries, key, vector)
        probed = self._assigned(asked, self.means, self.meta["dim"], self.meta["metric"], n)
        lists = sorted(r[0] for r in probed.select("list").distinct().collect())  # LISTS numbers and one at most
        parts = F.create_map(*[x for name, size in self.meta["sizes"].items() for x in (F.lit(int(name)), F.lit(math.ceil(size / ROWS)))]) if self.meta["sizes"] else F.create_map().cast("map<int,int>")
        count = F.coalesce(F.try_element_at(parts, F.col("list")), F.lit(1))

        def part(c: Column) -> DataFrame:
            return F.pmod(F.xxhash64("id"), c).cast("int")

        rows = self.rows(lists).withColumn("part", part(count))
        sent = probed.withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
        return _ranked(_in_groups(*_tiles(rows, sent, asked.count()), ["list", "part", "tile"], k, self.meta["metric"], own), k, self.meta["metric"])


def list_index_of(spark: SparkSession, table: str, metric: str = "cosine") -> ListIndex:
    """The index of a Parquet table of vectors, kept in the shared folder under the fingerprint of its files."""
    path = f"{shared_folder(spark)}/lists-{metric}-{fingerprint(spark, table)}"
    index = ListIndex(spark, path)
    if not index.meta:
        store, at = store_of(spark, path)
        store.deleteOnExit(at)
        index.build(spark.read.parquet(table), metric)
    return index
