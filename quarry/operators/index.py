"""A stored BM25 index: built once, changed by segments, read by the buckets of the terms that are asked for.

    postings/segment=s/bucket=b   term, block, docs [doc_id, tf, dl], best [tf, dl]     (made of docs when a search first needs them)
    terms/segment=s               bucket, term, df      (a deletion's are negative: frequencies are sums over all segments)
    docs/segment=s                doc_id, dl, terms, tfs
    gone/segment=s                doc_id        (of segments before s)
    versions/v<n>                 the segments that count, and the corpus statistics

A block is some BLOCK documents of a segment whose hashes lie next to each other; a term's postings in it are one row. `best` holds
the least dl of every tf, so a bound of what a term can add in a block follows for any average length. Nothing is changed in
place: appends and deletions write segments, the version that names them is written last (what a writer that died has left is
named nowhere; `clean` removes it), a reader keeps the version it opened.

Search (block maxima, two rounds in one plan): tasks own ranges of documents. In the first round a task scores for each query only its
block with the highest bound, which gives every query a k-th score to beat; in the second a block is scored for
those queries alone whose bound reaches their k-th score. Results are exact. Where the terms asked for hold much of the corpus (passages of
common words) no block can be skipped: documents are then scored where they lie, in one pass that shuffles the best of each task alone.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import sparse_bag
from quarry.operators import bm25
from quarry.operators.bm25 import K1, B, EPSILON
from quarry.sources.shared import Versions, fingerprint, shared_folder, store_of, written

#: Documents of a block at most (on average), and of a task's range; bits of the hash that places a document.
BLOCK, RANGE, BITS = 128, 8192, 30
#: Query terms that a task holds at once, queries of one product.
TERMS_HELD, QUERIES = 1_000_000, 512
BUCKETS = 16
#: Documents of a batch that is counted or scored at one time, and of a group that is inverted by one task.
SLICE, GROUP = 256, 2048
#: A pass over the documents is taken where the terms asked for hold more than one in PASSED tokens; weights at most; scores that a task holds.
PASSED, MATRIX, POOL = 8, 1 << 23, 100_000
#: Scores are compared as rounded to so many digits.
DIGITS = 9


def _cut(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of lists one after the other, and each one's row."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def counted(tokens: DataFrame) -> DataFrame:
    """doc_id, dl, terms, tfs in order of term: each document's own tokens counted in its batch, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), SLICE):
                b = batch.slice(low, SLICE)
                flat, row = _cut(b.column(1))
                coded = flat.dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                key, tf = np.unique(row * max(1, len(rank)) + (rank[coded.indices.to_numpy()] if len(flat) else row), return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(len(b) + 1) * max(1, len(rank))), pa.int32())
                terms = coded.dictionary.take(pa.array(order[key % max(1, len(rank))])) if len(order) else coded.dictionary
                dl = b.column(1).value_lengths().fill_null(0)
                yield pa.RecordBatch.from_arrays([b.column(0), dl, pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], names=["doc_id", "dl", "terms", "tfs"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, dl int, terms array<string>, tfs array<int>")


def inverted(docs: pa.Table) -> pa.Table:
    """term, block, docs, best of doc_id, dl, terms, tfs, block."""
    docs = docs.take(pc.sort_indices(docs.column("doc_id"))).combine_chunks()
    one = {c: docs.column(c).combine_chunks() for c in docs.column_names}
    flat, row = _cut(one["terms"])
    coded = flat.dictionary_encode()
    tf, dl, block = one["tfs"].flatten().to_numpy(), one["dl"].to_numpy(), one["block"].to_numpy().astype(np.int64)
    key = block[row] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, row, tf = key[order], row[order], tf[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    offsets = pa.array(np.append(starts, len(key)), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([one["doc_id"].take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32())], ["doc_id", "tf", "dl"]))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    order = np.lexsort((dl[row], -tf, of))
    of, tf, least = of[order], tf[order], dl[row][order]
    top = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(tf, prepend=0) != 0))
    best = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[top], np.arange(len(starts) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(tf[top], pa.int32()), pa.array(least[top], pa.int32())], ["tf", "dl"]))
    n = max(1, len(coded.dictionary))
    return pa.table([coded.dictionary.take(pa.array(key[starts] % n)), pa.array(key[starts] // n, pa.int32()), lists, best], names=["term", "block", "docs", "best"])


def place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS)).cast("int")


def part(tf, dl, avgdl):
    """What one posting adds for each unit of weight; columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class Bm25Index:
    """An index at a path. Objects see the version that was latest when they were made or last wrote."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = sparse_bag, buckets: int = BUCKETS):
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens
        self.versions = Versions(spark, f"{self.path}/versions")
        self.now = self.versions.read() or {"version": 0, "next": 1, "buckets": buckets, "segments": [], "gone": [], "terms": [], "key": None, "n": 0, "length": 0, "mean": 0.0}

    # Writing

    def write(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds documents; those of known keys are replaced. Keys must be distinct and not null. One commit."""
        keys = docs.select(F.col(key).alias("doc_id"))
        found = keys.agg(F.count("*").alias("rows"), F.count("doc_id").alias("keys"), F.count_distinct("doc_id").alias("distinct")).first()
        if not found["rows"] == found["keys"] == found["distinct"]:
            raise ValueError("documents of an index need distinct keys without nulls")
        if not found["rows"]:
            return
        now = self._without(keys) if self.now["segments"] else dict(self.now, gone=[*self.now["gone"]])
        self._add(now, counted(bm25.tokenised(docs, key, text, self.tokens)), found["rows"])
        self._commit(now)

    def delete(self, keys: DataFrame, key: str = "doc_id") -> None:
        """Takes documents away by key; unknown ones are ignored."""
        if self.now["segments"]:
            self._commit(self._without(keys.select(F.col(key).alias("doc_id"))))

    def compact(self) -> None:
        """Rewrites what is left as one segment. Older versions stay readable until `clean`."""
        if not self.now["segments"]:
            return
        rows = self._docs("terms", "tfs")
        now = dict(self.now, segments=[], gone=[], terms=[], n=0, length=0)
        self._add(now, rows, self.now["n"])
        self._commit(now)

    def clean(self) -> None:
        """Removes segments that the latest version does not name. Readers of older versions must be done."""
        for kind in ("postings", "terms", "docs", "gone"):
            named = {s["id"] for s in self.now["segments"]} | set(self.now["gone"]) | set(self.now["terms"])
            store, at = store_of(self.spark, f"{self.path}/{kind}")
            for d in store.listStatus(at) if store.exists(at) else ():
                if int(d.getPath().getName().removeprefix("segment=")) not in named:
                    store.delete(d.getPath(), True)

    def _add(self, now: dict, rows: DataFrame, n: int) -> None:
        """A segment of doc_id, dl, terms, tfs into the record `now`."""
        number, bits = self._number(now), max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
        at = f"segment={number}"
        key = rows.schema["doc_id"].dataType.simpleString()
        rows.write.parquet(f"{self.path}/docs/{at}")
        docs = self.spark.read.schema(f"doc_id {key}, dl int, terms array<string>, tfs array<int>").parquet(f"{self.path}/docs/{at}")
        length = int(docs.agg(F.sum("dl")).first()[0] or 0)
        if length:
            self._write_terms(docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("bucket", self._bucket()), number)
            now["terms"] = [*now["terms"], number]
        now.update(segments=[*now["segments"], {"id": number, "bits": bits, "posted": length > 0}], next=number + 1, n=now["n"] + n, length=now["length"] + length, key=key)

    def _without(self, keys: DataFrame) -> dict:
        """The record without those keys: they are listed, and what they held is counted off."""
        number, now = self._number(self.now), dict(self.now)
        named = keys.where("doc_id is not null").distinct()
        there = self.lengths().join(named, "doc_id", "left_semi")
        there.select("doc_id", "dl").write.parquet(f"{self.path}/gone/segment={number}")
        gone = self.spark.read.parquet(f"{self.path}/gone/segment={number}")
        left = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        if not left["n"]:
            return dict(now, next=number + 1)
        lost = self.postings().join(gone.select("doc_id"), "doc_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df")).withColumn("bucket", self._bucket())
        self._write_terms(lost, number)
        now.update(terms=[*now["terms"], number], gone=[*now["gone"], number], next=number + 1, n=now["n"] - left["n"], length=now["length"] - int(left["length"]))
        return now

    @staticmethod
    def _number(now: dict) -> int:
        """Of a new segment: later ones have larger ones, and writers at work at one time different ones."""
        return max(now["next"], time.time_ns())

    def _write_terms(self, terms: DataFrame, number: int) -> None:
        terms.sortWithinPartitions("bucket", "term").write.parquet(f"{self.path}/terms/segment={number}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.now["buckets"])).cast("int")

    def _inverted(self, segment: dict) -> None:
        """Writes the lists of a segment, unless they are there: the first reader that asks for them does it. They are moved to
        their place when they are whole."""
        place_, making = f"{self.path}/postings/segment={segment['id']}", f"{self.path}/making-{uuid.uuid4().hex}"
        store, at = store_of(self.spark, place_)
        if store.exists(at):
            return
        bits, key = segment["bits"], self.now["key"]
        docs = self.spark.read.schema(f"doc_id {key}, dl int, terms array<string>, tfs array<int>").parquet(f"{self.path}/docs/segment={segment['id']}")
        shifted = lambda b: F.shiftright(place(F.col("doc_id")), BITS - b)
        groups = min(bits, max(math.ceil(math.log2(self.spark.sparkContext.defaultParallelism)), bits - int(math.log2(GROUP / BLOCK))))
        dealt = docs.withColumn("block", shifted(bits)).groupBy(shifted(groups).alias("g"))  # whole blocks, of about GROUP documents in all
        schema = f"term string, block int, docs array<struct<doc_id:{key},tf:int,dl:int>>, best array<struct<tf:int,dl:int>>"
        shown = dealt.applyInArrow(inverted, schema).withColumn("bucket", self._bucket())
        shown.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(making)
        _, made = store_of(self.spark, making)
        store.mkdirs(at.getParent())
        if store.exists(at) or not store.rename(made, at):
            store.delete(made, True)  # another reader was first

    def _commit(self, now: dict) -> None:
        before, self.now = self.now, now
        raw = F.log(F.lit(float(now["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        now["mean"] = float(self.terms().agg(F.avg(raw)).first()[0] or 0.0)
        now["version"] = before["version"] + 1
        try:
            self.versions.commit(now, now["version"])
        except RuntimeError:
            self.now = before
            raise

    # Reading

    @property
    def n(self) -> int:
        return self.now["n"]

    @property
    def avgdl(self) -> float:
        return self.now["length"] / self.now["n"] if self.now["n"] else 0.0

    def _read(self, kind: str, schema: str, numbers: list[int], buckets: list[int] | None = None) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/segment={s}" for s in numbers])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _blocks(self, buckets: list[int] | None = None) -> DataFrame:
        """segment, bucket, term, block, docs, best; documents that were deleted or replaced are out of docs."""
        key = self.now["key"] or "bigint"
        schema = f"term string, block int, docs array<struct<doc_id:{key},tf:int,dl:int>>, best array<struct<tf:int,dl:int>>, segment long, bucket int"
        for s in self.now["segments"]:
            if s["posted"]:
                self._inverted(s)
        rows = self._read("postings", schema, [s["id"] for s in self.now["segments"] if s["posted"]], buckets)
        if not self.now["gone"]:
            return rows
        gone = self._read("gone", f"doc_id {key}, segment long", self.now["gone"]).withColumnRenamed("segment", "at")
        older = F.filter(F.array(*[F.struct(F.lit(s["id"]).cast("long").alias("segment"), F.lit(BITS - s["bits"]).alias("shift")) for s in self.now["segments"]]), lambda s: s["segment"] < F.col("at"))
        each = gone.select("doc_id", F.explode(older).alias("s")).select("doc_id", "s.segment", F.expr(f"shiftright({place_sql()}, s.shift)").alias("block"))
        lists = each.groupBy("segment", "block").agg(F.collect_set("doc_id").alias("lost"))  # at most a block's documents
        left = rows.join(lists, ["segment", "block"], "left")
        kept = F.when(F.col("lost").isNull(), F.col("docs")).otherwise(F.filter("docs", lambda d: ~F.array_contains("lost", d["doc_id"])))
        return left.withColumn("docs", kept).where(F.size("docs") > 0).select("segment", "bucket", "term", "block", "docs", "best")

    def postings(self) -> DataFrame:
        """doc_id, term, tf, dl."""
        return self._docs(F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("doc_id", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"), "dl")

    def _docs(self, *more: str | Column) -> DataFrame:
        key = self.now["key"] or "bigint"
        rows = self._read("docs", f"doc_id {key}, dl int, terms array<string>, tfs array<int>, segment long", [s["id"] for s in self.now["segments"]])
        if self.now["gone"]:
            gone = self._read("gone", f"doc_id {key}, segment long", self.now["gone"]).groupBy("doc_id").agg(F.max("segment").alias("at"))
            rows = rows.join(gone, "doc_id", "left").where("at is null or segment > at")
        return rows.select("doc_id", "dl", *more)

    def lengths(self) -> DataFrame:
        """doc_id, dl."""
        return self._docs()

    def terms(self, buckets: list[int] | None = None) -> DataFrame:
        """term, df of the terms that some document still has."""
        rows = self._read("terms", "bucket int, term string, df long, segment long", self.now["terms"], buckets)
        return rows.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0").select("term", "df")

    def idf(self, buckets: list[int] | None = None) -> DataFrame:
        """term, df, idf."""
        raw = F.log(F.lit(float(self.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return self.terms(buckets).select("term", "df", F.when(raw < 0, EPSILON * self.now["mean"]).otherwise(raw).alias("idf"))

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """query_id, term, weight, df of known terms, and the buckets that hold the queries' terms (BUCKETS numbers at most)."""
        asked = written(bm25.query_terms(queries, tokens=self.tokens), "query-terms")
        buckets = sorted(r[0] for r in asked.select(self._bucket().alias("b")).distinct().collect())
        weighed = asked.join(self.idf(buckets), "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight"), "df")
        return written(weighed, "query-weights"), buckets

    def _few(self, asked: DataFrame) -> pa.Table | None:
        """The weights, if a pass over the documents is the shorter way: the terms asked for hold much of the corpus, and the weights of
        all queries fit a matrix of MATRIX numbers."""
        each = asked.groupBy("term").agg(F.max("df").alias("df")).agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
        sizes = asked.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("rows")).crossJoin(each).first()
        if sizes["df"] * PASSED < self.now["length"] or not sizes["rows"] or sizes["terms"] * sizes["queries"] > MATRIX:
            return None
        return asked.select("query_id", "term", "weight").toArrow()

    def _passed(self, few: pa.Table, k: int | None) -> DataFrame:
        """query_id, doc_id, score by a pass over the documents where they lie; with k, each task's k best of every query alone."""
        ids = few.column("query_id").combine_chunks().dictionary_encode()
        run = _passer(ids.dictionary, ids.indices.to_numpy(), few.column("term").combine_chunks(), few.column("weight").to_numpy(), self.avgdl or 1.0, k)
        key = self.now["key"] or "bigint"
        kind = "string" if ids.dictionary.type == pa.string() else "long"
        return self._docs("terms", "tfs").mapInArrow(run, f"query_id {kind}, doc_id {key}, score double")

    def scores(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id, score of every document that shares a term with the query."""
        asked, buckets = self._asked(queries)
        if (few := self._few(asked)) is not None:
            return self._passed(few, None)
        rows = self._blocks(buckets).join(asked, "term").select("query_id", "weight", F.explode("docs").alias("d"))
        return rows.select("query_id", "d.doc_id", (F.col("weight") * part(F.col("d.tf"), F.col("d.dl"), F.lit(self.avgdl or 1.0))).alias("p")).groupBy("query_id", "doc_id").agg(F.sum("p").alias("score"))

    def search(self, queries: DataFrame, k: int = 5, pad: bool = True, counts: bool = False) -> DataFrame:
        """query_id, rank, doc_id, score; ties go to the smaller doc_id. With pad, a query with fewer than k documents of a score over 0
        is filled up with the first others, at score 0. With counts: query_id, touched, whole instead, the postings of the query's terms
        that were scored and all there are."""
        asked, buckets = self._asked(queries)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
        few = None if counts else self._few(asked)
        found = self._passed(few, k) if few is not None else self._in_rounds(asked.drop("df"), buckets, k, order, counts)
        if counts:
            return found
        if pad:
            some = self.lengths().select("doc_id").orderBy("doc_id").limit(2 * k)
            fill = queries.select("query_id").distinct().crossJoin(F.broadcast(some)).select("query_id", "doc_id", F.lit(0.0).alias("score"))  # 2k rows a query
            found = found.unionByName(fill).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def _in_rounds(self, asked: DataFrame, buckets: list[int], k: int, order: Window, counts: bool) -> DataFrame:
        """By the lists of the terms asked for and the bounds of blocks."""
        cores = self.spark.sparkContext.defaultParallelism
        most = max([s["bits"] for s in self.now["segments"]], default=0)
        bits = min(most, max(math.ceil(math.log2(cores)), math.ceil(math.log2(max(1, self.n / RANGE)))))
        query_type, key = asked.schema["query_id"].dataType.simpleString(), self.now["key"] or "bigint"
        shift = F.create_map(*[x for s in self.now["segments"] for x in (F.lit(s["id"]).cast("long"), F.lit(s["bits"]))]) if self.now["segments"] else F.create_map().cast("map<bigint,int>")
        own = F.col("block").cast("long") * F.pow(F.lit(2.0), F.lit(bits) - F.try_element_at(shift, F.col("segment")))  # a coarse block goes to its first range
        blocks = self._blocks(buckets).join(asked.select("term").distinct(), "term", "left_semi").select(F.floor(own).cast("int").alias("g"), "segment", "block", "term", "docs", "best")
        chunks = max(1, math.ceil(asked.count() / TERMS_HELD))
        spread = asked.withColumn("c", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        own_chunk = blocks.withColumn("c", F.explode(F.array(*[F.lit(c) for c in range(chunks)])))
        avgdl = self.avgdl or 1.0

        def round_(rows: DataFrame, first: int) -> DataFrame:
            every = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))  # a stated query set against all ranges
            run = _scorer(k, avgdl, first, pa.string() if query_type == "string" else pa.int64(), pa.string() if key == "string" else pa.int64())
            return own_chunk.groupBy("g", "c").cogroup(every.groupBy("g", "c")).applyInArrow(run, f"query_id {query_type if query_type == 'string' else 'long'}, doc_id {key if key == 'string' else 'long'}, score double, touched long, whole long")

        first = round_(spread.withColumn("beat", F.lit(None).cast("double")), 1).where("doc_id is not null")
        best = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
        beat = best.select("query_id", F.when(F.col("found") >= k, F.col("least")).alias("beat"))
        found = round_(spread.join(beat, "query_id", "left"), 0)
        if counts:
            return found.groupBy("query_id").agg(F.sum("touched").alias("touched"), F.sum("whole").alias("whole"))
        return found.where("doc_id is not null").select("query_id", "doc_id", "score")


def place_sql() -> str:
    return f"cast(pmod(xxhash64(doc_id), {1 << BITS}) as int)"


def scored(starts: np.ndarray, tf: np.ndarray, dl: np.ndarray, doc: np.ndarray, term: np.ndarray, block: np.ndarray, bound: np.ndarray, w: np.ndarray, beat: np.ndarray, k: int, first: int, avgdl: float):
    """Scores of queries in the blocks that can matter: lists of (query, doc, score), and by query the postings scored and all of its terms'.

    Row i of the postings is term[i] in block[i] with documents starts[i]:starts[i + 1], and adds bound[i] at most. w is queries x terms. With
    first, each query is scored in its best block alone, else in every block whose bound reaches beat (all of its terms' where that is nan).
    """
    out, touched, whole = [], np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    sizes = np.diff(starts)
    held = w != 0
    np.add.at(whole_of := np.zeros(w.shape[1], np.int64), term, sizes)
    whole += held @ whole_of
    n_blocks = int(block.max()) + 1 if len(block) else 0
    top = np.zeros((w.shape[1], n_blocks))
    top[term, block] = bound
    has = np.zeros((w.shape[1], n_blocks))
    has[term, block] = 1
    reach = np.maximum(w, 0) @ top
    there = (held.astype(float) @ has) > 0
    if first:
        chosen = np.zeros_like(there)
        ranked = np.where(there, reach, -1)
        chosen[np.arange(len(w)), ranked.argmax(1) if n_blocks else 0] = True
        chosen &= there
    else:
        chosen = there & ~(reach < (beat - 2 * 10.0**-DIGITS - 1e-12 * np.abs(beat))[:, None])
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
    for b in range(n_blocks):
        rows = order[cuts[b] : cuts[b + 1]]
        asked = np.flatnonzero(chosen[:, b])
        if not len(asked) or not len(rows):
            continue
        at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
        of = np.repeat(np.arange(len(rows)), sizes[rows])
        docs, column = np.unique(doc[at], return_inverse=True)
        adds = np.zeros((len(rows), len(docs)))
        adds[of, column] = part(tf[at].astype(float), dl[at], avgdl)
        here = w[np.ix_(asked, term[rows])]
        touched[asked] += (here != 0) @ sizes[rows]
        score = here @ adds
        match = ((here != 0).astype(float) @ (adds > 0)) > 0
        score = np.where(match, score, -np.inf)
        cut = np.partition(score, max(0, len(docs) - k), axis=1)[:, max(0, len(docs) - k)]
        q, d = np.nonzero(match & (score >= cut[:, None] - 2 * 10.0**-DIGITS))
        out.append((asked[q], docs[d], score[q, d]))
    return out, touched, whole


def _scorer(k: int, avgdl: float, first: int, query_type: pa.DataType, key_type: pa.DataType):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "doc_id", "score", "touched", "whole"], [query_type, key_type, pa.float64(), pa.int64(), pa.int64()]
        if not len(blocks) or not len(asked):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        blocks, asked = blocks.combine_chunks(), asked.combine_chunks()
        terms = blocks.column("term").combine_chunks().dictionary_encode()
        term, vocabulary = terms.indices.to_numpy(), terms.dictionary
        both = np.column_stack([blocks.column("segment").to_numpy(), blocks.column("block").to_numpy()])
        block = np.unique(both, axis=0, return_inverse=True)[1].ravel()
        lists, best = blocks.column("docs").combine_chunks(), blocks.column("best").combine_chunks()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        keys = flat.field("doc_id")
        if query_strings := key_type == pa.string():
            coded = keys.dictionary_encode()
            keys, key_names = coded.indices, coded.dictionary.to_pylist()
        tf, dl, doc = (c.to_numpy(zero_copy_only=False) for c in (flat.field("tf"), flat.field("dl"), keys))
        top = best.flatten()
        at = best.offsets.to_numpy() - best.offsets[0].as_py()
        bound = np.maximum.reduceat(part(top.field("tf").to_numpy().astype(float), top.field("dl").to_numpy(), avgdl), at[:-1])
        place_of = asked.column("term").combine_chunks()
        column = pc.index_in(place_of, vocabulary)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        ids = asked.column("query_id").combine_chunks().dictionary_encode()
        of, id_names = ids.indices.to_numpy(), ids.dictionary.to_pylist()
        column, weight = column.fill_null(0).to_numpy(), asked.column("weight").to_numpy()
        beats = np.full(len(id_names), np.nan)
        beats[of] = asked.column("beat").cast(pa.float64()).fill_null(float("nan")).to_numpy()
        cols: list[list] = [[], [], [], [], []]
        for low in range(0, len(id_names), QUERIES):
            mine = known & (of >= low) & (of < low + QUERIES)
            n = min(QUERIES, len(id_names) - low)
            used, short = np.unique(column[mine], return_inverse=True)
            w = np.zeros((n, len(used)))
            w[of[mine] - low, short] = weight[mine]
            code = np.full(len(vocabulary), -1)
            code[used] = np.arange(len(used))
            rows = np.flatnonzero(code[term] >= 0)
            if not len(rows):
                continue
            lens = np.diff(starts)[rows]
            take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            _, short_block = np.unique(block[rows], return_inverse=True)
            got, touched, whole = scored(np.concatenate([[0], np.cumsum(lens)]), tf[take], dl[take], doc[take], code[term[rows]], short_block.ravel(), bound[rows], w, beats[low : low + n], k, first, avgdl)
            if got:
                q, d, s = (np.concatenate(c) for c in zip(*got))
                names_of = np.array(key_names, object)[d] if query_strings else d
                places = np.lexsort((names_of.astype(str) if query_strings else names_of, -np.round(s, DIGITS), q))
                rank = np.arange(len(q)) - np.searchsorted(q[places], q[places])
                keep = places[rank < k]
                cols[0] += [id_names[low + i] for i in q[keep]]
                cols[1] += names_of[keep].tolist()
                cols[2] += s[keep].tolist()
                cols[3] += [None] * len(keep)
                cols[4] += [None] * len(keep)
            for i in np.flatnonzero(whole):
                cols[0].append(id_names[low + i]), cols[1].append(None), cols[2].append(None), cols[3].append(int(touched[i])), cols[4].append(int(whole[i]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


def _passer(queries: pa.Array, of: np.ndarray, term: pa.Array, weight: np.ndarray, avgdl: float, k: int | None):
    """Scores documents against a matrix of the weights of all queries, SLICE documents at a time. Query of[i] asks for term[i]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = term.dictionary_encode()
        w = np.zeros((len(coded.dictionary), len(queries)))
        w[coded.indices.to_numpy(), of] = weight
        plain = (weight > 0).all()
        edge, held, kept = np.full(len(queries), -np.inf), [], 0

        def best(parts: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            q, s, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])
            place = np.empty(len(doc), np.int64)
            place[pc.sort_indices(doc).to_numpy()] = np.arange(len(doc))
            order = np.lexsort((place, -np.round(s, DIGITS), q))
            rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            last = order[rank == k - 1]
            edge[q[last]] = s[last] - 2 * 10.0**-DIGITS
            keep = order[rank < k]
            return q[keep], s[keep], doc.take(pa.array(keep))

        def shown(q: np.ndarray, s: np.ndarray, doc: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([queries.take(pa.array(q)), doc, pa.array(s)], names=["query_id", "doc_id", "score"])

        for batch in batches:
            for low in range(0, len(batch), SLICE):
                b = batch.slice(low, SLICE)
                flat, row = _cut(b.column(2))
                code = pc.index_in(flat, value_set=coded.dictionary).fill_null(-1).to_numpy()
                own = np.flatnonzero(code >= 0)
                used, column = np.unique(code[own], return_inverse=True)
                adds = np.zeros((len(b), len(used)))
                adds[row[own], column] = part(b.column(3).flatten().to_numpy()[own].astype(float), b.column(1).to_numpy()[row[own]], avgdl)
                score = w[used].T @ adds.T
                match = score > 0 if plain else (w[used] != 0).T.astype(float) @ (adds > 0).T.astype(float) > 0
                q, d = np.nonzero(match & (score >= edge[:, None]))
                if not len(q):
                    continue
                found = q, score[q, d], b.column(0).take(pa.array(d))
                if k is None:
                    yield shown(*found)
                    continue
                held.append(found)
                kept += len(q)
                if kept > POOL:
                    held = [best(held)]
                    kept = 0
        if held:
            yield shown(*best(held))

    return run


def index_of(spark: SparkSession, table: str, key: str = "doc_id", text: str = "text") -> Bm25Index:
    """The index of a Parquet table, kept in the shared folder under the fingerprint of its files: built when it is first asked for, and
    again when the table has changed."""
    path = f"{shared_folder(spark)}/bm25-passed-{fingerprint(spark, table)}"
    index = Bm25Index(spark, path)
    if not index.now["version"]:
        store, at = store_of(spark, path)
        store.deleteOnExit(at)
        index.write(spark.read.parquet(table), key, text)
    return index
