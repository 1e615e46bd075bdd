"""Operator 5: near-duplicates by SimHash over a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits: bit i is set if over half of its shingles' XXH64 have it set.
Two fingerprints link at max_bits (2) differing bits or fewer, so at least 8 - max_bits of their 8
positional bytes are equal: the guaranteed minimum of the count filter. An index by single bytes
has 2,048 lists whatever the corpus, so a pair is tallied where its shared positions meet: every
fingerprint is posted under each choice of 6 of its 8 positional bytes. A pair shares m >= 6 bytes
exactly if it meets in C(m, 6) >= 1 lists, and no other pair meets at all. Members of a list differ in
two bytes only, so a list holds 65,536 different fingerprints at most; it is verified by looking each
member's neighbours within max_bits up, not pair by pair, and gives a tree of links. Copies share
one fingerprint and are posted once.

Defined results: a null or empty text has fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence is the one shingle; null keys take no part in the smallest key; repeated
rows each give a row; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, texts, written
from quarry.llm.components import connected

BLOCK = 100_000


def fingerprint(text: str, words: int = 3) -> int:
    """Of one text, as a signed 64-bit number."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        some = parts[i : i + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(words)))) if len(parts) > words else [b" ".join(parts)]
        h = np.fromiter(map(digest, shingles, repeat(42)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def list_links(rest: np.ndarray, max_bits: int) -> np.ndarray:
    """For members given by their two free bytes: the member that each hangs from (itself for a root)."""
    flips = [0] + [sum(1 << b for b in c) for n in range(1, max_bits + 1) for c in combinations(range(16), n)]
    n = len(rest)
    if n <= 64:
        near = np.bitwise_count(rest[:, None] ^ rest[None, :]) <= max_bits
        up = np.arange(n)
        while True:
            new = np.where(near, up[None, :], n).min(axis=1)
            if (new == up).all():
                return up
            up = new
    label = np.full(1 << 16, n, np.int64)
    label[rest] = np.arange(n)
    while True:
        new = np.min([label[rest ^ f] for f in flips], axis=0)
        new = np.minimum(new, new[new])
        if (new == label[rest]).all():
            return new
        label[rest] = new


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """a, b: links that join what the index and the verification find, for different fingerprints fp."""
    choices = list(combinations(range(8), 8 - max_bits))
    if not 0 <= max_bits <= 2:
        raise ValueError("lists are bounded for 2 differing bits at most")
    masks = [sum(0xFF << (8 * p) for p in c) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("fp", F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for k, m in enumerate(signed)))).alias("p"))
    lists = posted.groupBy("p.k", "p.shared").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out = [], []
            for k, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = np.sort(members.values.to_numpy(zero_copy_only=False).astype(np.int64))
                bytes_of = m.view(np.uint8).reshape(-1, 8)
                free = [p for p in range(8) if p not in choices[k]] or [0]
                rest = sum(bytes_of[:, p].astype(np.int64) << (8 * i) for i, p in enumerate(free))
                up = list_links(rest, max_bits)
                own = up != np.arange(len(m))
                a_out.append(m[own])
                b_out.append(m[up[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return lists.select("k", "fps").mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every row."""
    marked = written(fingerprints(docs, words), "simhash")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(written(links(fps.select("fp"), max_bits), "simhash-links"))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "simhash-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(placed.join(least, "root").select("fp", "component_id"), "simhash-names")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component: the smallest key, null keys last, then by row."""
    numbered = written(docs.withColumn("_rid", F.monotonically_increasing_id()), "simhash-docs")
    parts = simhash_components(numbered.select(F.col("_rid").alias("doc_id"), "text"), words, max_bits).select(F.col("doc_id").alias("_rid"), "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("best")
    kept = numbered.select("_rid", "doc_id").join(parts, "_rid").groupBy("component_id").agg(best).select("best._rid")
    return numbered.join(written(kept, "simhash-kept"), "_rid", "left_semi").select(*docs.columns)
