"""Connected components of a link table by alternating star operations, all on the executors.

A round hangs every larger neighbour of a node from its smallest one (large star), then every
smaller neighbour (small star). Both only need a node's smallest neighbour, an aggregate that
combines before the shuffle, joined back to the links; no neighbour list is ever gathered. Rounds
grow with the logarithm of the longest chain. Each is written to the shared folder. Before the first, every
task joins blocks of its own links, so that the many links of a large group shrink where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import forget, written

#: Nodes that a task holds at once when it joins its own links.
BLOCK = 200_000


def joined(up: dict[int, int]) -> pa.RecordBatch:
    """Every node that hangs from another one, and the smallest it reaches."""
    found = [(x, _top(up, x)) for x in up]
    u, v = zip(*((x, top) for x, top in found if x != top)) if any(x != top for x, top in found) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _top(up: dict[int, int], x: int) -> int:
    while up[x] != x:
        up[x] = x = up[up[x]]
    return x


def forest(edges: DataFrame) -> DataFrame:
    """u, v with u > v: links that make the same components as a, b, at most one of a node from a block of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = _top(up, up.setdefault(x, x)), _top(up, up.setdefault(y, y))
                up[max(x, y)] = min(x, y)
            if len(up) > BLOCK:
                yield joined(up)
                up = {}
        yield joined(up)

    longs = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    return longs.mapInArrow(run, "u long, v long")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links a, b but the roots; root is the smallest node of its component."""
    now = written(forest(edges), "links")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        old, now = now, written(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        forget(old, large)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs from one node only, and that from none: a further round would change nothing."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("under")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("under")))).alias("e"))
    each = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.under").alias("under"))
    return each.where("up > 1 or up = 1 and under = 1").isEmpty()
