"""Operator 8: sharding on a consistent-hash ring with virtual nodes and bounded loads.

A key's hash is a place on a ring of 65,536; every shard has virtual nodes there. A key belongs to the
next node clockwise, and if that shard is full, goes on clockwise to the next node of a shard with
room. With room for n or n + 1 rows each (as many in all as there are rows), counts are at most one
apart: the law `rows`. With slack, shards may hold that much more than the mean and fewer keys move.

All that the walk needs is the number of rows at each place: at most 65,536 counts reach the driver
whatever the input, which lays out runs of ranks (place, from, to, shard, first slot). Ranks are
counted in parts of about 50,000 rows, however many rows share a place.

Defined results: a null key hashes as the empty text, a null text has size 1 and the checksum of the
empty text; repeated rows each get a slot of their own; extra columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

RING, PART_ROWS = 1 << 16, 50_000


class Ring:
    """Virtual nodes on the ring, and who takes what when loads are bounded."""

    def __init__(self, shards: int, nodes: int = 128):
        self.shards = shards
        at = sorted((int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % RING, s) for s in range(shards) for v in range(nodes))
        self.places, self.owners = [p for p, _ in at], [s for _, s in at]

    def walk(self, place: int):
        """Shards clockwise from a place, each once."""
        i, seen = bisect.bisect_left(self.places, place), set()
        for k in range(len(self.owners)):
            s = self.owners[(i + k) % len(self.owners)]
            if s not in seen:
                seen.add(s)
                yield s

    def lay_out(self, counts: dict[int, int], slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
        """(place, from rank, to rank, shard, first slot): places in ring order, each clockwise while shards are full."""
        total = sum(counts.values())
        whole, rest = divmod(total, self.shards)
        room = [whole + (s < rest) + int(whole * slack) for s in range(self.shards)]
        used, runs = [0] * self.shards, []
        for place in sorted(counts):
            at, left = 0, counts[place]
            for s in self.walk(place):
                take = min(left, room[s] - used[s])
                if take:
                    runs.append((place, at, at + take, s, used[s]))
                    used[s] += take
                    at, left = at + take, left - take
                if not left:
                    break
        return runs


def assign(docs: DataFrame, shards: int = 8, nodes: int = 128, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(h, 48).cast("int").alias("place"), F.xxhash64(h, F.monotonically_increasing_id()).alias("lot"))
    slim = written(slim, "shard-rows")
    counts = {r["place"]: r["n"] for r in slim.groupBy("place").agg(F.count("*").alias("n")).collect()}  # one for each place at most
    runs = spark.createDataFrame(Ring(shards, nodes).lay_out(counts, slack), "place int, low long, high long, shard int, base long")
    hot = [(p, -(-n // PART_ROWS)) for p, n in counts.items() if n > PART_ROWS]
    if hot:  # so many places at most as the ring has
        parts = F.broadcast(spark.createDataFrame(hot, "place int, parts int"))
        slim = slim.join(parts, "place", "left")
    else:
        slim = slim.withColumn("parts", F.lit(1))
    slim = slim.withColumn("part", F.pmod(F.col("lot"), F.coalesce("parts", F.lit(1))).cast("int"))
    inside = Window.partitionBy("place", "part").orderBy("lot", "doc_id", "text_crc32", "size")
    ranked = slim.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    if hot:
        sizes = slim.groupBy("place", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        begin = sizes.select("place", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
        ranked = ranked.join(begin, ["place", "part"]).withColumn("rank", F.col("rank") + F.col("begin"))
    placed = ranked.join(F.broadcast(runs), "place").where("rank >= low and rank < high")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))
