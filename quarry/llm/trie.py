"""Operator 13: the trie of conversation prefixes, by one global sort.

Every turn is a SHA-256 of its role and text, so a conversation is a short array. Arrays are range-sorted over all
partitions, conv_id last, so equal conversations are spread over as many partitions as they need. A task sweeps its
rows in order: the longest common prefix (LCP) of neighbours says which nodes of the stack close and which open, and
every node is one LCP interval. Counts, leaves, children and saved tokens of an interval are sums over its rows.

Nodes on the path of a partition's first or last row may reach over its edge: they are kept under a digest of
their path, as if they began and ended in each partition. Then neighbouring partitions' LCPs, one number an edge, take
away what was counted on both sides, and the parts of a node are added up. So only edges and the stacks open at them are
ever compared between partitions, and no task holds more than its stack.

A node's list of ends is hashed where it is read. A list that is long or crosses an edge goes on as strings of CHUNK
bytes, which one task hashes in order, as SHA-256 demands; it reads ids alone and holds one string at a time.

Defined results: rows without conv_id take no part; turns of one number follow each other by digest; a conversation
without turns is a member of the root alone; repeated rows are turns of their own; other columns are ignored;
an empty table gives none. A conversation's array (40 bytes a turn) is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, crc_mod, written

#: Bytes of a string of ends, rows of an output batch.
CHUNK, OUT = 1 << 16, 4096
HEAD = 8  # most turns that can come from another conversation: the remainder of 9
EMPTY = hashlib.sha256(b"").hexdigest()

PART = (
    "kind string, p int, local long, parent long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "key binary, on_first boolean, on_last boolean, before long, first array<binary>, sums array<long>, last array<binary>"
)
ARROW = pa.schema(
    [("kind", pa.string()), ("p", pa.int32())]
    + [(c, pa.int64()) for c in ("local", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string()), ("key", pa.binary()), ("on_first", pa.bool_()), ("on_last", pa.bool_()), ("before", pa.int64())]
    + [("first", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64())), ("last", pa.list_(pa.binary()))]
)


def arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<id binary, bytes long>> in order of turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # the length tells where the role ends
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.unhex(F.sha2(own.cast("binary"), 256)).alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("t")
    )
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return one.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % 5, then c's own after its first h; h is crc32(c) % 9."""
    own = written(arrays(conversations), "conversations")
    base = own.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head"))
    h = crc_mod(F.col("conv_id"), 9).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "base", "left")
    head, rest = F.slice("head", F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(head, rest)).alias("turns"))


class Node:
    """An interval that is still open."""

    __slots__ = ("local", "id", "bytes", "before", "n", "least", "children", "leaves", "saved", "ends", "held", "chunks", "first")

    def __init__(self, local: int, own: bytes, size: int, before: int, first: bool):
        self.local, self.id, self.bytes, self.before, self.first = local, own, size, before, first
        self.n = self.children = self.leaves = self.saved = self.held = self.chunks = 0
        self.least, self.ends = None, []


class Sweep:
    """One partition's rows, in order, through the stack of open nodes."""

    def __init__(self, p: int, chunk: int = CHUNK):
        self.p, self.chunk, self.out, self.stack, self.made = p, chunk, [], [], 0
        self.first: tuple[list[bytes], list[int]] | None = None

    def row(self, conv: int, ids: list[bytes], sizes: list[int]) -> None:
        stack, fresh = self.stack, self.first is None
        if fresh:
            self.first = ids, sizes
            self._open(b"", 0, True)
            common = 0
        else:
            common, most = 0, min(len(ids), len(stack) - 1)
            while common < most and stack[common + 1].id == ids[common]:
                common += 1
        while len(stack) > common + 1:
            self._close(False)
        for d in range(common, len(ids)):
            self._open(ids[d], sizes[d], fresh)
        top = stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        shown = str(conv)
        top.ends.append(shown)
        top.held += len(shown) + 1
        if top.held >= self.chunk:
            self._chunk(top, self._key(len(stack) - 1))

    def _open(self, own: bytes, size: int, first: bool) -> None:
        up = self.stack[-1] if self.stack else None
        self.stack.append(Node(self.made, own, size, up.before + up.bytes if up else 0, first))
        self.made += 1

    def _key(self, depth: int) -> bytes:
        return hashlib.sha256(b"".join(n.id for n in self.stack[1 : depth + 1])).digest()

    def _chunk(self, node: Node, key: bytes) -> None:
        self._emit("ends", local=node.chunks, ends=",".join(node.ends), key=key)
        node.ends, node.held, node.chunks = [], 0, node.chunks + 1

    def _close(self, at_end: bool) -> None:
        depth = len(self.stack) - 1
        node = self.stack[-1]
        key = self._key(depth) if at_end or node.first or node.chunks else None
        self.stack.pop()
        up = self.stack[-1] if self.stack else None
        node.saved += (node.n - 1) * node.bytes
        node.leaves = node.leaves or 1
        if up:
            up.n, up.children, up.leaves, up.saved = up.n + node.n, up.children + 1, up.leaves + node.leaves, up.saved + node.saved
            up.least = node.least if up.least is None else min(up.least, node.least)
        ends = None
        if key is None:
            ends = hashlib.sha256(",".join(node.ends).encode()).hexdigest()
        elif node.ends:
            self._chunk(node, key)
        self._emit(
            "node", local=node.local, parent=up.local if up else None, depth=depth, conv_id=node.least, n_convs=node.n, n_children=node.children,
            n_leaves=node.leaves, saved_tokens=node.saved, ends=ends, key=key, on_first=node.first, on_last=at_end, before=node.before,
        )

    def close(self) -> None:
        """After the last row: all that is open reaches the edge."""
        if self.first is None:
            return
        ids, sizes = self.first
        sums = [0]
        for s in sizes:
            sums.append(sums[-1] + s)
        self._emit("edge", first=ids, sums=sums, last=[n.id for n in self.stack[1:]])
        while self.stack:
            self._close(True)

    def _emit(self, kind: str, **values) -> None:
        values.update(kind=kind, p=self.p)
        self.out.append(values)

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


def _swept(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(TaskContext.get().partitionId(), chunk)
        for b in batches:
            lists = b.column(1)
            at, values = lists.offsets.to_pylist(), lists.values
            ids, sizes = values.field("id").to_pylist(), values.field("bytes").to_pylist()
            for i, conv in enumerate(b.column(0).to_pylist()):
                sweep.row(conv, ids[at[i] : at[i + 1]], sizes[at[i] : at[i + 1]])
                if len(sweep.out) >= OUT:
                    yield sweep.taken()
        sweep.close()
        yield sweep.taken()

    return run


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 of strings that come in order of key and place."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for b in batches:
        for k, s in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if k != key:
                if digest is not None:
                    yield done()
                key, digest = k, hashlib.sha256(s.encode())
            else:
                digest.update(b"," + s.encode())
    if digest is not None:
        yield done()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(rebuilt(conversations))


def trie(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of conv_id, turns (array of id and bytes), one row for each conv_id."""
    spark = sequences.sparkSession
    bounded_batches(spark)
    ordered = written(sequences, "sequences").repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    parts = written(ordered.mapInArrow(_swept(chunk), PART), "trie-parts")

    # One row for each partition that has rows: what its first row shares with the row before, and its last with the next.
    edges = parts.where("kind = 'edge'").select("p", "first", "sums", "last")
    order = Window.orderBy("p")
    shared = edges.withColumn("shared", _common(F.col("first"), F.lag("last").over(order)))
    next_ = F.lead("shared").over(order)
    edges = shared.select("p", "shared", F.element_at("sums", F.col("shared") + 1).alias("sum_shared"), (next_ == F.size("last")).alias("goes_on"))

    nodes = parts.where("kind = 'node'")
    open_ = nodes.where("key is not null").join(edges, "p")
    over = F.col("on_first") & (F.col("depth") <= F.coalesce("shared", F.lit(-1)))
    fixed = open_.select(
        "key", "depth", "conv_id", "n_convs", F.struct("p", "parent").alias("up"),
        (F.col("n_children") - F.when(F.col("on_first") & (F.col("depth") < F.col("shared")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("on_last") & F.col("goes_on"), 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(over, F.col("sum_shared") - F.col("before")).otherwise(0)).alias("saved_tokens"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = fixed.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.min("up").alias("up"))
    listed = parts.where("kind = 'ends'").select("key", "p", "local", "ends").repartition("key").sortWithinPartitions("key", "p", "local")
    whole = written(whole.join(listed.mapInArrow(_hashed, "key binary, ends_sha256 string"), "key", "left"), "trie-open")

    inner = nodes.where("key is null")
    named = inner.select("p", "local", "conv_id").unionByName(nodes.where("key is not null").select("p", "local", "key").join(whole.select("key", "conv_id"), "key").select("p", "local", "conv_id"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    all_ = inner.select(*columns, F.col("ends").alias("ends_sha256"), "p", "parent").unionByName(
        whole.select(*columns, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "up.p", "up.parent")
    )
    parents = named.select("p", F.col("local").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return all_.join(parents, ["p", "parent"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
