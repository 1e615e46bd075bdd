"""Near copies in the pipeline: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash: operator 5's fingerprints of 5-word shingles are posted under each choice of 3 of their 8
positional bytes, so those within 5 bits meet for certain and wider ones often. A list compares its members,
in order, with the one before and with the first; pairs within 12 bits are verified on the whole sets.

Pairs of similarity 0.8 differ by some 10 bits of 64, up to more than an index can guarantee, so a set join
completes the components. It is exact, up to 64-bit hashes of shingles and sets. Documents of equal sets are one node. Shingles
have one global order, by how many texts hold them, rare ones first, as counters of fixed number over the whole table tell; two sets of similarity 0.8 meet in the
first n - ceil(0.8 n) + 1 shingles of both, so nodes are posted under these only. A list is not expanded into
its pairs: member by member, in the order of nodes so that lists of one group begin alike, it gives the pairs with
the members after, as far as size and position allow them, until they pass a number in proportion to its length.
These are verified, components grow, and in the next round the list goes on from there, four times as far, with
the pairs only whose members are not in one component yet: what is left out cannot change a component. A group
of near copies is thus joined by a few pairs a member; a list ends when it is one component or all was given.
Texts that share much with a large group but are similar to none of it would still be tried against every
member. So before long lists go on, the whole sets of their members are laid side by side, in one pass: what of a
set stands in no other component there is in common with no partner, and sets with too much of that leave.
Pairs are first compared by parity sketches, a bit for each bucket of hashes: odd buckets in which two sets
differ hold different members, so too many of them rule a pair out for certain. What remains is verified on the
whole sets.

Defined results: words as in operator 5; a text of fewer words than a shingle is one shingle; texts without
words (null ones too) have equal sets; of a group the smallest doc_id stays, null keys last, then by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, forget, giving_back, written
from quarry.llm.components import connected
from quarry.llm.simhash import fingerprint

WORDS = 5
#: Positional bytes that fingerprints share to meet, bits that they differ by at most to be verified.
SHARED, APART = 3, 12
#: Counters of shingles, of a block of them; tasks whose counts are added up by one group.
COUNTERS, BLOCK, FAN = 1 << 23, 1 << 18, 32
NAMES = ["block", "part", "v", "least", "total"]
#: Members of a list that gives all pairs at once; nodes that are broadcast.
SHORT, LOOKED_UP = 3, 200_000
#: Members of a list that is not narrowed; places of shingles that stand in several components: blocks, and places of each.
LONG = 16
BLOCKS, PLACES = 1 << 6, 1 << 20
#: Rounds after which a list has given every pair, whatever its length.
ALL = 31


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.int64)
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)))) if len(parts) > words else [b" ".join(parts)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64)).view(np.int64)


def similar(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m with so many common members have a similarity of 0.8 or more, in whole numbers."""
    return 9 * common >= 4 * (n + m)


def sketch(s: np.ndarray) -> bytes:
    """A bit for each bucket of hashes: whether its members are odd in number. As many buckets as members or more."""
    size = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def differences(a: bytes, b: bytes) -> int:
    """Members that are in one of two sets only: so many at least."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def counter(s: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each shingle, of so many (a power of two), by the upper bits of its hash."""
    return (s.view(np.uint64) >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest one needs: 1, 2 or 4, which it may fill."""
    top = int(x.max(initial=0))
    return np.minimum(x, 2**32 - 1).astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def widened(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"<u{len(x) // n}")


def counted(numbered: DataFrame) -> DataFrame:
    """block, v, least, total: how many texts hold shingles of each counter, over the whole table, in blocks of BLOCK counters.

    A task counts its own texts; counts of FAN tasks at most meet in one group, then those of FAN such groups, until one is left.
    """
    kept = "block int, part int, v binary, least long, total long"

    def rows_of(block: list[int], part: list[int], counts: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(map(narrow, counts), pa.binary()), *(pa.array([int(f(x.astype(np.int64))) for x in counts], pa.int64()) for f in (np.min, np.sum))]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, part = np.zeros(COUNTERS, np.uint32), TaskContext.get().partitionId()
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(held, counter(shingle_set(t), COUNTERS), 1)
        for block, own in enumerate(held.reshape(-1, BLOCK)):
            if own.any():
                yield pa.RecordBatch.from_arrays(rows_of([block], [part], [own]), names=NAMES)

    def added(key, rows):
        out = np.zeros(BLOCK, np.uint64)
        for v in rows.column("v"):
            out += widened(v.as_buffer().to_pybytes(), BLOCK)
        return pa.table(rows_of(*([k.as_py()] for k in key), [out]), names=NAMES)

    parts = written(numbered.select("text").mapInArrow(run, kept), "near-counts")
    left, sums = (parts.agg(F.max("part")).first()[0] or 0) + 1, parts
    while left > 1:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(added, kept)
        left = -(-left // FAN)
    table = written(sums.select("block", "v", "least", "total"), "near-counters")
    forget(parts)
    return table


def rarity(numbered: DataFrame) -> np.ndarray:
    """A byte for each counter, larger where more texts hold its shingles: linear above the least count, in quarters of what
    chance spreads counts by, then by logarithm. Of fixed size. Any order of shingles gives right results, so that
    shingles share counters only makes some lists longer."""
    table = counted(numbered)
    one = table.agg(F.count("*").alias("n"), F.min("least").alias("least"), F.sum("total").alias("total")).first()
    least = one.least if one.n == COUNTERS // BLOCK else 0
    unit = max(1.0, ((one.total or 0) / COUNTERS) ** 0.5 / 4)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = (widened(v, BLOCK) - float(least)) / unit
                out.append(np.where(x < 128, x, np.minimum(255, 128 + 4 * np.log2(np.maximum(x, 128) / 128))).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["block", "v"])

    codes = np.zeros(COUNTERS, np.uint8)
    for row in table.select("block", "v").mapInArrow(run, "block int, v binary").toLocalIterator():  # the counters, in blocks
        codes[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.v, np.uint8)
    forget(table)
    return codes


def prefixes(numbered: DataFrame, codes: np.ndarray) -> DataFrame:
    """rid, doc_id, node (hash of the set), n, sketch, fp, first (the shingles it is posted under) of every row."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            nodes, sizes, sketches, fps, first = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 7) - 2**63)
                sizes.append(len(s))
                sketches.append(sketch(s))
                fps.append(fingerprint(t or "", WORDS))
                s = s[np.lexsort((s, codes[counter(s, len(codes))]))]
                # a set of one shingle is similar to an equal set only, which is the same node
                first.append(s[: len(s) - (4 * len(s) + 4) // 5 + 1] if len(s) > 1 else s[:0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(fps, pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["rid", "doc_id", "node", "n", "sketch", "fp", "first"])

    return numbered.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, node long, n int, sketch binary, fp long, first array<long>")


def fingerprint_pairs(reps: DataFrame) -> DataFrame:
    """a, b: pairs of nodes that share SHARED bytes of their fingerprints and differ by APART bits at most, some of a list's."""
    masks = [sum(0xFF << (8 * p) for p in c) for c in combinations(range(8), SHARED)]
    keys = F.array(*(F.struct(F.lit(k).cast("int").alias("k"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("shared")) for k, m in enumerate(masks)))
    dealt = reps.where("n > 1").select("node", "fp").repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posted = dealt.select("node", "fp", F.explode(keys).alias("p")).select("node", "fp", "p.shared", "p.k")
    # most lists have one member: a sort finds that without an object for each list
    own, each = F.struct("fp", "node"), Window.partitionBy("shared", "k").orderBy("fp", "node")
    beside = posted.select(own.alias("y"), F.lag(own).over(each).alias("before"), F.first(own).over(each).alias("least")).where("before is not null")
    met = beside.select("y", F.explode(F.array("before", "least")).alias("x"))
    return met.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= APART).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def short_pairs(which: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lists of SHORT members at most that may be similar and have different roots. which: the list of each member."""
    order = np.lexsort((node, n, which))
    which, node, n, place, root = (x[order] for x in (which, node, n, place, root))
    i = np.arange(len(node))
    for gap in range(1, SHORT):
        i = i[i + gap < len(node)]
        i = i[(which[i] == which[i + gap]) & (n[i + gap] <= n[i] * 5 // 4)]  # sizes ascend: what fails here fails at wider gaps
        if not len(i):
            return
        j = i + gap
        fits = (root[i] != root[j]) & similar(n[i], n[j], np.minimum(n[i] - place[i], n[j] - place[j]))
        yield np.minimum(node[i], node[j])[fits], np.maximum(node[i], node[j])[fits]


def long_pairs(node: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, at: int, tried: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for one longer list, from its member number at on, until half its length by 4 ** tried is passed: next at, pairs."""
    order = np.lexsort((node, n))
    node, n, place, root = node[order], n[order], place[order], root[order]
    low, high = np.searchsorted(n, -(-4 * n // 5)), np.searchsorted(n, n * 5 // 4, "right")
    given, most = 0, len(node) * 4**tried // 2
    for k, i in enumerate(np.argsort(node)[at:].tolist(), at + 1):
        js = np.arange(low[i], high[i])
        common = np.minimum(n[i] - place[i], n[js] - place[js])  # where a pair meets first, it has no more in common
        js = js[(node[js] > node[i]) & (root[js] != root[i]) & similar(n[i], n[js], common)]
        yield k, np.full(len(js), node[i]), node[js]
        given += len(js)
        if given >= most:
            return


def columns(members: pa.StructArray) -> list[np.ndarray]:
    """node, n, place, root of members, the node itself for a null root."""
    return [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (members.field("node"), members.field("n"), members.field("place"), pc.coalesce(members.field("root"), members.field("node")))]


def candidates(lists: DataFrame, tried: int) -> DataFrame:
    """a, b: pairs of nodes to be verified, each once. lists: s, members of (node, n, place, root), root null without links."""

    def pairs(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node, n, place, root = columns(column.flatten())
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        which, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
        short = (sizes <= SHORT)[which]
        yield from short_pairs(*(x[short] for x in (which, node, n, place, root)))
        for k in np.flatnonzero(sizes > SHORT):
            own = slice(ends[k] - sizes[k], ends[k])
            for _, a, b in long_pairs(node[own], n[own], place[own], root[own], 0, tried):
                yield a, b

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out, held = [], [], 0
        for batch in batches:
            for a, b in pairs(batch.column(0)):
                a_out.append(a)
                b_out.append(b)
                held += len(a)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
                    a_out, b_out, held = [], [], 0
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return lists.select("members").mapInArrow(run, "a long, b long").distinct()


def unfinished(lists: DataFrame, tried: int) -> DataFrame:
    """s, node, n, place: the members that lists still have pairs to give of after candidates()."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.empty(0, np.int64)] for _ in range(4)]
            for s, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                node, n, place, root = columns(members.values)
                at = 0
                for at, _, _ in long_pairs(node, n, place, root, 0, tried):
                    pass
                rest = np.argsort(node)[at:]  # those before are no partners of theirs
                node, n, place, root = (x[rest] for x in (node, n, place, root))
                left = np.zeros(len(node), bool)
                for k, _, others in long_pairs(node, n, place, root, 0, ALL):
                    left[np.searchsorted(node, others)] = True
                    left[k - 1] |= len(others) > 0
                for o, x in zip(out, (np.full(len(node), s), node, n, place)):
                    o.append(x[left])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["s", "node", "n", "place"])

    return lists.where(F.size("members") > SHORT).select("s", "members").mapInArrow(run, "s long, node long, n int, place int")


def gathered(flat: DataFrame) -> DataFrame:
    """s, members of flat (s, node, n, place, root), but for lists of one component."""
    every = flat.groupBy("s").agg(F.collect_list(F.struct("node", "n", "place", "root")).alias("members"))
    return every.where(F.size(F.array_distinct(F.transform("members", lambda m: F.coalesce(m["root"], m["node"])))) > 1)


def sets_of(nodes: DataFrame, numbered: DataFrame, reps: DataFrame) -> DataFrame:
    """nodes (node and other longs) with s, the whole set."""
    own = nodes.columns

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.list_(pa.int64()))], names=[*own, "s"])

    sought = written(reps.select("rid", "node").join(nodes, "node").select("rid", *own), "near-sought")
    few = sought.count() <= LOOKED_UP
    texts = numbered.select("rid", "text").join(F.broadcast(sought) if few else sought, "rid").select("text", *own)
    sets = written(texts.mapInArrow(run, ", ".join(f"{k} long" for k in own) + ", s array<long>"), "near-sets")
    forget(sought)
    return sets


def shared_places(sets: DataFrame) -> np.ndarray:
    """Bits, packed: whether shingles of a place, by their hash, stand in sets (root, s) of two roots or more. Of fixed size.

    What the sets of a batch have in common is merged there; a row is a block of places, not a shingle. Shingles are told apart by
    the whole hash; those that share a place only add to what seems to be shared.
    """

    def least_most(s: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((s, s & (BLOCKS - 1)))
        s, low, high = s[order], low[order], high[order]
        begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        return s[begin], np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(1).flatten().to_numpy(zero_copy_only=False)
            if not len(s):
                continue
            root = np.repeat(b.column(0).to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            merged_ = least_most(s, root, root)
            block, begin = np.unique(merged_[0] & (BLOCKS - 1), return_index=True)
            cut = list(zip(begin.tolist(), [*begin[1:].tolist(), len(merged_[0])]))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in merged_)], names=["block", "s", "low", "high"])

    def marked(key, rows):
        s, low, high = least_most(*(np.frombuffer(b"".join(rows.column(k).to_pylist()), np.int64) for k in ("s", "low", "high")))
        bits = np.zeros(PLACES, bool)
        bits[(s[low != high] >> (BLOCKS.bit_length() - 1)) & (PLACES - 1)] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    blocks = sets.select("root", "s").mapInArrow(run, "block int, s binary, low binary, high binary").groupBy("block").applyInArrow(marked, "block int, v binary")
    out = np.zeros((BLOCKS, PLACES // 8), np.uint8)
    for row in blocks.toLocalIterator():  # BLOCKS rows at most
        out[row.block] = np.frombuffer(row.v, np.uint8)
    return out


def elsewhere(lists: DataFrame, numbered: DataFrame, reps: DataFrame) -> DataFrame:
    """node, most: how many members of its set stand in sets of other components too, at most, of nodes of the lists."""
    open_ = lists.select(F.explode("members").alias("m")).select("m.node", F.coalesce("m.root", "m.node").alias("root")).distinct()
    sets = sets_of(open_, numbered, reps)
    places = shared_places(sets)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(1).flatten().to_numpy(zero_copy_only=False)
            at = (s >> (BLOCKS.bit_length() - 1)) & (PLACES - 1)
            hit = places[s & (BLOCKS - 1), at >> 3] >> (at & 7).astype(np.uint8) & 1
            ends = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            most = np.diff(np.r_[0, np.r_[0, np.cumsum(hit, dtype=np.int64)][ends]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(most, pa.int32())], names=["node", "most"])

    found = written(sets.select("node", "s").mapInArrow(run, "node long, most int").where("most > 0"), "near-elsewhere")
    forget(sets)
    return found


def narrowed(lists: DataFrame, numbered: DataFrame, reps: DataFrame) -> DataFrame:
    """The lists; those over LONG without members whose sets hold too much that stands nowhere else, which place counts, too."""
    long = lists.where(F.size("members") > LONG)
    if long.isEmpty():
        return lists
    most = elsewhere(long, numbered, reps)
    flat = long.select("s", F.explode("members").alias("m")).select("s", "m.*").join(most, "node")
    flat = flat.withColumn("place", F.greatest("place", F.col("n") - F.col("most")))
    fit = flat.where(similar(F.col("n"), F.ceil(F.col("n") * 4 / 5), F.col("n") - F.col("place")))  # with the smallest partner
    less = written(lists.where(F.size("members") <= LONG).select("s", "members").unionByName(gathered(fit)), "near-lists")
    forget(lists, most)
    return less


def verified(pairs: DataFrame, numbered: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs a, b whose whole sets are similar. reps: node, the row (rid) that stands for it, n, sketch."""
    of = {k: reps.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab"}

    @giving_back
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_b, (n, m, x, y) = b.select(["a", "b"]), (b.column(k).to_pylist() for k in ("n_a", "n_b", "sketch_a", "sketch_b"))
            yield a_b.filter(pa.array([9 * differences(p, q) <= i + j for i, j, p, q in zip(n, m, x, y)], pa.bool_()))

    pairs = written(pairs.join(of["a"], "a").join(of["b"], "b").mapInArrow(likely, "a long, b long"), "near-likely")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), numbered, reps)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    found = written(both.where(similar(F.size("s_a"), F.size("s_b"), common)).select("a", "b"), "near-links")
    forget(pairs, sets)
    return found


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) with more links a, b: only the roots that these join go through rounds again."""
    for k in "ab":
        links = links.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
    more = connected(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left")
    return written(moved.select("node", F.coalesce("now", "root").alias("root")).unionByName(more), "near-roots")


def near_groups(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (rid, doc_id, node) of every row of numbered (rid, doc_id, text), and roots (node, root) of nodes that have links."""
    bounded_batches(numbered.sparkSession)
    rows = written(prefixes(numbered, rarity(numbered)), "near-rows")
    reps = written(rows.groupBy("node").agg(F.min(F.struct("rid", "n", "sketch", "fp")).alias("x")).select("node", "x.*"), "near-nodes")
    prints = written(fingerprint_pairs(reps), "near-prints")
    roots = connected(verified(prints, numbered, reps))
    once = rows.groupBy("node").agg(F.min(F.struct("rid", "n", "first")).alias("x"))
    posted = once.join(roots, "node", "left").select("node", "x.n", "root", F.posexplode("x.first").alias("place", "s"))
    # most shingles of prefixes are in one text: they leave before lists are made
    met = posted.withColumn("members", F.count("*").over(Window.partitionBy("s"))).where("members > 1").drop("members")
    lists = written(gathered(met), "near-lists")
    pairs, tried = prints, 0
    while not lists.isEmpty():
        more = written(candidates(lists, tried).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            roots = merged(roots, verified(more, numbered, reps))
        rest = written(gathered(unfinished(lists, tried).join(roots, "node", "left")), "near-lists")
        forget(lists)
        lists, tried = narrowed(rest, numbered, reps), tried + 1
    return rows.select("rid", "doc_id", "node"), roots


def keep_one_near(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies."""
    numbered = written(docs.withColumn("rid", F.monotonically_increasing_id()), "near-docs")
    rows, roots = near_groups(numbered)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    of_node = rows.groupBy("node").agg(best).join(roots, "node", "left")
    kept = of_node.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.rid")
    return numbered.join(written(kept, "near-kept"), "rid", "left_semi").select(*docs.columns)
