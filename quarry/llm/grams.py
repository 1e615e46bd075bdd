"""Words and word k-grams of whole texts in DataFrame functions, and where given k-grams stand.

One pass over the texts finds the positions of all given k-grams and writes them as a small table
with one row for each document row; everything after works on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import texts, written

#: A word is a run of characters outside these (after A-Z are lower-cased).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many different k-grams are looked up in a set inside the scan.
SET_SIZE = 20_000
#: Up to so many hashes of k-grams are broadcast, to be joined where the texts are read; with more, all k-grams are shuffled.
BROADCAST_KEYS = 4_000_000


def lowered(text: Column) -> Column:
    """A-Z only. A text of single-byte characters takes the quick function, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def gram(size: int, at: str = "i") -> str:
    return "xxhash64(" + ", ".join(f"get(words, {at} + {k})" for k in range(size)) + ")"


def hits_in(size: int, keys: list[int]) -> str:
    """SQL: array of (pos, size, g) for the k-grams whose hash is a key; g: the words, space-joined."""
    listed = ", ".join(f"{k}L" if k != -(2**63) else "(-9223372036854775807L - 1L)" for k in keys)
    found = f"filter(sequence(0, size(words) - {size}), i -> {gram(size)} in ({listed}))"
    joined = f"array_join(slice(words, i + 1, {size}), ' ')"
    some = f"transform({found}, i -> named_struct('pos', i, 'size', {size}, 'g', {joined}))"
    return f"if(size(words) >= {size}, {some}, array())"


def positions(docs: DataFrame, grams: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (rid, doc_id, n_words), one for each row of docs, and matches (rid, n_words, pos, size, g).

    grams: size int, g string, the k-grams sought. Null texts have no words.
    """
    sought = grams.select("size", "g").distinct()
    hashed = sought.withColumn("h", F.expr("case " + " ".join(f"when size = {k} then {gram_of_text(k)}" for k in range(1, 11)) + " end"))
    sizes = [r["size"] for r in sought.select("size").distinct().orderBy("size").limit(11).collect()]
    few = hashed.select("size", "h").distinct().limit(SET_SIZE + 1).collect()
    base = texts(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("words"))
    if len(few) <= SET_SIZE:
        arrays = [hits_in(k, sorted({r.h for r in few if r["size"] == k})) for k in sizes]
        hits = F.expr("concat(" + ", ".join(arrays) + ")" if arrays else "cast(array() as array<struct<pos:int,size:int,g:string>>)")
        found = written(base.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), name)
        rows = found.select("rid", "doc_id", "n_words")
        matches = found.select("rid", "n_words", F.explode("hits").alias("x")).select("rid", "n_words", "x.*")
    else:
        kept = written(base, name + "-words")
        rows = kept.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"))
        every = None
        for k in sizes:
            cut = F.expr(f"transform(sequence(0, size(words) - {k}), i -> named_struct('pos', i, 'size', {k}, 'h', {gram(k)}, 'g', array_join(slice(words, i + 1, {k}), ' ')))")
            one = kept.where(F.size("words") >= k).select("rid", F.size("words").cast("long").alias("n_words"), F.explode(cut).alias("x")).select("rid", "n_words", "x.*")
            every = one if every is None else every.unionByName(one)
        hashes = written(hashed.select("h").distinct(), name + "-keys")
        if hashes.count() <= BROADCAST_KEYS:  # eight bytes each
            every = every.join(F.broadcast(hashes), "h", "left_semi")
        matches = written(every.join(sought, ["size", "g"], "left_semi").select("rid", "n_words", "pos", "size", "g"), name)
    return rows, matches


def gram_of_text(size: int) -> str:
    return "xxhash64(" + ", ".join(f"get(split(g, ' '), {k})" for k in range(size)) + ")"
