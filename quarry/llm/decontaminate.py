"""Operator 4: benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

An item is cut into windows of 10 consecutive words (an item of fewer words is one window), a window
into shingles of 3 words. A document holds a window only if it holds every one of its shingles, so
containment of 1 needs a prefix of one token: the shingle that is rarest in the documents. Windows
with a shingle that no document has are out at once. The join on that shingle gives the place where
the window would begin (positional bound: not before the text; length bound: not past its end), and
each candidate is verified shingle by shingle over the whole window. The join and the verification
are on the words themselves; hashes only pre-select.

Defined results: null and empty texts have no words and no hits; an item without words has no window;
repeated items count once by item_id; repeated document rows each give a row; null item_ids are left
out; extra columns are ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.grams import positions, words


def windows(benchmark: DataFrame, width: int = 10, shingle: int = 3, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """windows (wid, length, size, grams) and members (wid, item_id); wid: the words, space-joined."""
    split = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), words(F.coalesce(F.col(text), F.lit(""))).alias("words")).where("size(words) > 0")
    cut = split.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(words) - {width}, 0)), i -> slice(words, i + 1, {width}))")).alias("words"))
    cut = written(cut.select("item_id", "words", F.array_join("words", " ").alias("wid")).distinct(), "windows")
    size = F.least(F.size("words"), F.lit(shingle))
    named = cut.select("wid", "words", F.size("words").alias("length"), size.alias("size")).distinct()
    grams = F.expr("transform(sequence(0, length - size), i -> array_join(slice(words, i + 1, size), ' '))")
    return named.select("wid", "length", "size", grams.alias("grams")), cut.select("wid", "item_id")


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """rows (rid, doc_id, n_words) and spans (rid, start, length, wid, item_id): every window's every place."""
    wins, members = windows(benchmark, width, shingle)
    tokens = wins.select("wid", "length", "size", F.posexplode("grams").alias("offset", "g"))
    rows, matches = positions(docs, tokens, "decontaminate")
    rarity = matches.groupBy("size", "g").agg(F.count("*").alias("n"))
    ranked = tokens.join(rarity, ["size", "g"], "left").groupBy("wid", "length", "size").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "g", "offset")).alias("rarest"))
    prefix = ranked.where("absent = 0").select("wid", "length", "size", F.col("rarest.g").alias("g"), F.col("rarest.offset").alias("offset")).join(wins.select("wid", "grams"), "wid")
    start = (F.col("pos") - F.col("offset")).alias("start")
    candidates = matches.join(prefix, ["size", "g"]).select("rid", start, "n_words", "length", "wid", "grams").where("start >= 0 and start + length <= n_words")
    steps = candidates.select("rid", "start", "length", "wid", F.size("grams").alias("need"), F.posexplode("grams").alias("k", "g")).withColumn("pos", F.col("start") + F.col("k"))
    verified = steps.join(matches.select("rid", "pos", "g"), ["rid", "pos", "g"]).groupBy("rid", "start", "length", "wid", "need").agg(F.count("*").alias("have")).where("have = need")
    spans = written(verified.select("rid", "start", "length", "wid"), "decontaminate-spans")
    return rows, spans.join(members, "wid").select("rid", "start", "length", "wid", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """rid, doc_id, n_words, n_hit (words inside some span), items (array of item_id strings, sorted) of every row."""
    rows, spans = benchmark_spans(docs, benchmark, width, shingle)
    places = spans.select("rid", "start", "length").distinct()
    covered = places.select("rid", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    items = spans.select("rid", F.col("item_id").cast("string").alias("item")).distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return rows.join(covered, "rid", "left").join(items, "rid", "left").select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """The rows without a hit word. Each row is judged by its own text, whatever its doc_id."""
    row = "_row" + "_" * max(map(len, docs.columns))  # clashes with no column
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-docs")
    hit = contamination(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, width, shingle).where("n_hit > 0").select(F.col("doc_id").alias(row))
    return numbered.join(written(hit, "decontaminate-hit"), row, "left_anti").select(*docs.columns)
