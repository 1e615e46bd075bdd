"""Documents to chunks with provenance, and the native line and section operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import splitting
from quarry.functions import text as T

LINES = "array<struct<line_no:int,line:string,start:long,stop:long>>"
#: Texts that are cut at one time.
TEXTS = 256
CHUNK = "array<struct<chunk_index:int,start:int,end:int,text:string,section_index:int,section_title:string>>"


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """One row a chunk: the document's columns but page_content, and the chunk's text and provenance.

    docs has page_content, source_url, title and page_number; other columns come along. Narrow: a
    document is cut where it lies, and identities are computed natively.
    """

    @F.pandas_udf(CHUNK)
    def cut(bodies: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([splitting.chunks(b, t, size, overlap) for b, t in zip(bodies, titles)])

    kept = [c for c in docs.columns if c != "page_content"]
    cut_up = docs.withColumn("_c", F.explode(cut("page_content", "title"))).select(*kept, "_c.*")
    doc, content = T.source_doc_id(F.col("source_url"), F.col("page_number")), T.short_hash(F.col("text"))
    return cut_up.select(
        *kept,
        F.col("text").alias("page_content"),
        doc.alias("source_doc_id"),
        T.chunk_id(doc, F.col("chunk_index"), content).alias("chunk_id"),
        "chunk_index",
        "section_index",
        "section_title",
        T.section_path(F.col("title"), F.col("section_title")).alias("section_path"),
        F.col("start").alias("chunk_start_char"),
        F.col("end").alias("chunk_end_char"),
        F.length("text").alias("chunk_char_count"),
        content.alias("chunk_content_hash"),
        F.lit(splitting.STRATEGY).alias("chunking_strategy"),
        F.lit(size).alias("chunk_size"),
        F.lit(overlap).alias("chunk_overlap"),
    )


def _lines(text: Column) -> Column:
    """Non-blank lines of the normalised text, whose lines end in \\n: array of line_no, line, start, stop. In the row and linear: offsets
    are running sums, which Spark's array functions build only by copying the array for every line."""

    @F.arrow_udf(LINES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [_lines_of(b.slice(low, TEXTS).to_pylist()) for low in range(0, len(b), TEXTS)]
            yield pa.concat_arrays(parts) if parts else _lines_of([])

    return cut(text)


def _lines_of(bodies: list[str | None]) -> pa.ListArray:
    """The lines of some texts. Those of one text at a time are Python objects, the others are columns."""
    kinds, offsets, parts = [pa.int32(), pa.string(), pa.int64(), pa.int64()], [0], []
    for body in bodies:
        spans = _line_spans(body)
        offsets.append(offsets[-1] + len(spans))
        if spans:
            parts.append([pa.array(c, t) for c, t in zip(zip(*spans), kinds)])
    columns = [pa.concat_arrays(c) for c in zip(*parts)] if parts else [pa.array([], t) for t in kinds]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["line_no", "line", "start", "stop"]))


def _line_spans(text: str | None) -> list[tuple[int, str, int, int]]:
    out, at = [], 0
    for n, raw in enumerate(splitting.normalise(text or "").split("\n")):
        if line := raw.strip():
            start = at + len(raw) - len(raw.lstrip())
            out.append((n, line, start, start + len(line)))
        at += len(raw) + 1
    return out


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line, start, stop of every non-blank line of every row: rows of one key have lines of their own. Narrow."""
    one = docs.select(key, F.explode_outer(_lines(F.col(text))).alias("x")).where("x is not null")
    return one.select(key, "x.*")


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return lines(docs, key, text).where(T.is_heading(F.col("line")))


def section_bounds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section_index, title (null: the document's own), start, stop: from a heading to the next one, for every row by itself. Narrow."""
    rows = docs.select(key, _lines(F.col(text)).alias("lines"), F.length(T.normalised(F.col(text))).cast("long").alias("size"))
    rows = rows.select(key, "size", F.filter("lines", lambda x: T.is_heading(x["line"])).alias("heads"))
    own = F.struct(F.lit(None).cast("string").alias("title"), F.lit(0).cast("long").alias("start"))
    named = F.transform("heads", lambda x: F.struct(x["line"].alias("title"), x["start"].alias("start")))
    begins = F.when(F.coalesce(F.get(F.col("heads"), 0)["start"], F.lit(1)) > 0, F.concat(F.array(own), named)).otherwise(named)
    rows = rows.where("size > 0").select(key, "size", begins.alias("begins"))
    ends = F.concat(F.transform(F.slice("begins", 2, F.size("begins")), lambda x: x["start"]), F.array("size"))
    spans = F.zip_with("begins", ends, lambda x, stop: F.struct(x["title"].alias("title"), x["start"].alias("start"), stop.alias("stop")))
    return rows.select(key, F.posexplode_outer(spans).alias("section_index", "x")).where("x is not null").select(key, "section_index", "x.*")


def section_of_chunk(chunks: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds section_index to chunks (key, chunk_index, start, stop): the section with the largest
    overlap, the first of equals; else the last that begins before the chunk; else the first.

    A key is one document: its sections (at least one, else its chunks go) don't overlap and are numbered by where they begin. One sort of a
    document's places tells which sections a chunk can meet, and only these are looked up, so pairs grow with chunks
    and sections, not with their product.
    """
    ids = [key, "chunk_index", "start", "stop"]
    none = F.lit(None)
    # at one place, chunks that end here come before the section that begins here, chunks that begin here after it
    place = lambda at, turn: F.struct(F.col(at).cast("long").alias("at"), F.lit(turn).alias("turn"))
    ends = chunks.select(*ids, F.explode(F.array(place("stop", 0), place("start", 2))).alias("place"), none.cast("int").alias("s_index"))
    begins = sections.select(key, *(none.cast(t).alias(c) for c, t in chunks.select(*ids[1:]).dtypes), place("start", 1).alias("place"), F.col("section_index").cast("int").alias("s_index"))
    whole = Window.partitionBy(key)
    met = ends.unionByName(begins).withColumn("least", F.min("s_index").over(whole))
    met = met.withColumn("before", F.max("s_index").over(whole.orderBy("place"))).where("place.turn <> 1 and least is not null")
    of_place = lambda turn: F.max(F.when(F.col("place.turn") == turn, F.col("before")))
    each = met.groupBy(*ids, "least").agg(of_place(2).alias("low"), of_place(0).alias("high")).withColumn("else", F.coalesce("low", "least"))
    pairs = each.select(*ids, "low", F.explode(F.sequence("else", F.greatest("else", "high"))).alias("s_index"))
    s = sections.select(key, F.col("section_index").cast("int").alias("s_index"), F.col("start").alias("s_start"), F.col("stop").alias("s_stop"))
    shared: Column = F.greatest(F.least("stop", "s_stop") - F.greatest("start", "s_start"), F.lit(0))
    tie = F.when(shared > 0, -F.col("s_index")).when(F.col("s_index") == F.coalesce("low", F.lit(-1)), 0).otherwise(-1 - F.col("s_index"))
    return pairs.join(s, [key, "s_index"]).groupBy(*ids).agg(F.max_by("s_index", F.struct(shared.alias("shared"), tie.alias("tie"))).alias("section_index"))
