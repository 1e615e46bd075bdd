"""Incremental ingest: new and changed pages from a growing folder; a page's chunks are those of its latest text.

The checkpoint is the resume log; a batch that runs again changes nothing, since chunks are known by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.html import clean_html_column
from quarry.operators.chunking import chunk_documents
from quarry.plans.config import Config
from quarry.sources.shared import written
from quarry.sources.store import Embedder, VectorStore

PAGE = "page_id long, url string, html string"


def stream(spark: SparkSession, folder: str, store: VectorStore, embed: Embedder, checkpoint: str, config: Config = Config(), once: bool = True) -> StreamingQuery:
    """Pages (Parquet files of page_id, url, html) to the store, file by file as they come."""

    def add(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("url").agg(F.max_by("html", F.struct("changed", "page_id", "html")).alias("html"))  # of a page's copies in one batch
        docs = latest.select(clean_html_column(F.col("html")).alias("page_content"), F.col("url").alias("source_url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page_number"))
        chunks = written(chunk_documents(docs, config.chunk_size, config.chunk_overlap), "stream-chunks")
        store.merge(chunks, embed, latest.select(F.col("url").alias("source_url")))

    pages = spark.readStream.schema(PAGE).parquet(folder).select("*", F.col("_metadata.file_modification_time").alias("changed"))
    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
