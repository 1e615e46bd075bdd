"""Ingest: sources to chunks to vectors, in an order that leaves no half-finished index marked fresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import chunk_documents
from quarry.plans.config import Config
from quarry.sources import tables, web
from quarry.sources.shared import written
from quarry.sources.store import Embedder, VectorStore


def run(spark: SparkSession, sources: DataFrame, fetch: web.Fetcher, cache: str, store: VectorStore, embed: Embedder, marker: str, when: str, limit: int | None = None, chunks_only: bool = False, config: Config = Config(), download: Callable[[str], bytes] | None = None, pages_of: Callable[[bytes], list[str]] | None = None, errors: str | None = None) -> DataFrame:
    """Chunks of the first `limit` sources. The cache is written before anything is embedded, the marker
    last and only after everything; chunks that the store holds already are not embedded again, and others of it go; with chunks_only neither vectors nor marker. Sources that fail are
    left out; with a path for errors, url and error of each are written there. PDF sources are read with
    download (by default over the network) and pages_of."""
    some = sources.limit(limit) if limit is not None else sources
    known = F.when(F.col("type").isin("html", "pdf"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown source type: "), F.coalesce("type", F.lit("null")))))
    some = some.withColumn("type", known)
    pages = web.fetched(some.where("type = 'html'"), fetch, config.user_agent, config.request_delay)
    pages = written(pages, "pages")  # a lost executor must not ask the hosts again
    pdfs, failed = web.pdf_documents(some, fetch, download or web.pdf_fetcher(config.user_agent), config.user_agent, when, config.request_delay, pages_of)
    chunks = chunk_documents(web.documents(pages, when).unionByName(pdfs), config.chunk_size, config.chunk_overlap)
    tables.write_chunks(chunks, cache)
    if errors:
        web.failures(pages).unionByName(failed).write.mode("overwrite").json(errors)
    kept = tables.read_chunks(spark, cache)
    if chunks_only:
        return kept
    store.merge(kept, embed, whole=True)
    tables.write_marker(spark, when, marker)
    return kept
