"""Schemas, and reading and writing of source lists, cases, chunk caches and results."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "url string, type string, category string, title string"
CASE = "id int, question string, expected_behavior string, must_cite_url_contains array<string>, category string"
METADATA = (
    "source_url string, title string, category string, doc_type string, page_number int, ingested_at string, source_doc_id string, chunk_id string, chunk_index int, "
    "section_index int, section_title string, section_path string, chunk_start_char int, chunk_end_char int, chunk_char_count int, chunk_content_hash string, "
    "chunking_strategy string, chunk_size int, chunk_overlap int, retrieval_rank int"
)
RESULT = (
    "id int, question string, category string, expected_behavior string, answer string, sources array<struct<url:string,title:string,category:string,doc_type:string>>, "
    "retrieval_pass boolean, faithfulness_pass boolean, relevance_pass boolean, citation_pass boolean, refusal_pass boolean, retrieval_diagnostics string, mode string"
)
#: When a result was appended, and its place there: what orders saved results.
LINE = "struct<saved_at:long,place:long>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of its own store; errors of the store rise."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _yaml(spark: SparkSession, path: str) -> dict:
    """A small control file, by whatever store Spark reads."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The list under `sources`; none if the key is missing."""
    rows = [tuple(x.get(k) for k in ("url", "type", "category", "title")) for x in _yaml(spark, path).get("sources") or []]
    return spark.createDataFrame(rows, SOURCE)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The list under `cases`; an error if the key is missing."""
    rows = [tuple(x.get(k) for k in ("id", "question", "expected_behavior", "must_cite_url_contains", "category")) for x in _yaml(spark, path)["cases"]]
    return spark.createDataFrame(rows, CASE)


def sorted_sources(pages: DataFrame) -> DataFrame:
    """url, type, category, title, sorted by URL in code-point order."""
    return pages.select("url", F.col("doc_type").alias("type"), "category", "title").orderBy("url")


def write_sources(pages: DataFrame, path: str) -> None:
    """The allowlist as YAML (a control file: its rows pass through the driver)."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"sources": [r.asDict() for r in sorted_sources(pages).collect()]}, f, sort_keys=False, allow_unicode=True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON record a line: metadata (nulls written) and page_content."""
    keys = sorted(c for c in chunks.columns if c != "page_content")
    record = F.struct(F.struct(*keys).alias("metadata"), F.col("page_content"))
    chunks.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_chunks(spark: SparkSession, path: str, metadata: str = METADATA) -> DataFrame:
    """Chunks of a cache; a broken record, or one without page_content, is an error. Missing metadata is empty."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no chunk cache at {path}: run ingest first")
    raw = spark.read.schema(f"metadata struct<{_nested(metadata)}>, page_content string, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    bad = F.col("_broken").isNotNull() | F.col("page_content").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid chunk record: "), F.coalesce("_broken", F.lit("page_content is missing"))))).otherwise(F.col("page_content"))
    return raw.select("metadata.*", checked.alias("page_content"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved results with a line_no that orders them as they were appended; torn lines are skipped, a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{RESULT}, line_no {LINE}")
    row = spark.read.text(path).select(F.from_json("value", f"{RESULT}, saved_at long, place long").alias("r"))
    return row.where("r.id is not null").select("r.*").withColumn("line_no", F.struct(F.coalesce("saved_at", F.lit(0)).alias("saved_at"), F.coalesce("place", F.lit(0)).alias("place"))).drop("saved_at", "place")


def append_results(results: DataFrame, path: str, mode: str | None = None) -> None:
    """Append records, with the mode where results have none of their own."""
    keys = [c.split(" ")[0] for c in RESULT.replace("struct<url:string,title:string,category:string,doc_type:string>", "x").split(", ")]
    full = results if "mode" in results.columns else results.withColumn("mode", F.lit(mode).cast("string"))
    order = [F.lit(time.time_ns()).alias("saved_at"), F.monotonically_increasing_id().alias("place")]
    full.select(F.to_json(F.struct(*keys, *order), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_marker(spark: SparkSession, when: str, path: str) -> None:
    """The freshness marker, written last."""
    spark.createDataFrame([(when,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _nested(columns: str) -> str:
    return ", ".join(":".join(c.split(" ", 1)) for c in columns.split(", "))
