"""The vector store: versioned tables of chunks and vectors, and embedders."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.shared import Versions, store_of

Embedder = Callable[[list[str]], np.ndarray]


class HashingEmbedder:
    """Deterministic and offline: signed word hashing, scaled to length 1."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(rows: DataFrame, embed: Embedder, text: str = "page_content") -> DataFrame:
    """Adds embedding array<float>, batch by batch."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embed(texts.fillna("").tolist()), np.float32)))

    return rows.withColumn("embedding", vectors(text))


BACKENDS = ("parquet", "orc")


class VectorStore:
    """Chunks with embeddings, as parts in one of Spark's formats and versions that name them.

        parts/<id>      the chunks' columns, embedding
        gone/<id>       chunk_id of chunks that parts before <id> held and that are no longer there
        versions/v<n>   which of both count

    A version is written last and nothing is changed in place, so readers keep what they opened, a writer that fails leaves the
    former version as it was, and of two writers at one time one is told to try again.
    """

    def __init__(self, spark: SparkSession, path: str, backend: str = "parquet"):
        if backend not in BACKENDS:
            raise ValueError(f"unknown vector store {backend}; there are {', '.join(BACKENDS)}")
        self.spark, self.path, self.backend = spark, path.rstrip("/"), backend
        self.versions = Versions(spark, f"{self.path}/versions")

    def exists(self) -> bool:
        return bool(self.versions.numbers())

    def reset(self, rows: DataFrame) -> None:
        """These chunks and no others, whatever was there: what a change of the embedder needs."""
        before = self._now()
        part = self._written(rows, "parts")
        self._commit(before, {"parts": [part], "gone": [], "schema": rows.schema.json()})

    def add(self, rows: DataFrame) -> None:
        """Only chunks that aren't there yet, by chunk_id."""
        before = self._now()
        fresh = rows.dropDuplicates(["chunk_id"])
        if before["parts"]:
            fresh = fresh.join(self.rows().select("chunk_id"), "chunk_id", "left_anti")
        part = self._written(fresh.select(*rows.columns), "parts")
        self._commit(before, dict(before, parts=[*before["parts"], part], schema=before.get("schema") or rows.schema.json()))

    def merge(self, chunks: DataFrame, embed: Embedder, sources: DataFrame | None = None, whole: bool = False) -> None:
        """Makes the chunks of some sources what `chunks` says: known ones stay with their embeddings, new ones are embedded, others go.

        A chunk is known by chunk_id, which holds its place and its content. The sources are those of the chunks, those of `sources`
        (source_url) as well, so that a page without text loses its chunks, or with whole every source.
        """
        before = self._now()
        fresh = chunks.dropDuplicates(["chunk_id"])
        gone = None
        if before["parts"]:
            held = self.rows().select("chunk_id", "source_url")
            if not whole:
                named = chunks.select("source_url") if sources is None else chunks.select("source_url").unionByName(sources.select("source_url"))
                held = held.join(named.distinct().toDF("_named"), F.col("source_url").eqNullSafe(F.col("_named")), "left_semi")
            lost = held.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
            gone = self._written(lost, "gone")
            fresh = fresh.join(self.rows().select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)
        rows = embedded(fresh, embed)
        part = self._written(rows, "parts")
        self._commit(before, {"parts": [*before["parts"], part], "gone": before["gone"] + [gone] * (gone is not None), "schema": before.get("schema") or rows.schema.json()})

    def compact(self) -> None:
        """What is left as one part."""
        before = self._now()
        self._commit(before, dict(before, parts=[self._written(self.rows(), "parts")], gone=[]))

    def clean(self) -> None:
        """Removes parts that the latest version does not name. Readers of older versions must be done."""
        now = self._now()
        for kind in ("parts", "gone"):
            store, at = store_of(self.spark, f"{self.path}/{kind}")
            for d in store.listStatus(at) if store.exists(at) else ():
                if int(d.getPath().getName()) not in now[kind]:
                    store.delete(d.getPath(), True)

    def rows(self, version: int | None = None) -> DataFrame:
        """The chunks of a version, by default the latest."""
        now = self._now(version)
        if not now["parts"]:
            raise FileNotFoundError(f"no vector store at {self.path}: run ingest first")
        schema = StructType.fromJson(json.loads(now["schema"]))
        read = lambda kind, number, shape: self.spark.read.format(self.backend).schema(shape).load(f"{self.path}/{kind}/{number}")
        out = None
        for n, part in enumerate(now["parts"]):
            one = read("parts", part, schema)
            for g in (g for g in now["gone"] if g > part):
                one = one.join(read("gone", g, "chunk_id string"), "chunk_id", "left_anti")
            out = one.select(*schema.names) if out is None else out.unionByName(one.select(*schema.names))
        return out

    def _now(self, version: int | None = None) -> dict:
        return self.versions.read(version) or {"version": 0, "parts": [], "gone": []}

    def _written(self, rows: DataFrame, kind: str) -> int:
        number = time.time_ns()
        rows.write.format(self.backend).save(f"{self.path}/{kind}/{number}")
        return number

    def _commit(self, before: dict, now: dict) -> None:
        now["version"] = before["version"] + 1
        self.versions.commit(now, now["version"])
