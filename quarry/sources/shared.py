"""Folders that driver and executors share, and small control files in them, by whatever store Spark can reach."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def store_of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder serves a local master; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that it is computed once, whatever executors are lost. The table goes with the driver's JVM."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store, at = store_of(spark, path)
    store.deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes when a file of a table does: names, sizes and times of all its files."""
    store, at = store_of(spark, path)
    files, seen = store.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()[:32]


class Versions:
    """Numbered JSON records in a folder. A table is what its latest record names: one that is not written whole does not count,
    and of two writers of one number the second fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        store, at = store_of(self.spark, self.folder)
        if not store.exists(at):
            return []
        done = [d.getPath() for d in store.listStatus(at) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(d.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v")) for p in done)

    def read(self, number: int | None = None) -> dict | None:
        known = self.numbers()
        if not known or number is not None and number not in known:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/v{number if number is not None else known[-1]}", wholetext=True).first()[0])

    def commit(self, record: dict, number: int) -> None:
        """Raises if the number is taken: read again and repeat."""
        try:
            self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.folder}/v{number}")
        except AnalysisException as e:
            raise RuntimeError(f"version {number} of {self.folder} was committed by another writer") from e

    def remove(self, path: str) -> None:
        store, at = store_of(self.spark, path)
        store.delete(at, True)
