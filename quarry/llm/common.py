"""What several operators of this subpackage share: inputs, folders, tables that cut lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts may be long, so batches stay small enough for a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Functions that empty what modules remember for a worker's next tasks of the same operator; give_back() calls them.
REMEMBERED: list[Callable[[], None]] = []


def keep_heap() -> None:
    """Have this Python worker keep freed memory up to 1 GB for its next arrays: numpy's temporary ones else cost more
    in page faults than in arithmetic. Does nothing where the C library has no such setting."""
    _tune(32 << 20, 1 << 30, 64 << 20)


def give_back() -> None:
    """End keep_heap() and give freed memory back: Spark hands this worker on to later tasks, of other operators too, and
    what one operator has kept would count beside the memory of all that follow."""
    import ctypes

    import pyarrow as pa

    for empty in REMEMBERED:
        empty()
    pa.default_memory_pool().release_unused()
    _tune(128 << 10, 128 << 10, 128 << 10)
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def _tune(*values: int) -> None:
    import ctypes

    try:
        tune = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    for name, value in zip((-3, -1, -2), values):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_TOP_PAD
        tune(name, value)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of mapInArrow; before a task, and when it has ended and its own variables are gone, freed memory is given back."""

    @functools.wraps(run)
    def whole(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, a null text as the empty one. Other columns, clashing names included, go."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def bounded_batches(spark: SparkSession) -> None:
    """Lower the size of the session's Arrow batches, in rows and bytes, unless they are smaller already."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{name}", None))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master (tests); a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, own, True)
    folder = f"file://{own}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, lost executors cost no recomputation.

    The table goes when forgotten, or when the driver's JVM ends in order.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    leave_on_exit(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def leave_on_exit(spark: SparkSession, path: str) -> None:
    """Have the store remove the path when the driver's JVM ends."""
    store, at = _store(spark, path)
    store.deleteOnExit(at)


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_written", None):
            store, at = _store(t.sparkSession, path)
            store.delete(at, True)


def crc_mod(key, n: int):
    """crc32 of the key as text, modulo n. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def filtered(docs: DataFrame, scores, keep) -> DataFrame:
    """Rows of docs, all columns, whose score keep() accepts; scores: list of texts to list of scores.

    Rows pass through Arrow batches as they are, so nothing is joined back and no row is looked up.
    """
    import pyarrow as pa

    at = docs.columns.index("text")

    @giving_back
    def run(batches):
        score = scores()
        for b in batches:
            texts_ = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([bool(keep(p)) for p in score(texts_)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
