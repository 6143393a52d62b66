"""What the operators share: reading tables, tables in the shared folder, and null-safe text."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch, and rows that the Parquet reader holds: texts are long, and buffers of their size stay
#: with the JVM's threads. Each with Spark's defaults.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("256", ("10000",)),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("4194304", ("67108864b", "67108864", "64MB")),
    "spark.sql.parquet.columnarReaderBatchSize": ("512", ("4096",)),
}


def small_batches(spark: SparkSession) -> None:
    """Batches for long texts, where the session has Spark's defaults."""
    for key, (own, defaults) in BATCH.items():
        if spark.conf.get(key, defaults[0]) in defaults:
            spark.conf.set(key, own)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back to the system when its task ends: workers live on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library keeps what it has
                pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given Parquet table, by Spark's reader alone."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own only where none is set and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later step reads."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let the context cleaner delete the shuffle files of finished steps, which else stay until the driver's heap fills. It
    follows the collector at its own pace, so it gets a moment, twice."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text"):
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
