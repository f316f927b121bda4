"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from finrecon.plans.shipping import shipped

BATCH_BYTES, OWN_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, as in tests, one of our own if the session names none. A cluster must name one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables of one run in the shared folder. A table that no later step reads is deleted by ``done``; those that the result reads stay."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def kept(self, df: DataFrame) -> DataFrame:
        """The rows of df, computed once and written."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def done(self, *tables: DataFrame) -> None:
        context = self.spark.sparkContext
        for t in tables:
            _, path = self.paths.pop(id(t))
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and stored in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by bytes, as texts may be long, and memory given back after each task.

    The bound is a setting of the session, the only way in that Spark offers; it is set here once unless the user has set it."""
    spark = df.sparkSession
    shipped(spark)
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, OWN_BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory of this worker to the system; workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra columns of any name cannot clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))
