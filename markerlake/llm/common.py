"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.sources.folders import importable, new_folder

#: Rows and bytes in one Arrow batch: documents may hold 100,000 characters and more.
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20
#: Bytes that a writer of intermediate tables holds before it writes them out.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a folder that only Spark may be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts. Only lowers the session's setting."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        before = int(spark.conf.get(key).rstrip("b"))
        if before > most or before <= 0:
            spark.conf.set(key, str(most))


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of a query when the query has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, rows_a_file: int = 0) -> tuple[DataFrame, str]:
    """The rows written as Parquet in the shared folder and read again, and where they are; their shuffles are gone.

    What is written here is packed already, so it isn't compressed again.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    with clean_shuffles(spark):
        df.write.option("compression", "none").option("maxRecordsPerFile", rows_a_file).option("parquet.block.size", ROW_GROUP).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that an operator wrote in the shared folder, once all that was read from it is written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory that Python has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def rest(spark: SparkSession) -> None:
    """Let the driver give back what plans and steps that have ended left behind, in Python and in the JVM."""
    trim()
    spark._jvm.System.gc()


class Scratch:
    """Tables between the steps of an operator, as Parquet in the shared folder; cleared when its result is written."""

    REST = 8  # tables after which the driver rests

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.folders, self.tables = spark, name, [], 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows with their lineage cut and their shuffle files gone."""
        folder = new_folder(self.spark, self.name)
        with clean_shuffles(self.spark):
            df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(folder)
        self.folders.append(folder)
        self.tables += 1
        if self.tables % self.REST == 0:
            rest(self.spark)
        return self.spark.read.schema(df.schema).parquet(folder)

    def result(self, df: DataFrame) -> DataFrame:
        """The rows in a folder that stays; all others go."""
        kept = self.keep(df)
        for folder in self.folders[:-1]:
            remove(self.spark, folder)
        self.folders = []
        return kept


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    importable(df.sparkSession)

    return df.mapInArrow(tidy(work), schema)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, after which the worker gives the memory back that it has freed: it waits for its next task for a while."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return both


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z, then the runs of bytes other than space, tab, line feed, VT, FF and CR: `[^\\x20\\x09-\\x0D]+`."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def read_only(path: str) -> str:
    """A file that is installed on every machine, such as a tokenizer's."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, of which a test of whole texts holds. make() gives each task its test."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            yield batch.filter(pa.array(test(texts(batch)), pa.bool_()))

    small_batches(df.sparkSession)
    importable(df.sparkSession)
    return df.mapInArrow(tidy(work), df.schema)
