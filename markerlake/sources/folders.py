"""Where intermediate and exported files lie."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A session on one machine that names none (tests) gets a new one; on a cluster, where no local folder is shared, that
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="markerlake-")
            context.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written in the shared folder and read again: their plan ends there, and no later step works them out anew."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over all cores, by the columns named or at random, for work that is large beside the bytes of its
    rows: a small table is read by one task or two, however many rows it holds."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a cluster it is installed or shipped."""
    root = str(Path(__file__).resolve().parents[2])
    kept = spark.sparkContext.environment
    if root not in kept.get("PYTHONPATH", "").split(os.pathsep):
        kept["PYTHONPATH"] = os.pathsep.join(x for x in (kept.get("PYTHONPATH"), root) if x)
