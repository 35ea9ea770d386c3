"""What a run came to: its scenes, errors and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW = 3


def peaks(telemetry: DataFrame) -> DataFrame:
    """One row: the largest ram_used_mb and vram_used_mb, 0 without records."""
    return telemetry.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(f"max_{c}") for c in ("ram_used_mb", "vram_used_mb")))


def rollup(outcomes: DataFrame) -> DataFrame:
    """run_id, done, failed, first_errors of scenes (run_id, scene_id, error, which is null where all went well).

    first_errors are those of the smallest scene ids, PREVIEW at most; they are kept per task, so that a run of many errors
    meets nowhere.
    """
    each = outcomes.groupBy("run_id").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min(F.when(F.col("error").isNotNull(), F.struct("scene_id", "error"))).alias("e0"))
    found = each
    for i in range(1, PREVIEW):  # the next smallest after the last one taken
        after = outcomes.join(found.select("run_id", F.col(f"e{i - 1}").alias("last")), "run_id").where(F.col("error").isNotNull() & (F.struct("scene_id", "error") > F.col("last")))
        found = found.join(after.groupBy("run_id").agg(F.min(F.struct("scene_id", "error")).alias(f"e{i}")), "run_id", "left")
    listed = F.array_compact(F.array(*(F.col(f"e{i}.error") for i in range(PREVIEW))))
    return found.select("run_id", "done", "failed", listed.alias("first_errors"))
