"""Workers' heartbeats as a stream: the latest state of each worker, silence, late data, history.

Time is the heartbeats' own. What counts for a worker is its newest heartbeat by timestamp, in whatever order and batch
they arrive; heartbeats older than the watermark are late and dropped. A worker is silent once the watermark has passed
its newest heartbeat by the timeout, and healthy again with its next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from markerlake.schema import TELEMETRY

SNAPSHOT = "worker_id string, liveness string, last_seen double, status string, vram_used_mb double, heard bigint"
STATE = "last_seen double, status string, vram_used_mb double, heard bigint"
TIMEOUT_S, LATE_S = 10.0, 5.0


def heartbeats(spark: SparkSession, folder: str, files_a_batch: int = 0) -> DataFrame:
    """Heartbeats from the JSON lines that arrive in a folder; lines that don't parse, or name no worker or time, are left
    out, see `malformed`."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else spark.readStream
    parsed = reader.text(folder).select(F.from_json("value", TELEMETRY).alias("x")).select("x.*")
    return parsed.where("worker_id is not null and telemetry is not null and timestamp is not null")


def malformed(lines: DataFrame) -> DataFrame:
    """Of lines (value), those that hold no heartbeat."""
    x = F.from_json("value", TELEMETRY)
    return lines.where(F.coalesce(x["worker_id"].isNull() | x["telemetry"].isNull() | x["timestamp"].isNull(), F.lit(True)))


def newest(seen: tuple | None, rows: pd.DataFrame) -> tuple:
    """The state after some heartbeats: the newest by timestamp wins, of equal ones the greatest status; all are counted."""
    rows = rows.sort_values(["timestamp", "status", "vram_used_mb"], na_position="first")
    last = rows.iloc[-1]
    status, used = (None if pd.isna(last[c]) else last[c] for c in ("status", "vram_used_mb"))
    heard = len(rows) + (seen[3] if seen else 0)
    if seen and (seen[0], seen[1] or "") > (float(last["timestamp"]), status or ""):
        return (*seen[:3], heard)
    return (float(last["timestamp"]), status, None if used is None else float(used), heard)


def snapshots(beats: DataFrame, timeout_s: float = TIMEOUT_S, late_s: float = LATE_S) -> DataFrame:
    """A row whenever a worker is heard (HEALTHY), and when it falls silent (UNRESPONSIVE): SNAPSHOT's columns.

    State is one short row a worker; workers that are silent keep theirs, so that they are known when they return.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get if state.exists else None
        liveness = "UNRESPONSIVE" if state.hasTimedOut else "HEALTHY"
        for rows in batches:
            if len(rows):
                seen = newest(seen, rows)
        if seen is None:
            return
        state.update(seen)
        if not state.hasTimedOut:
            due = int((seen[0] + timeout_s) * 1000)
            if due < state.getCurrentWatermarkMs():
                liveness = "UNRESPONSIVE"  # what was heard is long past already
            else:
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame([(key[0], liveness, *seen)], columns=["worker_id", "liveness", "last_seen", "status", "vram_used_mb", "heard"])

    flat = beats.select("worker_id", "timestamp", F.col("telemetry.status").alias("status"), F.col("telemetry.vram_used_mb").alias("vram_used_mb"), F.timestamp_seconds("timestamp").alias("at"))
    timed = flat.withWatermark("at", f"{late_s} seconds")
    return timed.groupBy("worker_id").applyInPandasWithState(step, SNAPSHOT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def snapshot_sink(stream: DataFrame, folder: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep what changes in each batch, as a part of a table; a batch that runs again replaces its own part.

    With drain, what is there now is taken, and the query ends.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def snapshot_at(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """Each worker's last known row up to a batch, or up to now."""
    rows = spark.read.schema(f"{SNAPSHOT}, batch bigint").option("basePath", folder).parquet(folder)
    if batch is not None:
        rows = rows.where(F.col("batch") <= batch)
    fields = [c for c in rows.columns if c not in ("worker_id", "batch")]
    return rows.groupBy("worker_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("worker_id", "s.*")


def restart_decision(snapshot: DataFrame, vram_threshold_mb: float | None = None) -> DataFrame:
    """Which workers to restart: silent ones, and those with more memory in use than allowed."""
    over = F.lit(False) if vram_threshold_mb is None else F.coalesce(F.col("vram_used_mb") > vram_threshold_mb, F.lit(False))
    return snapshot.withColumn("restart", (F.col("liveness") == "UNRESPONSIVE") | over)


def history(beats: DataFrame, folder: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append heartbeats to a table by day, from which relate.last_telemetry takes the newest rows."""
    rows = beats.select("timestamp", "worker_id", "telemetry.*", F.to_date(F.timestamp_seconds("timestamp")).alias("day"))
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")
    return (writer.trigger(availableNow=True) if drain else writer).start()
