"""Queries that drain streams made of the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.queries import query, read
from markerlake.sources.folders import new_folder
from markerlake.streaming import monitor


def beat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heartbeat for each event, a second apart, as JSON lines; every eleventh is broken."""
    e = F.col("event_id")
    beat = F.struct(
        e.cast("double").alias("timestamp"), F.concat(F.lit("w"), (F.col("user_id") % 50).cast("string")).alias("worker_id"),
        F.struct(F.element_at(F.array(F.lit("idle"), F.lit("busy"), F.lit("done")), (e % 3 + 1).cast("int")).alias("status"), (e % 9000).cast("double").alias("vram_used_mb")).alias("telemetry"),
    )
    return read(spark, sf_dir, "events").select(F.when(e % 11 == 0, "{broken").otherwise(F.to_json(beat)).alias("value"))


@query("""WITH b AS (SELECT event_id AS t, 'w' || (user_id % 50) AS worker_id, CASE event_id % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'busy' ELSE 'done' END AS status, CAST(event_id % 9000 AS DOUBLE) AS vram FROM events WHERE event_id % 11 <> 0)
SELECT worker_id, CASE WHEN max(t) + 10 < (SELECT max(t) FROM b) - 5 THEN 'UNRESPONSIVE' ELSE 'HEALTHY' END AS liveness, CAST(max(t) AS DOUBLE) AS last_seen, arg_max(status, t) AS status, arg_max(vram, t) AS vram_used_mb, count(*) AS heard,
    max(t) + 10 < (SELECT max(t) FROM b) - 5 OR arg_max(vram, t) > 8000 AS restart FROM b GROUP BY worker_id""")
def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats drained from files into snapshots: who was heard last when, who has been silent since, whom to restart."""
    folder = new_folder(spark, "beats")
    beat_lines(spark, sf_dir).write.text(f"{folder}/lines")
    monitor.snapshot_sink(monitor.snapshots(monitor.heartbeats(spark, f"{folder}/lines")), f"{folder}/table", f"{folder}/state", drain=True).awaitTermination()
    return monitor.restart_decision(monitor.snapshot_at(spark, f"{folder}/table"), 8000.0)


@query("SELECT count(*) AS lines, CAST(sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broken, CAST(sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS kept, count(DISTINCT CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 50 END) AS workers FROM events")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats appended to a table, and lines that hold none."""
    folder = new_folder(spark, "history")
    beat_lines(spark, sf_dir).write.text(f"{folder}/lines")
    monitor.history(monitor.heartbeats(spark, f"{folder}/lines"), f"{folder}/table", f"{folder}/state", drain=True).awaitTermination()
    lines = spark.read.text(f"{folder}/lines")
    table = spark.read.parquet(f"{folder}/table").agg(F.count("*").alias("kept"), F.count_distinct("worker_id").alias("workers"))
    return lines.agg(F.count("*").alias("lines")).join(monitor.malformed(lines).agg(F.count("*").alias("broken"))).join(table)
