"""Heartbeats that arrive in any order, late, broken, from workers that fall silent and return."""

import json

import pandas as pd

from markerlake.streaming import monitor


def beat(worker, t, status="busy", vram=1.0):
    return json.dumps({"timestamp": t, "worker_id": worker, "telemetry": {"status": status, "vram_used_mb": vram}})


def drained(spark, folder):
    beats = monitor.heartbeats(spark, str(folder / "lines"), files_a_batch=1)
    monitor.snapshot_sink(monitor.snapshots(beats), str(folder / "table"), str(folder / "state"), drain=True).awaitTermination()
    return {r["worker_id"]: (r["liveness"], r["last_seen"], r["status"]) for r in monitor.snapshot_at(spark, str(folder / "table")).collect()}


def put(folder, name, *lines):
    (folder / "lines").mkdir(exist_ok=True)
    (folder / "lines" / name).write_text("\n".join(lines) + "\n")


def test_silent_and_returning_workers(spark, tmp_path):
    put(tmp_path, "1.txt", beat("a", 100.0), beat("b", 101.0), "{broken", "", '{"worker_id": "x"}', '{"timestamp": 1, "telemetry": {}}')
    assert drained(spark, tmp_path) == {"a": ("HEALTHY", 100.0, "busy"), "b": ("HEALTHY", 101.0, "busy")}
    put(tmp_path, "2.txt", beat("a", 140.0), beat("a", 139.0, "old"))
    assert drained(spark, tmp_path) == {"a": ("HEALTHY", 140.0, "busy"), "b": ("UNRESPONSIVE", 101.0, "busy")}
    put(tmp_path, "3.txt", beat("b", 141.0, "back"), beat("c", 50.0, "late"))  # what is older than the watermark is dropped
    assert drained(spark, tmp_path) == {"a": ("HEALTHY", 140.0, "busy"), "b": ("HEALTHY", 141.0, "back")}
    first = {r["worker_id"]: r["liveness"] for r in monitor.snapshot_at(spark, str(tmp_path / "table"), batch=0).collect()}
    assert first == {"a": "HEALTHY", "b": "HEALTHY"}  # as it was at that point


def test_the_newest_heartbeat_counts_in_any_order():
    rows = pd.DataFrame([(3.0, "x", 5.0), (1.0, "y", 6.0), (3.0, "z", None)], columns=["timestamp", "status", "vram_used_mb"])
    assert monitor.newest(None, rows) == (3.0, "z", None, 3)
    assert monitor.newest((9.0, "s", 1.0, 4), rows) == (9.0, "s", 1.0, 7)
    assert monitor.newest((2.0, "s", 1.0, 4), rows.iloc[:1]) == (3.0, "x", 5.0, 5)


def test_restarts(spark):
    rows = spark.createDataFrame([("a", "HEALTHY", 10.0), ("b", "UNRESPONSIVE", 1.0), ("c", "HEALTHY", None)], "worker_id string, liveness string, vram_used_mb double")
    assert {r["worker_id"] for r in monitor.restart_decision(rows, 5.0).where("restart").collect()} == {"a", "b"}
    assert {r["worker_id"] for r in monitor.restart_decision(rows).where("restart").collect()} == {"b"}
