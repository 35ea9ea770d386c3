"""Queries on tables as larger copies have them: keys beyond those of the standard tables, repeated rows, nulls."""

import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from markerlake import queries, queries_files
from markerlake.generation import compiler
from markerlake.operators import boards
from markerlake.plans import scenes
from markerlake.sources import files
from markerlake.sources.folders import kept


def same_rows(spark, folder, name, tables):
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_images_of_long_user_ids(spark, small, folder):
    """Ids of five digits are cut to four in an image's name: users of one name stay apart, as do those without an id."""
    events = spark.read.parquet(f"{small}/events.parquet").limit(400)
    user = F.when(F.col("event_id") % 10 == 0, None).otherwise(12340 + F.col("event_id") % 20)
    events.withColumn("user_id", user).write.parquet(f"{folder}/events.parquet")
    same_rows(spark, folder, "sink_images", ["events"])


@pytest.mark.parametrize("name", ["board_checks", "broken_boards"])
def test_boards_of_any_number_meet_their_squares(spark, small, name):
    """A table of boards is never sent whole through the driver, whatever its size is taken for."""
    found = queries.QUERIES[name](spark, small)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_checks_of_odd_boards(spark):
    shape = "board_id int, type string, rows int, cols int, square_size double, marker_size double"
    rows = spark.createDataFrame([(1, "charuco", 1, 1, 0.25, 0.2), (2, None, 2, 3, 0.25, 0.2), (3, "aprilgrid", 2, 2, 0.25, None), (4, "charuco", 3, 2, 0.25, 0.25)], shape)
    squares = boards.squares(rows).where("board_id <> 4 or row > 0")
    got = {(r["board_id"], r["check"]): r["ok"] for r in boards.checks(rows, squares).collect()}
    wrong = {(3, "marker_fits"): None, (4, "marker_fits"): False, (4, "centred"): False, (4, "dimensions"): False}
    assert got == {(i, c): wrong.get((i, c), True) for i in range(1, 5) for c in ("white_border", "filling", "centred", "dimensions", "marker_fits")}


def test_compressed_documents(spark, tmp_path):
    """Files of recipes may be compressed; what is empty or broken in them is found as in plain ones."""
    texts = {"a.json": '[{"scene_id": 1}, {"scene_id": 2}]', "b.json.gz": '[{"scene_id": 3},\n {"scene_id": 4}]', "c.json.gz": '{"scene_id": 5}', "d.json.gz": '[{"scene_id": 6', "e.json": "", "f.json.gz": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    found = files.recipes(spark, str(tmp_path), broken="keep").collect()
    assert sorted(r["scene_id"] for r in found if r["scene_id"]) == [1, 2, 3, 4, 5]
    assert sorted(r["file"].rpartition("/")[2] for r in found if r["scene_id"] is None) == ["d.json.gz", "e.json", "f.json.gz"]


def test_scenes_are_dealt_once(spark, small):
    """Orders and lines of a shard meet in one exchange; what is made of them is in no other."""
    rows = queries_files.scene_recipes(spark, small, F.floor(F.col("scene_id") / 500))
    whole = rows.groupBy("shard").agg(F.collect_list(F.struct(*rows.columns)).alias("all"))
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    orders = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None), (None, 4.0)], "o_orderkey long, o_totalprice double")
    lines = spark.createDataFrame([(1, 2, 7, 8), (1, 1, 9, 9), (3, 1, 1, 1), (None, 1, 1, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    got = scenes.recipes(orders, lines).collect()
    assert sorted((r["scene_id"] or 0, r["world"]["lights"][0]["intensity"] or 0.0, [o["name"] for o in r["objects"] if o["type"] == "TAG"]) for r in got) == [
        (0, 4.0, []), (1, 2.0, ["t_1_9_9", "t_2_7_8"]), (1, 3.0, ["t_1_9_9", "t_2_7_8"]), (2, 0.0, []),
    ]


def test_scenes_of_a_small_table_are_dealt_over_all_cores(spark, monkeypatch):
    """Jobs that one task reads become scenes in many: each scene's objects are drawn by far more work than its row is bytes."""
    seen = []
    monkeypatch.setattr(compiler, "kept", lambda df, name: seen.append(df.rdd.getNumPartitions()) or kept(df, name))
    compiler.plain(spark.createDataFrame([("a", 3)], "job_id string, num_scenes long").coalesce(1)).collect()
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_records_of_a_corner_at_the_cameras_plane(spark, folder):
    """A corner 5 mm before the camera's plane lies 10 to the power of 9 pixels out of the frame: it agrees to that."""
    spark.createDataFrame([(36576, 3), (36577, 3)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    same_rows(spark, folder, "scene_records", ["part"])
