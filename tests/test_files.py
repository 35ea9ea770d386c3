"""Readers and writers of datasets' files on files of the formats themselves, broken ones included."""

import json

import pytest
from pyspark.sql import functions as F

from markerlake.sources import files, sinks

RECORD = {"image_id": "scene_0001_cam_0000", "tag_id": 3, "tag_family": "tag36h11", "corners": [[1, 2], [11, 2], [11, 12], [1, 12]], "metadata": {"board_definition": {"type": "charuco", "rows": 5, "cols": 7}}}
NEW = "image_id,tag_id,tag_family,record_type,tag_size_mm,ppm,is_mirrored,x1,y1,x2,y2,x3,y3,x4,y4,kp1_x,kp1_y"
OLD = "image_id,tag_id,tag_family,x1,y1,x2,y2,x3,y3,x4,y4"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_both_versions_and_broken_shards(spark, tmp_path):
    bare, wrapped = put(tmp_path, "a.json", json.dumps([RECORD])), put(tmp_path, "b.json", json.dumps({"version": "2.0", "evaluation_context": {"photometric_margin_px": 7}, "records": [RECORD, {"tag_id": 1}]}))
    none = put(tmp_path, "c.json", json.dumps({"version": "2.0"}))
    rows = files.rich_truth(spark, [bare, wrapped, none]).collect()
    assert sorted((r["image_id"], r["valid"]) for r in rows if r["image_id"]) == [("scene_0001_cam_0000", True)] * 2 and len(rows) == 3
    assert {r["board_definition"]["rows"] for r in rows if r["valid"]} == {5}
    assert sorted(str(r["photometric_margin_px"]) for r in files.contexts(spark, [bare, wrapped]).collect()) == ["7", "None"]
    for text in (json.dumps([RECORD])[:-20], json.dumps({"records": [RECORD]})[:-1], "", "nothing"):
        broken = put(tmp_path, "broken.json", text)
        with pytest.raises(Exception, match="no valid JSON"):
            files.rich_truth(spark, [bare, broken]).collect()
        kept = files.rich_truth(spark, [bare, broken], broken="keep").collect()
        assert sorted((r["place"] is None, r["valid"]) for r in kept) == ([(False, True), (True, False)])
    lost = put(tmp_path, "lost.json", '[{"scene_id": 1')
    assert [r["scene_id"] for r in files.recipes(spark, lost, broken="keep").collect()] == [None]
    with pytest.raises(Exception, match="no valid JSON"):
        files.recipes(spark, lost).collect()


def test_flat_tables_by_name(spark, tmp_path):
    new = put(tmp_path, "new.csv", f"{NEW}\ni1,1,f,BOARD,100.0,2.5,1,1,2,3,4,5,6,7,8,9,10\n")
    old = put(tmp_path, "old.csv", f"{OLD}\ni2,2,f,1,2,3,4,5,6,7,8\n")
    got = {r["image_id"]: r for r in files.flat_csv(spark, [new, old]).collect()}
    assert got["i1"]["corners"] == got["i2"]["corners"] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]
    assert (got["i1"]["record_type"], got["i1"]["tag_size_mm"], got["i1"]["ppm"], got["i1"]["is_mirrored"], got["i1"]["keypoints"]) == ("BOARD", 100.0, 2.5, True, [[9.0, 10.0]])
    assert (got["i2"]["record_type"], got["i2"]["tag_size_mm"], got["i2"]["is_mirrored"], got["i2"]["keypoints"]) == ("TAG", None, False, None)
    assert files.flat_csv(spark, put(tmp_path, "only_header.csv", NEW + "\n")).count() == 0
    assert files.flat_csv(spark, put(tmp_path, "empty.csv", "")).count() == 0


def test_audit_source_falls_back(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.audited(spark, str(tmp_path))
    put(tmp_path, "tags.csv", f"{OLD}\ni2,2,f,1,2,3,4,5,6,7,8\n")
    assert [r["image_id"] for r in files.audited(spark, str(tmp_path)).collect()] == ["i2"]
    put(tmp_path, "rich_truth.json", json.dumps([RECORD]))
    assert [r["image_id"] for r in files.audited(spark, str(tmp_path)).collect()] == [RECORD["image_id"]]


def test_coco_keeps_types_and_raw_boxes(spark, tmp_path):
    rows = [(0, "i", 1, "f", [[0.0, -10.0], [10.0, 0.0], [0.0, 10.0], [-10.0, 0.0]], [100, 50], '{"tag_id": 9, "list": [1, "a"], "deep": {"x": 1.5}}', None), (0, "i", 2, "g", [[5.0, 5.0]], [90, 60], None, [[1.0, 1.0]])]
    df = spark.createDataFrame(rows, "shard int, image_id string, tag_id long, tag_family string, corners array<array<double>>, resolution array<int>, metadata string, keypoints array<array<double>>")
    sinks.coco(df, str(tmp_path / "coco"))
    doc = json.loads(next((tmp_path / "coco" / "shard=0").glob("*.txt")).read_text())
    assert doc["images"] == [{"id": 1, "file_name": "images/i.png", "width": 100, "height": 50}]
    quad, point = sorted(doc["annotations"], key=lambda a: a["id"])
    assert quad["area"] == 200.0 and quad["bbox"] == [-10.0, -10.0, 20.0, 20.0] and quad["segmentation"] == [[0.0, 0.0, 10.0, 0.0, 0.0, 10.0, 0.0, 0.0]]
    assert quad["attributes"] == {"tag_id": 1, "tag_family": "f", "resolution": [100, 50], "list": [1, "a"], "deep": {"x": 1.5}}
    assert point["bbox"] == [4.5, 4.5, 1.0, 1.0] and point["segmentation"] == [] and point["keypoints"] == [5.0, 5.0, 2.0, 1.0, 1.0, 2.0] and point["num_keypoints"] == 2
    assert doc["categories"][0]["keypoints"] == ["tl", "tr", "br", "bl"] and [c["name"] for c in doc["categories"]] == ["f", "g"]
    again = {r["id"]: r for r in files.coco(spark, str(tmp_path / "coco")).collect()}
    assert again[1]["corners"] == [[0.0, -10.0], [10.0, 0.0], [0.0, 10.0], [-10.0, 0.0]] and again[2]["corners"] == [[4.5, 4.5], [5.5, 4.5], [5.5, 5.5], [4.5, 5.5]]


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "shard int, image_id string, tag_id long, tag_family string, record_type string, corners array<array<double>>, resolution array<int>, eval_margin_px int, keypoints array<array<double>>")
    sinks.coco(df, str(tmp_path / "c"))
    sinks.rich_truth(df, str(tmp_path / "r"))
    sinks.flat_csv(df.drop("shard"), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).where(F.col("value").contains("i,")).count() == 0
