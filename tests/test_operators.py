"""Library operators on nulls, empty tables, ties, repeated rows and columns of clashing names."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from markerlake.functions.differences import differences
from markerlake.operators import audit, medians, points, runs


@pytest.mark.parametrize(("few", "cells"), [(10_000, 4096), (3, 4), (1, 2)])
def test_medians_of_any_size(spark, monkeypatch, few, cells):
    monkeypatch.setattr(medians, "FEW", few)
    monkeypatch.setattr(medians, "CELLS", cells)
    pick = random.Random(1)
    rows = [("same", 2.0)] * 50 + [("far", x) for x in [1e-9] * 20 + [1e12] * 20] + [(None, float(x)) for x in range(7)] + [("mixed", pick.choice([pick.random(), -1e300, 1e300, 3.0])) for _ in range(99)]
    rows += [("none", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", 5.0)]
    df = spark.createDataFrame([(g, v, "x", 1) for g, v in rows], "g string, value double, measure string, rank int")
    got = {r["g"]: r["value_median"] for r in medians.medians(df, ["value"], ("g",)).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None and abs(v) < float("inf")] for g, _ in rows}
    assert got == {g: statistics.median(v) for g, v in groups.items() if v}
    assert [r["value_median"] for r in medians.medians(df.where("g = 'far'"), ["value"]).collect()] == [statistics.median([1e-9] * 20 + [1e12] * 20)]
    assert medians.medians(df.limit(0), ["value"]).count() == 0


def test_reports_of_little(spark):
    shape = "image_id string, record_type string, distance double, value double, measure string"
    empty = audit.report(spark.createDataFrame([], shape)).collect()[0]
    assert (empty["tag_count"], empty["image_count"], empty["distance_median"], empty["score"]) == (0, 0, 0.0, 0.0)
    df = spark.createDataFrame([(None, "TAG", 1.0, 0.0, "a"), (None, "TAG", None, 0.0, "a"), ("i", "TAG", 4.0, 0.0, None), ("i", "TAG", 4.0, 0.0, None)], shape)
    one = audit.report(df).collect()[0]
    assert (one["tag_count"], one["image_count"], one["distance_median"], one["distance_max"]) == (4, 2, 4.0, 4.0)
    by = {r["measure"]: (r["tag_count"], r["image_count"], r["distance_median"]) for r in audit.report(df, by=("measure",)).collect()}
    assert by == {"a": (2, 1, 1.0), None: (2, 1, 4.0)}


def test_differences_of_nested_values(spark):
    shape = "a struct<n:int,x:double,on:boolean,list:array<struct<v:double>>,gone:string>, b struct<n:int,x:double,on:int,list:array<struct<v:double>>,more:string>"
    rows = [((1, 1.0, True, [(1.0,), (2.0,)], "g"), (1, 1.0 + 1e-12, 1, [(1.0,), (2.5,)], "m")), (None, None), ((1, None, None, None, None), (2, 0.0, None, [], None)), (None, (1, None, None, None, None))]
    df = spark.createDataFrame(rows, shape)
    got = [r["d"] for r in df.select(differences(F.col("a"), F.col("b"), df.schema["a"].dataType, df.schema["b"].dataType).alias("d")).collect()]
    always = ["$.gone: unexpected", "$.more: missing"]
    assert got == [[*always, "$.on: type", "$.list[1].v: value"], [], [*always, "$.n: value", "$.x: null", "$.list: null"], ["$: null"]]


def test_points_and_runs(spark):
    df = spark.createDataFrame([([[-1.0, -1.0], [5.0, 5.0], [50.0, 50.0]], [2]), ([], None), (None, None)], "p array<array<double>>, f array<int>")
    got = [r["k"] for r in df.select(points.labelled(F.col("p"), F.lit(100), F.lit(100), 10, F.col("f")).alias("k")).collect()]
    assert [(k["label"], k["visibility"], k["tags"]) for k in got[0]] == [("0", 2, []), ("1", 1, ["margin"]), ("2", 2, [])] and got[1] == [] and got[2] is None
    kept = df.select(points.with_visible(F.col("p"), F.lit(2)).alias("k"), points.is_whole(F.col("p")).alias("w")).collect()
    assert kept[0]["k"]["visible"] == [False, True, True] and kept[2]["k"]["points"] == [[-1.0, -1.0]] * 2 and [r["w"] for r in kept] == [False] * 3
    outcomes = spark.createDataFrame([("r", i, f"e{i}" if i % 2 else None) for i in range(9)] + [("ok", 1, None), (None, 1, "lost")], "run_id string, scene_id int, error string")
    got = {r["run_id"]: (r["done"], r["failed"], r["first_errors"]) for r in runs.rollup(outcomes).collect()}
    assert got == {"r": (5, 4, ["e1", "e3", "e5"]), "ok": (1, 0, []), None: (0, 1, ["lost"])}
    beats = spark.createDataFrame([], "ram_used_mb double, vram_used_mb double")
    assert [tuple(r) for r in runs.peaks(beats).collect()] == [(0.0, 0.0)]
