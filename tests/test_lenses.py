"""Inverse lenses and dense outlines worked out on batches: against plain Python, with nulls, and without lambdas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import lenses, outlines
from markerlake.queries import QUERIES

SHAPE = "x double, y double, m string, c array<double>"
K = [[500.0, 0.0, 320.0], [0.0, 400.0, 240.0], [0.0, 0.0, 1.0]]


def bent(x, y, model, c):
    c = [*(c or []), 0.0, 0.0, 0.0, 0.0, 0.0]
    r2 = x * x + y * y
    if model == "kannala_brandt":
        t = math.atan(math.sqrt(r2))
        s = t * (1 + c[0] * t**2 + c[1] * t**4 + c[2] * t**6 + c[3] * t**8) / math.sqrt(r2) if r2 else 1.0
        return x * s, y * s
    radial = 1 + c[0] * r2 + c[1] * r2**2 + c[4] * r2**3
    return x * radial + 2 * c[2] * x * y + c[3] * (r2 + 2 * x * x), y * radial + c[2] * (r2 + 2 * y * y) + 2 * c[3] * x * y


def lens_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_come_back_through_every_lens(spark):
    pick = random.Random(3)
    points = [(pick.uniform(-0.8, 0.8), pick.uniform(-0.8, 0.8)) for _ in range(3000)] + [(0.0, 0.0)]
    kinds = [("kannala_brandt", [0.08, -0.02, 0.001]), ("brown_conrady", [-0.1, 0.02, 0.001, -0.002, 0.003]), (None, [0.05]), ("brown_conrady", None)]
    rows = [(*bent(x, y, *(("plain", None) if kinds[i % 4][1] is None else kinds[i % 4])), *kinds[i % 4]) for i, (x, y) in enumerate(points)]
    rows[0], rows[1] = (None, *rows[0][1:]), (rows[1][0], None, *rows[1][2:])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {SHAPE}")
    found = df.select("i", g.undistort(F.col("x"), F.col("y"), F.col("m"), F.col("c")).alias("u"))
    got = {r["i"]: r["u"] for r in found.collect()}
    assert all(got[i]["x"] is got[i]["residual"] is got[i]["theta"] is None for i in (0, 1))
    for i, (x, y) in list(enumerate(points))[2:]:
        assert math.isclose(got[i]["x"], x, abs_tol=1e-9) and math.isclose(got[i]["y"], y, abs_tol=1e-9) and got[i]["residual"] < 1e-12
        assert math.isclose(got[i]["theta"], math.atan(math.hypot(x, y)), abs_tol=1e-9)
    assert "transform(" not in lens_plan(found) and "aggregate(" not in lens_plan(found)


def test_edges_of_a_frame(spark):
    df = spark.createDataFrame([(1, 640, 480), (2, None, 480)], "i int, w int, h int")
    k = [[F.lit(x) for x in row] for row in K]
    found = df.select("i", g.edge_rays(k, F.col("w"), F.col("h"), F.lit("kannala_brandt"), F.array(F.lit(1e-9))).alias("r"))
    got = {r["i"]: r["r"] for r in found.collect()}
    n = g.EDGE_SAMPLES
    at = [(639 * i / (n - 1), v) for v in (0, 479) for i in range(n)] + [(u, 479 * i / (n - 1)) for u in (0, 639) for i in range(n)]
    assert len(got[1]) == len(got[2]) == 4 * n and got[2][0]["theta"] is None
    assert all(math.isclose(r["theta"], math.hypot((u - 320) / 500, (v - 240) / 400), abs_tol=1e-7) for r, (u, v) in zip(got[1], at, strict=True))
    assert "transform(" not in lens_plan(found)


def halved(p, q, lens, most, depth):
    """Pixels of an edge's points after its first."""
    pixel = lambda s: (lambda d: (d[0] * 500 + 320, d[1] * 400 + 240))(bent(s[0] / s[2], s[1] / s[2], *lens))
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    u, v, w = pixel(p), pixel(q), pixel(m)
    if depth == 0 or math.hypot(w[0] - (u[0] + v[0]) / 2, w[1] - (u[1] + v[1]) / 2) <= most:
        return [v]
    return halved(p, m, lens, most, depth - 1) + halved(m, q, lens, most, depth - 1)


def test_dense_outlines_of_any_polygon(spark, monkeypatch):
    monkeypatch.setattr(lenses, "ROWS", 7)
    pick = random.Random(5)
    lens = {"kannala_brandt": [0.08, -0.02, 0.001, 0.002], "brown_conrady": [-0.1, 0.02]}
    rows = [(i, pick.choice([*lens, None]), None if i % 9 == 0 else [(pick.uniform(-1, 1), pick.uniform(-1, 1), pick.uniform(0.2, 2)) for _ in range(pick.choice([0, 2, 3, 4, 7]))]) for i in range(200)]
    df = spark.createDataFrame([(i, m, lens.get(m), p) for i, m, p in rows], "i int, m string, c array<double>, p array<struct<x:double,y:double,z:double>>")
    camera = F.array(*(F.array(*map(F.lit, row)) for row in K))
    found = outlines.with_dense(df, "d", F.col("p"), camera, F.col("m"), F.col("c"), most=0.05, depth=6).select("i", "d")
    got = {r["i"]: r["d"] for r in found.collect()}
    for i, m, p in rows:
        if p is None or len(p) < 3:
            assert got[i] is None
            continue
        own = (m or "plain", lens.get(m))
        want = [x for a, b in zip(p, [*p[1:], p[0]], strict=True) for x in halved(a, b, own, 0.05, 6)]
        want = [want[-1], *want]
        assert len(got[i]) == len(want) and all(math.isclose(a[j], b[j], rel_tol=1e-9, abs_tol=1e-6) for a, b in zip(got[i], want, strict=True) for j in (0, 1))
    assert "transform(" not in lens_plan(found)


@pytest.mark.parametrize("name", ["dense_outlines", "spherical_frames"])
def test_small_tables_are_dealt_over_all_cores(spark, small, name):
    assert QUERIES[name](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
