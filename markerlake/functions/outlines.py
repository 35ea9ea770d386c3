"""Outlines of square markers from their pose: clipped at the near plane, and dense where a lens bends their edges.

Polygons are arrays of structs (x, y, z) in camera axes; all steps are higher-order functions over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import lenses
from markerlake.functions.records import bounding_box

NEAR = 0.001  # metres
MOST_ERROR = 0.1  # pixels between a chord and the edge that it stands for
DEPTH = 12  # halvings of an edge, at most


def xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def between(p: Column, q: Column, t: Column) -> Column:
    return xyz(*(p[c] + t * (q[c] - p[c]) for c in "xyz"))


def square(position: Column, quaternion: Column, size: Column) -> Column:
    """Corners of a marker (top left first, clockwise as seen) in camera axes: x right, y down, z into its plane."""
    turn = g.rotation_of([quaternion[i] for i in range(4)])
    at = tuple(position[i] for i in range(3))
    half, zero = size / 2, F.lit(0.0)
    return F.array(*(xyz(*g.place(turn, at, (sx * half, sy * half, zero))) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def clip_near(points: Column, near: float = NEAR) -> Column:
    """The part of a polygon beyond the near plane, edge by edge."""

    def edge(points: Column, p: Column, i: Column) -> Column:
        q = F.get(points, (i + 1) % F.size(points))
        a, b = p["z"] > near, q["z"] > near
        cut = between(p, q, (near - p["z"]) / F.when(q["z"] == p["z"], 1.0).otherwise(q["z"] - p["z"]))
        return F.when(a & b, F.array(q)).when(a, F.array(cut)).when(b, F.array(cut, q)).otherwise(F.filter(F.array(q), lambda _: F.lit(False)))

    return F.flatten(g.let(points, lambda s: F.transform(s, lambda p, i: edge(s, p, i))))


def pixel(p: Column, k: Column, model: Column, coefficients: Column) -> Column:
    """[u, v] of a point before the camera."""
    return g.let(g.distort_point(p["x"] / p["z"], p["y"] / p["z"], model, coefficients), lambda d: F.array(d[0] * k[0][0] + k[0][2], d[1] * k[1][1] + k[1][2]))


def with_dense(rows: DataFrame, name: str, points: Column, k: Column, model: Column, coefficients: Column, most: float = MOST_ERROR, depth: int = DEPTH) -> DataFrame:
    """A column with the pixels of a clipped polygon whose edges are halved until chords are near them, the first point
    again at the end; null for fewer than three points."""
    numbers = [x.cast("double") for x in (k[0][0], k[0][2], k[1][1], k[1][2])]
    return rows.withColumn(name, lenses.dense(points, *numbers, F.lit(float(most)), F.lit(depth), *g.lens_of(model, coefficients)))


def pose_box(points: Column, k: Column, model: Column, coefficients: Column) -> Column:
    """Box of a clipped polygon's pixels; all zero for fewer than three points."""
    found = bounding_box(F.transform(points, lambda p: pixel(p, k, model, coefficients)))
    return F.when(F.size(points) >= 3, found).otherwise(F.array_repeat(F.lit(0.0), 4))
