"""Matrices and vectors held as columns, so that a step's results are worked out once and not written out in the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.functions import geometry as g


def vec(p: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{p}{i}") for i in range(3))


def mat(p: str) -> list[list[Column]]:
    return [[F.col(f"{p}{i}{j}") for j in range(3)] for i in range(3)]


def hold(rows: DataFrame, **values: object) -> DataFrame:
    """Columns p0 .. p2 of vectors, p00 .. p22 of matrices."""
    out = {}
    for p, v in values.items():
        for i, x in enumerate(v):
            out |= {f"{p}{i}{j}": y for j, y in enumerate(x)} if isinstance(x, (list, tuple)) else {f"{p}{i}": x}
    return rows.withColumns(out)


def names(p: str, matrix: bool = False) -> list[str]:
    return [f"{p}{i}{j}" for i in range(3) for j in range(3)] if matrix else [f"{p}{i}" for i in range(3)]


def with_rigid(rows: DataFrame, out: str, m: str) -> DataFrame:
    """Columns out00 .. out22, the rotation in a scaled one held as m, and out_mirrored (then its third axis is turned round).

    One axis without length is rebuilt from the other two. With two such axes, or with axes that aren't at right angles,
    to a hundredth, there is no rotation: all are null.
    """
    a = f"_{out}"
    rows = hold(rows, **{f"{a}n": [g.norm([F.col(f"{m}{i}{j}") for i in range(3)]) for j in range(3)]})
    flat = [F.col(f"{a}n{j}") <= 1e-10 for j in range(3)]
    rows = hold(rows, **{f"{a}p": [[F.col(f"{m}{i}{j}") / F.when(flat[j], 1.0).otherwise(F.col(f"{a}n{j}")) for j in range(3)] for i in range(3)]})
    axis = lambda p, j: tuple(F.col(f"{p}{i}{j}") for i in range(3))
    rebuilt = [g.cross(axis(f"{a}p", (j + 1) % 3), axis(f"{a}p", (j + 2) % 3)) for j in range(3)]
    rows = hold(rows, **{f"{a}w": [[F.when(flat[j], rebuilt[j][i]).otherwise(F.col(f"{a}p{i}{j}")) for j in range(3)] for i in range(3)]})
    w = [axis(f"{a}w", j) for j in range(3)]
    square = reduce(lambda x, y: x & y, [F.abs(g.dot(w[i], w[j]) - (1.0 if i == j else 0.0)) <= 1e-2 + (1e-5 if i == j else 0.0) for i in range(3) for j in range(i, 3)])
    known = (g.total([f.cast("int") for f in flat]) < 2) & square
    rows = rows.withColumns({f"{out}_mirrored": F.when(known, g.dot(w[0], g.cross(w[1], w[2])) < 0)})
    turned = F.col(f"{out}_mirrored")
    rows = hold(rows, **{out: [[F.when(turned.isNotNull(), F.when(turned & F.lit(j == 2), -F.col(f"{a}w{i}{j}")).otherwise(F.col(f"{a}w{i}{j}"))) for j in range(3)] for i in range(3)]})
    return rows.drop(*names(f"{a}n"), *names(f"{a}p", True), *names(f"{a}w", True))


def with_camera_pose(rows: DataFrame, out: str, camera: str, eye: str, target: str, at: str) -> DataFrame:
    """Columns out_position and out_quaternion (scalar first) of a target (y up, z out) in the axes of a camera that looks
    along -z, both held as matrix and place, of any scale: as seen with z forward and y down, the target's own y down and
    z into its plane. The quaternion is null where axes are skewed.
    """
    a = f"_{out}"
    rows = hold(rows, **{f"{a}b": g.inverse(g.opencv_axes(mat(camera)))})
    turned = [[x if j == 0 else -x for j, x in enumerate(row)] for row in mat(target)]
    rows = hold(rows, **{f"{a}m": g.multiply(mat(f"{a}b"), turned)})
    rows = with_rigid(rows, f"{a}r", f"{a}m")
    place = F.array(*g.apply(mat(f"{a}b"), g.minus(vec(at), vec(eye))))
    rows = rows.withColumns({f"{out}_position": place, f"{out}_quaternion": F.array(*g.quaternion_of(mat(f"{a}r")))})
    return rows.drop(*names(f"{a}b", True), *names(f"{a}m", True), *names(f"{a}r", True), f"{a}r_mirrored")
