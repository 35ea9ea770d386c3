"""Queries of poses, lenses, intrinsics and calibration records over `part` and the detections; they join those of queries.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.queries import query, read, vec

#: Off exact halves of the last digit, which engines round differently.
OFF = 1e-8

#: A pose for each part: Euler angles over all octants, a place and a target.
POSES_SQL = "pose AS (SELECT p_partkey, p_partkey % 61 / 10.0 - 3 AS rx, p_partkey % 29 / 10.0 - 1.4 AS ry, p_partkey % 53 / 9.0 - 2.9 AS rz, p_size / 10.0 AS x, p_partkey % 7 - 3.0 AS y, 1 + p_partkey % 5 / 2.0 AS z FROM part)"
#: Rz Ry Rx, term by term.
ROTATION_SQL = "m AS (SELECT *, cos(rz) * cos(ry) AS m11, cos(rz) * sin(ry) * sin(rx) - sin(rz) * cos(rx) AS m12, cos(rz) * sin(ry) * cos(rx) + sin(rz) * sin(rx) AS m13, sin(rz) * cos(ry) AS m21, sin(rz) * sin(ry) * sin(rx) + cos(rz) * cos(rx) AS m22, sin(rz) * sin(ry) * cos(rx) - cos(rz) * sin(rx) AS m23, -sin(ry) AS m31, cos(ry) * sin(rx) AS m32, cos(ry) * cos(rx) AS m33 FROM pose)"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        "p_partkey", (key % 61 / 10.0 - 3).alias("rx"), (key % 29 / 10.0 - 1.4).alias("ry"), (key % 53 / 9.0 - 2.9).alias("rz"),
        (F.col("p_size") / 10.0).alias("x"), (key % 7 - 3.0).alias("y"), (1 + key % 5 / 2.0).alias("z"),
    )


def shown(c: Column, digits: int = 6) -> Column:
    return F.round(c + OFF, digits)


def shown_sql(c: str, digits: int = 6) -> str:
    return f"round({c} + {OFF}, {digits})"


def grid(m: list[list[Column]]) -> Column:
    return F.array(*(F.array(*row) for row in m))


def matrix(name: str) -> list[list[Column]]:
    return [[F.col(name)[i][j] for j in range(3)] for i in range(3)]


HALF_ANGLES = "h AS (SELECT p_partkey, cos(rx / 2) AS a, sin(rx / 2) AS b, cos(ry / 2) AS c, sin(ry / 2) AS d, cos(rz / 2) AS e, sin(rz / 2) AS f FROM pose)"
QUATERNION = "q AS (SELECT p_partkey, a * c * e + b * d * f AS w, b * c * e - a * d * f AS i, a * d * e + b * c * f AS j, a * c * f - b * d * e AS k FROM h)"


@query(f"WITH {POSES_SQL}, {HALF_ANGLES}, {QUATERNION} SELECT p_partkey, {shown_sql('abs(w)')} AS qw, " + ", ".join(f"{shown_sql(f'w * {c}')} AS q{c}" for c in "ijk") + " FROM q")
def pose_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternions of Euler rotations: the size of w, and products with w, as a quaternion's sign is free."""
    rows = poses(spark, sf_dir).withColumn("m", grid(g.euler_rotation(*vec("rx", "ry", "rz"))))
    w, *rest = g.quaternion_of(matrix("m"))
    return rows.select("p_partkey", shown(F.abs(w)).alias("qw"), *(shown(w * c).alias(f"q{n}") for n, c in zip("ijk", rest, strict=True)))


@query(f"WITH {POSES_SQL}, {ROTATION_SQL} SELECT p_partkey, " + ", ".join(f"{shown_sql(f'm{i}{j}')} AS m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + " FROM m")
def quaternion_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler angles to a matrix, to a quaternion and back."""
    rows = poses(spark, sf_dir).withColumn("m", grid(g.euler_rotation(*vec("rx", "ry", "rz"))))
    rows = rows.withColumn("q", F.array(*g.quaternion_of(matrix("m"))))
    back = g.rotation_of([F.col("q")[i] for i in range(4)])
    return rows.select("p_partkey", *(shown(back[i][j]).alias(f"m{i + 1}{j + 1}") for i in range(3) for j in range(3)))


@query(f"WITH {POSES_SQL}, {ROTATION_SQL} SELECT p_partkey, " + ", ".join(f"{shown_sql(f'(p_partkey % 2 * -2 + 1) * m{i}3')} AS n{i}" for i in (1, 2, 3)) + f", {shown_sql('-m12')} AS axis2, {shown_sql('-m33')} AS axis3 FROM m")
def world_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals under rotations whose axes are stretched by 2, 3 and 0.5, every second one mirrored in z; the camera's axes turned."""
    rows = poses(spark, sf_dir).withColumn("m", grid(g.euler_rotation(*vec("rx", "ry", "rz"))))
    mirror = F.when(F.col("p_partkey") % 2 == 1, -0.5).otherwise(0.5)
    scaled = [[row[0] * 2, row[1] * 3, row[2] * mirror] for row in matrix("m")]
    turned = g.opencv_axes(matrix("m"))
    return rows.select("p_partkey", *(shown(c).alias(f"n{i}") for i, c in enumerate(g.world_normal(scaled), 1)), shown(turned[0][1]).alias("axis2"), shown(turned[2][2]).alias("axis3"))


@query(f"WITH {POSES_SQL}, {ROTATION_SQL}, t AS (SELECT *, x - 1 AS dx, y - 2 AS dy, z + 0.5 AS dz FROM m) SELECT p_partkey, " + ", ".join(f"{shown_sql(f'm1{i} * dx + m2{i} * dy + m3{i} * dz')} AS t{i}" for i in (1, 2, 3)) + ", " + ", ".join(f"{shown_sql(f'm{j}{i}')} AS r{i}{j}" for i, j in ((1, 2), (2, 3), (3, 1))) + " FROM t")
def relative_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target without rotation at (x, y, z), from cameras of every rotation at (1, 2, -0.5)."""
    rows = poses(spark, sf_dir).withColumn("m", grid(g.euler_rotation(*vec("rx", "ry", "rz"))))
    same = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    r, t = g.relative_pose((matrix("m"), (F.lit(1.0), F.lit(2.0), F.lit(-0.5))), (same, vec("x", "y", "z")))
    return rows.select("p_partkey", *(shown(c).alias(f"t{i}") for i, c in enumerate(t, 1)), *(shown(r[i - 1][j - 1]).alias(f"r{i}{j}") for i, j in ((1, 2), (2, 3), (3, 1))))


@query(f"WITH {POSES_SQL}, d AS (SELECT p_partkey, sqrt(x * x + y * y + z * z) AS n, sqrt(x * x + y * y) AS s, x, y, z, radians(p_partkey % 360) AS az, radians(p_partkey % 91) AS el FROM pose), e AS (SELECT *, z / n > 0.999 AS up FROM d) SELECT p_partkey, {shown_sql('CASE WHEN up THEN z / sqrt(x * x + z * z) ELSE -y / s END')} AS right_x, {shown_sql('CASE WHEN up THEN 0 ELSE x / s END')} AS right_y, {shown_sql('x / n')} AS back_x, {shown_sql('y / n')} AS back_y, {shown_sql('z / n')} AS back_z, {shown_sql('cos(el) * cos(az)')} AS sun_x, {shown_sql('cos(el) * sin(az)')} AS sun_y, {shown_sql('sin(el)')} AS sun_z FROM e")
def camera_and_sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras at (x, y, z) that look at the origin, and the sun's direction; nearly vertical looks take y as up."""
    zero = F.lit(0.0)
    m = g.look_at(vec("x", "y", "z"), (zero, zero, zero))
    sun = g.sun_vector(F.col("p_partkey") % 360, F.col("p_partkey") % 91)
    return poses(spark, sf_dir).select("p_partkey", shown(m[0][0]).alias("right_x"), shown(m[1][0]).alias("right_y"), *(shown(m[i][2]).alias(f"back_{n}") for i, n in enumerate("xyz")), *(shown(c).alias(f"sun_{n}") for n, c in zip("xyz", sun, strict=True)))


BROWN = {axis: f"{axis} * (1 + r2 * (-0.2 + r2 * (0.05 + r2 * 0.01))) + {tangential}" for axis, tangential in (("u", "2 * 0.002 * u * v + -0.001 * (r2 + 2 * u * u)"), ("v", "0.002 * (r2 + 2 * v * v) + 2 * -0.001 * u * v"))}
FISHEYE = "CASE WHEN r2 <= 1e-16 THEN 1 ELSE atan(sqrt(r2)) * (1 + pow(atan(sqrt(r2)), 2) * 0.08 + pow(atan(sqrt(r2)), 4) * -0.02 + pow(atan(sqrt(r2)), 6) * 0.004 + pow(atan(sqrt(r2)), 8) * 0.001) / sqrt(r2) END"


@query(f"WITH {POSES_SQL}, n AS (SELECT p_partkey, p_partkey % 3 AS lens, x / z / 2 AS u, y / z / 2 AS v, (x * x + y * y) / (z * z) / 4 AS r2 FROM pose) SELECT p_partkey, " + ", ".join(f"{shown_sql(f'CASE lens WHEN 0 THEN {BROWN[c]} WHEN 1 THEN {c} * ({FISHEYE}) ELSE {c} END')} AS {c}" for c in "uv") + " FROM n")
def lens_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coefficients of both lens models, and a fisheye whose coefficients are too small to count."""
    lens = F.col("p_partkey") % 3
    values = lambda *x: F.array(*map(F.lit, x))
    coefficients = F.when(lens == 0, values(-0.2, 0.05, 0.002, -0.001, 0.01)).when(lens == 1, values(0.08, -0.02, 0.004, 0.001)).otherwise(values(0.0, 0.0))
    rows = poses(spark, sf_dir).select("p_partkey", (F.col("x") / F.col("z") / 2).alias("u"), (F.col("y") / F.col("z") / 2).alias("v"), F.when(lens == 0, "brown_conrady").otherwise("kannala_brandt").alias("model"), coefficients.alias("coefficients"))
    bent = g.distort(F.col("u"), F.col("v"), F.col("model"), F.col("coefficients"))
    return rows.select("p_partkey", *(shown(c).alias(n) for n, c in zip("uv", bent, strict=True)))


@query("""WITH k AS (SELECT p_partkey, p_partkey % 4 AS known, 640.0 + p_size AS w, 480.0 AS h FROM part),
f AS (SELECT *, CASE known WHEN 0 THEN 700.0 WHEN 1 THEN 800.0 WHEN 2 THEN 8.0 * w / 6.4 ELSE w / (2 * tan(radians(60.0) / 2)) END AS fx, CASE known WHEN 0 THEN 710.0 WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 800.0 ELSE 805.0 END WHEN 2 THEN 8.0 * w / 6.4 ELSE w / (2 * tan(radians(60.0) / 2)) END AS fy FROM k)
SELECT p_partkey, round(fx * 0.5, 6) AS fx, round(fy * 0.25, 6) AS fy, round(CASE known WHEN 0 THEN 300.0 ELSE w / 2 END * 0.5, 6) AS cx, round(CASE known WHEN 0 THEN 200.0 ELSE h / 2 END * 0.25, 6) AS cy FROM f""")
def intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics from a matrix, from fx (and fy), from the sensor or from the field of view; then at another resolution."""
    known = F.col("p_partkey") % 4
    only = lambda i, x: F.when(known == i, F.lit(x))
    given = F.when(known == 0, grid([[F.lit(x) for x in row] for row in ((700.0, 0.0, 300.0), (0.0, 710.0, 200.0), (0.0, 0.0, 1.0))]))
    fy = F.when(F.col("p_partkey") % 8 == 5, 805.0)
    width = F.lit(640.0) + F.col("p_size")
    k = g.k_matrix(width, F.lit(480.0), given, only(1, 800.0), fy, only(2, 8.0), only(2, 6.4), F.lit(60.0))
    rows = read(spark, sf_dir, "part").select("p_partkey", g.rescale_k(k, F.lit(0.5), F.lit(0.25)).alias("k"))
    at = lambda i, j: F.round(F.col("k")[i][j], 6)
    return rows.select("p_partkey", at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy"))


@query(f"WITH {POSES_SQL}, t AS (SELECT *, (0.25 - z) / (y / 2 - z) AS t, sqrt(x * x + y * y + z * z) AS n FROM pose) SELECT p_partkey, CASE WHEN abs(y / 2 - z) >= 1e-12 AND t > 0 AND t < 1 THEN {shown_sql('x + t * (1 - x)')} END AS hit_x, CASE WHEN abs(y / 2 - z) >= 1e-12 AND t > 0 AND t < 1 THEN {shown_sql('y + t * (2 - y)')} END AS hit_y, z / n > 0.15 AS front, y / n > 0.15 AS side, {shown_sql("CASE WHEN p_partkey % 9 = 0 THEN 100 ELSE 500 * 0.1 / (p_partkey % 9 * 8) END")} AS away FROM t")
def rays_and_facing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where ways from (x, y, z) to (1, 2, y / 2) cross a height, which sides they see, and distances for a resolution."""
    zero, one = F.lit(0.0), F.lit(1.0)
    hit = g.ray_at_plane(vec("x", "y", "z"), (one, F.lit(2.0), F.col("y") / 2), F.lit(0.25))
    origin = (zero, zero, zero)
    away = g.distance_for_ppm(F.lit(500.0), F.lit(0.1), F.col("p_partkey") % 9, F.lit(8))
    rows = poses(spark, sf_dir).withColumn("hit", hit)
    return rows.select("p_partkey", shown(F.col("hit")[0]).alias("hit_x"), shown(F.col("hit")[1]).alias("hit_y"), g.facing(origin, vec("x", "y", "z"), (zero, zero, one)).alias("front"), g.facing(origin, vec("x", "y", "z"), (zero, F.lit(2.0), zero)).alias("side"), shown(away).alias("away"))


@query(f"""WITH a AS (SELECT DISTINCT o_custkey, o_orderkey % 628 / 100.0 AS angle FROM orders), n AS (SELECT *, lead(angle) OVER w AS next, first(angle) OVER w AS first FROM a WINDOW w AS (PARTITION BY o_custkey ORDER BY angle))
SELECT o_custkey, count(*) AS n, {shown_sql('max(coalesce(next, first + 6.283185307179586) - angle)')} AS gap FROM n GROUP BY o_custkey""")
def circular_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest gap between the angles of a customer's orders, some of them given a turn less."""
    angle = F.col("o_orderkey") % 628 / 100.0
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(angle).alias("angles"))
    moved = F.transform("angles", lambda x: F.when(x > 3, x - 6.283185307179586).otherwise(x))
    return rows.select("o_custkey", F.size("angles").cast("bigint").alias("n"), shown(g.largest_gap(moved)).alias("gap"))
