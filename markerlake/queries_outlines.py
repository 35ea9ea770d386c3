"""Queries of inverse lenses, rigid frames, clipped and dense outlines, points for viewers, run rollups and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import outlines
from markerlake.functions.differences import differences
from markerlake.functions.frames import hold, mat, vec, with_camera_pose, with_rigid
from markerlake.operators import points, runs
from markerlake.plans.adapter import SQL
from markerlake.queries import det, query, read, rounded
from markerlake.sources.folders import spread


def lens() -> Column:
    return F.array(*(F.lit(x) for x in (0.08, -0.02, 0.001, 0.002, 0.0)))


@query(f"WITH {SQL} SELECT seq, round((cx - 960) / 1500, 6) AS x, round((cy - 540) / 1500, 6) AS y, true AS exact FROM det")
def lens_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through a lens and back again."""
    rows = det(spark, sf_dir).select("seq", ((F.col("cx") - 960) / 1500).alias("x"), ((F.col("cy") - 540) / 1500).alias("y"), F.when(F.col("seq") % 2 == 0, "kannala_brandt").otherwise("brown_conrady").alias("m"))
    bent = rows.select("seq", "m", F.array(*g.distort(F.col("x"), F.col("y"), F.col("m"), lens())).alias("d"))
    back = bent.select("seq", g.undistort(F.col("d")[0], F.col("d")[1], F.col("m"), lens()).alias("u"))
    return rounded(back.select("seq", "u.x", "u.y", (F.col("u.residual") < 1e-12).alias("exact")))


@query("""WITH s AS (SELECT s_suppkey AS id, 300.0 + s_suppkey % 400 AS f FROM supplier), r AS (SELECT *, sqrt(320 * 320 + 240 * 240) / f AS rho FROM s)
SELECT id, round(2 * (rho + radians(2)), 5) AS fov, CAST(2 * ceil(round(f * (rho + radians(2)), 6)) AS INTEGER) AS size FROM r""")
def spherical_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equidistant lenses: the farthest edge ray is the corner's, at its radius over the focal length."""
    f, zero = 300.0 + F.col("s_suppkey") % 400, F.lit(0.0)
    k = [[F.col("f"), zero, F.lit(320.0)], [zero, F.col("f"), F.lit(240.0)], [zero, zero, F.lit(1.0)]]
    rows = spread(read(spark, sf_dir, "supplier").select("s_suppkey")).select(F.col("s_suppkey").alias("id"), f.alias("f"), F.array(F.lit(1e-9), zero, zero, zero).alias("c"))
    rays = rows.select("id", "f", g.edge_rays(k, F.lit(640), F.lit(480), F.lit("kannala_brandt"), F.col("c")).alias("rays"))
    return rays.select("id", g.spherical_overscan(F.col("rays"), k).alias("s")).select("id", F.round("s.fov", 5).alias("fov"), "s.size")


@query("""WITH p AS (SELECT p_partkey AS id, radians(p_size * 7) AS a, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END AS flip FROM part)
SELECT id, p.id % 11 <> 0 AS known, CASE WHEN id % 11 <> 0 THEN round(cos(a), 6) END AS r00, CASE WHEN id % 11 <> 0 THEN round(-sin(a), 6) END AS r01, CASE WHEN id % 11 <> 0 THEN 1.0::DOUBLE END AS r22, CASE WHEN id % 11 <> 0 THEN flip < 0 AND id % 3 <> 0 END AS mirrored FROM p""")
def rigid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled turns about z: some mirrored in z, some without a z axis (rebuilt), some skewed (none)."""
    a, key = F.radians(F.col("p_size") * 7), F.col("p_partkey")
    sx, sy = 0.5 + key % 4, 0.25 + key % 3
    sz = F.when(key % 3 == 0, 0.0).otherwise(F.when(key % 5 == 0, -2.0).otherwise(2.0))
    skew = F.when(key % 11 == 0, 0.5).otherwise(0.0)
    rows = hold(read(spark, sf_dir, "part").select(key.alias("id"), *(c.alias(n) for c, n in ((F.cos(a), "c"), (F.sin(a), "s"), (sx.cast("double"), "sx"), (sy.cast("double"), "sy"), (sz, "sz"), (skew, "skew")))), m=[
        [F.col("c") * F.col("sx"), -F.col("s") * F.col("sy") + F.col("skew") * F.col("c"), F.lit(0.0)], [F.col("s") * F.col("sx"), F.col("c") * F.col("sy") + F.col("skew") * F.col("s"), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.col("sz")],
    ])
    found = with_rigid(rows, "r", "m")
    return rounded(found.select("id", F.col("r00").isNotNull().alias("known"), "r00", "r01", "r22", F.col("r_mirrored").alias("mirrored")))


@query("""WITH p AS (SELECT p_partkey AS id, radians(p_size * 3) AS a, p_partkey % 40 / 20.0 - 1 AS x, p_partkey % 30 / 15.0 - 1 AS y FROM part)
SELECT id, round(x / 2, 6) + 0.0 AS px, round(-y / 2, 6) + 0.0 AS py, 1.5::DOUBLE AS pz, round(cos(a / 2), 6) AS qw, round(-sin(a / 2), 6) + 0.0 AS qz FROM p""")
def camera_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers turned about z under a camera of scale 2 that looks down from 3 m: seen with y down and z into their plane."""
    key, a = F.col("p_partkey"), F.radians(F.col("p_size") * 3)
    zero, two, one = F.lit(0.0), F.lit(2.0), F.lit(1.0)
    rows = read(spark, sf_dir, "part").select(key.alias("id"), a.alias("a"), (key % 40 / 20.0 - 1).alias("x"), (key % 30 / 15.0 - 1).alias("y"))
    c, s = F.cos("a"), F.sin("a")
    rows = hold(rows, c=[[two, zero, zero], [zero, two, zero], [zero, zero, two]], e=(zero, zero, F.lit(3.0)), m=[[c * 0.3, -s * 0.3, zero], [s * 0.3, c * 0.3, zero], [zero, zero, one]], t=(F.col("x"), F.col("y"), zero))
    found = with_camera_pose(rows, "p", "c", "e", "m", "t")
    p, q = F.col("p_position"), F.col("p_quaternion")
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)  # a turn has two quaternions
    values = {"px": p[0], "py": p[1], "pz": p[2], "qw": sign * q[0], "qz": sign * q[3]}
    return found.select("id", *((F.round(v, 6) + 0.0).alias(n) for n, v in values.items()))  # no negative zeros


#: Markers at right angles to the image, edge-on to the camera's axis: some reach behind it.
SIDE_SQL = "WITH p AS (SELECT p_partkey AS id, 0.2 + p_partkey % 7 / 10.0 AS x, 0.05 + p_partkey % 50 / 50.0 AS z FROM part), c AS (SELECT *, greatest(0.001, z - 0.3) AS near FROM p)"


def camera() -> Column:
    return F.array(*(F.array(*map(F.lit, row)) for row in ((500.0, 0.0, 320.0), (0.0, 500.0, 240.0), (0.0, 0.0, 1.0))))


def sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(key.alias("id"), F.array(0.2 + key % 7 / 10.0, F.lit(0.0), 0.05 + key % 50 / 50.0).alias("p"), F.array(*(F.lit(x) for x in (0.7071067811865476, 0.0, 0.7071067811865476, 0.0))).alias("q"))
    return rows.select("id", outlines.clip_near(outlines.square(F.col("p"), F.col("q"), F.lit(0.6))).alias("points"))


@query(f"{SIDE_SQL} SELECT id, CAST(4 AS INTEGER) AS n, round(500 * x / (z + 0.3) + 320, 4) AS x, round(500 * x / near - 500 * x / (z + 0.3), 4) AS w, round(240 - 500 * 0.3 / near, 4) AS y, round(1000 * 0.3 / near, 4) AS h FROM c")
def pose_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of markers from their pose, cut where they pass the camera."""
    box = outlines.pose_box(F.col("points"), camera(), F.lit("none"), F.array().cast("array<double>"))
    rows = sideways(spark, sf_dir).select("id", F.size("points").alias("n"), box.alias("b"))
    return rounded(rows.select("id", "n", *(F.col("b")[i].alias(c) for i, c in enumerate("xywh"))), 4)


@query("SELECT p_partkey AS id, true AS closed, true AS near, true AS holds_corners FROM part")
def dense_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines under a fisheye lens: closed, of the area that finer ones have, and with all corners among their points."""
    key, model = F.col("p_partkey"), F.lit("kannala_brandt")
    rows = spread(read(spark, sf_dir, "part").select("p_partkey")).select(key.alias("id"), F.array(key % 9 / 10.0 - 0.4, key % 5 / 10.0 - 0.2, 0.6 + key % 4 / 10.0).alias("p"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("q"))
    rows = rows.select("id", outlines.clip_near(outlines.square(F.col("p"), F.col("q"), F.lit(0.4))).alias("points"))
    found = outlines.with_dense(rows, "d", F.col("points"), camera(), model, lens())
    found = outlines.with_dense(found, "finer", F.col("points"), camera(), model, lens(), most=0.02)
    corner = F.transform("points", lambda p: outlines.pixel(p, camera(), model, lens()))
    found = found.withColumns({"corner": corner, "area": F.abs(g.polygon_area(F.col("d"))), "finer_area": F.abs(g.polygon_area(F.col("finer")))})
    near = F.abs(F.col("area") - F.col("finer_area")) < 0.001 * F.col("finer_area")
    off = F.transform("corner", lambda c: F.array_min(F.transform("d", lambda p: F.abs(p[0] - c[0]) + F.abs(p[1] - c[1]))))
    return found.select("id", (F.get("d", F.lit(0)) == F.get("d", F.size("d") - 1)).alias("closed"), near.alias("near"), (F.array_max(off) < 1e-6).alias("holds_corners"))


@query(f"""WITH {SQL}, c AS (SELECT seq, unnest([0, 1, 2, 3]) AS i, unnest([x1, x2, x3, x4]) AS x, unnest([y1, y2, y3, y4]) AS y FROM det),
v AS (SELECT *, CASE WHEN seq % 4 = 0 THEN i % 3 WHEN x >= 30 AND x < 1890 AND y >= 30 AND y < 1050 THEN 2 ELSE 1 END AS v FROM c)
SELECT seq, CAST(i AS VARCHAR) AS label, round(x / 1920, 6) AS x, round(y / 1080, 6) AS y, CAST(v AS INTEGER) AS visibility, CASE v WHEN 0 THEN 'sentinel' WHEN 1 THEN 'margin' ELSE '' END AS tags FROM v""")
def viewer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners as labelled points of a viewer, with stored flags for every fourth record."""
    flags = F.when(F.col("seq") % 4 == 0, F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(0)))
    each = det(spark, sf_dir).select("seq", F.explode(points.labelled(F.col("corners"), F.lit(1920), F.lit(1080), 30, flags)).alias("k")).select("seq", "k.*")
    return rounded(each.withColumn("tags", F.array_join("tags", ",")))


@query(f"WITH {SQL}, n AS (SELECT seq, h, " + " + ".join(f"CASE WHEN x{i} >= 0 AND x{i} < 1920 AND y{i} >= 0 AND y{i} < 1080 THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS inside, CASE WHEN seq % 89 <> 0 AND seq % 97 <> 0 OR seq % 89 = 0 THEN 4 * h * h ELSE 4 * h * h END AS area FROM det) SELECT seq, CAST(inside AS INTEGER) AS inside, round(area, 4) AS area, inside >= 3 AND area >= 400 AS ok, CASE WHEN seq % 2 = 0 THEN 2 ELSE 5 END AS points, CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS visible FROM n")
def frame_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and area within the frame, and key points with their mask: two of them, or five that aren't there."""
    own = F.when(F.col("seq") % 2 == 0, F.array(F.array(F.lit(5.0), F.lit(5.0)), F.array(F.lit(-1.0), F.lit(-1.0))))
    rows = det(spark, sf_dir).select("seq", points.in_frame(F.col("corners"), F.lit(1920), F.lit(1080), 3, 400.0).alias("f"), points.with_visible(own, F.lit(5)).alias("k"))
    return rounded(rows.select("seq", "f.*", F.size("k.points").alias("points"), F.size(F.filter("k.visible", lambda v: v)).alias("visible")))


@query("""WITH o AS (SELECT o_custkey % 20 AS run_id, o_orderkey AS scene_id, CASE WHEN o_orderkey % 7 = 0 THEN 'error ' || o_orderkey END AS error FROM orders)
SELECT run_id, CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS done, count(error) AS failed, coalesce(array_to_string(list(error ORDER BY scene_id) FILTER (error IS NOT NULL)[:3], ';'), '') AS first_errors FROM o GROUP BY run_id""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("run_id"), key.alias("scene_id"), F.when(key % 7 == 0, F.concat(F.lit("error "), key.cast("string"))).alias("error"))
    return runs.rollup(rows).withColumn("first_errors", F.array_join("first_errors", ";"))


@query(f"""WITH {SQL} SELECT seq, concat_ws(';', CASE WHEN seq % 3 = 0 THEN '$.distance: value' END, CASE WHEN seq % 5 = 0 THEN '$.corners[2][1]: value' END, CASE WHEN seq % 7 = 0 THEN '$.resolution: length' END, CASE WHEN seq % 4 = 0 THEN '$.tag_family: null' END) AS found FROM det""")
def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against copies that differ in a value, a nested value, a length, a null, or by rounding alone."""
    rows = det(spark, sf_dir)
    same = F.struct("distance", "corners", "resolution", "tag_family")
    moved = F.transform("corners", lambda p, i: F.transform(p, lambda v, j: F.when((i == 2) & (j == 1) & (F.col("seq") % 5 == 0), v + 1).otherwise(v * (1 + 1e-13))))
    other = F.struct(
        (F.col("distance") + F.when(F.col("seq") % 3 == 0, 0.5).otherwise(0.0)).alias("distance"), moved.alias("corners"),
        F.when(F.col("seq") % 7 == 0, F.slice("resolution", 1, 1)).otherwise(F.col("resolution")).alias("resolution"), F.when(F.col("seq") % 4 != 0, F.col("tag_family")).alias("tag_family"),
    )
    pairs = rows.select("seq", same.alias("a"), other.alias("b"))
    found = differences(F.col("a"), F.col("b"), pairs.schema["a"].dataType, pairs.schema["b"].dataType)
    return pairs.select("seq", F.array_join(found, ";").alias("found"))
