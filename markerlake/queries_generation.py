"""Queries that generate scenes for jobs and records from them; jobs come from the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.functions import outlines
from markerlake.generation import compiler, jobs, subjects, world
from markerlake.generation.draws import seed_sql, unit_sql
from markerlake.operators import annotate
from markerlake.queries import query, read, rounded
from markerlake.sources.folders import kept


def part_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each part: two scenes of one to four markers on a grid, or in flight, or a calibration board."""
    key, size = F.col("p_partkey"), F.col("p_size")
    board = F.struct(F.when(size % 2 == 0, "charuco").otherwise("aprilgrid").alias("type"), F.lit(4).alias("rows"), (size % 3 + 3).cast("int").alias("cols"), F.lit(0.03).alias("marker_size"), F.lit(0.04).alias("square_size"), F.lit("DICT_4X4_50").alias("dictionary"), F.lit(None).cast("double").alias("quiet_zone"))
    return read(spark, sf_dir, "part").select(
        key.cast("string").alias("job_id"), key.alias("seed"), F.lit(2).alias("num_scenes"), F.array(F.lit(1), (size % 4 + 1).cast("int")).alias("tags"), F.array(F.lit("tag36h11"), F.lit("tag16h5")).alias("families"),
        (key % 5 == 1).alias("flying"), (key % 5 == 3).alias("use_board"), F.when(key % 5 == 2, "board").otherwise("tags").alias("subject"), board.alias("board"), F.array(F.lit(0.8), F.lit(1.8)).alias("distance"),
        F.when(key % 7 == 0, "kannala_brandt").when(key % 7 == 1, "brown_conrady").otherwise("none").alias("distortion_model"), F.when(key % 7 < 2, F.array(F.lit(0.05), F.lit(-0.01), F.lit(0.001), F.lit(0.002))).alias("distortion_coeffs"),
        F.array(F.lit(2), F.lit(4)).alias("lights"), (key % 2 == 0).alias("intensity_log"), F.array(F.lit(-10.0), F.lit(10.0)).alias("roll"),
    )


#: The seeds of the jobs' scenes.
SCENE_SQL = f"""scene AS (
    SELECT CAST(p_partkey AS VARCHAR) AS job_id, s AS scene_id, p_partkey AS k, p_size AS size, {seed_sql('p_partkey', 'scene', 's')} AS seed FROM part, (SELECT unnest([0, 1]) AS s)
), laid AS (SELECT *, {seed_sql('seed', 'layout')} AS layout FROM scene
), counted AS (SELECT *, CAST(1 + floor({unit_sql('layout', 'count')} * (size % 4 + 1)) AS INTEGER) AS n FROM laid
), shaped AS (SELECT *, CAST(ceil(sqrt(n)) AS INTEGER) AS cols, CAST(ceil(n / ceil(sqrt(n))) AS INTEGER) AS row_count, 0.1 * (1 + 2.0 / 8) AS cell, {unit_sql('layout', 'offset_x')} * 0.5 - 0.25 AS ox, {unit_sql('layout', 'offset_y')} * 0.5 - 0.25 AS oy FROM counted
)"""


@query(f"""WITH {SCENE_SQL}, tag AS (SELECT *, {seed_sql('layout', 'tag_obj', 'i')} AS own FROM (SELECT *, unnest(range(n)) AS i FROM shaped WHERE k % 5 <> 2)
), family AS (SELECT *, CASE WHEN {unit_sql('own', 'family')} < 0.5 THEN 'tag36h11' ELSE 'tag16h5' END AS family FROM tag)
SELECT job_id, scene_id, 'Tag_' || i AS name, family, CAST(floor({unit_sql('own', 'id')} * CASE family WHEN 'tag36h11' THEN 587 ELSE 16 END) AS INTEGER) AS tag_id,
    round(CASE WHEN k % 5 = 1 THEN {unit_sql('layout', 'fly_x', 'i')} - 0.5 ELSE (i % cols - (cols - 1) / 2) * cell + ox END, 6) AS x,
    round(CASE WHEN k % 5 = 1 THEN {unit_sql('layout', 'fly_y', 'i')} - 0.5 ELSE ((row_count - 1) / 2 - i // cols) * cell + oy END, 6) AS y,
    round(CASE WHEN k % 5 = 1 THEN 0.1 + {unit_sql('layout', 'fly_z', 'i')} * 0.9 ELSE 0.001 END, 6) AS z,
    round(CASE WHEN k % 5 = 1 THEN {unit_sql('layout', 'turn_z', 'i')} * 6.283185307179586 ELSE 0 END, 6) AS turn FROM family
UNION ALL SELECT job_id, scene_id, 'Board_Background', NULL, NULL, round(ox, 6), round(oy, 6), -0.005, 0 FROM shaped WHERE k % 5 = 3
UNION ALL SELECT job_id, scene_id, 'CalibrationBoard', NULL, NULL, round({unit_sql(seed_sql('seed', 'layout_offset'), 'x')} * 0.5 - 0.25, 6), round({unit_sql(seed_sql('seed', 'layout_offset'), 'y')} * 0.5 - 0.25, 6), 0, 0 FROM shaped WHERE k % 5 = 2""")
def scene_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the jobs' objects lie."""
    rows = kept(jobs.scenes(part_jobs(spark, sf_dir)).select("job_id", "scene_id", subjects.objects(F.col("job"), F.col("scene_seed")).alias("all")), "objects").select("job_id", "scene_id", F.explode("all").alias("o"))
    at = F.col("o.location")
    return rounded(rows.select("job_id", "scene_id", "o.name", F.col("o.properties.tag_family").alias("family"), F.col("o.properties.tag_id").alias("tag_id"), at[0].alias("x"), at[1].alias("y"), at[2].alias("z"), F.col("o.rotation_euler")[2].alias("turn")))


@query(f"""WITH {SCENE_SQL}, root AS (SELECT *, {seed_sql('w', 'lighting_root')} AS root FROM (SELECT *, {seed_sql('seed', 'world')} AS w FROM scene)
), total AS (SELECT *, CAST(2 + floor({unit_sql('root', 'count')} * 3) AS INTEGER) AS n, CASE WHEN k % 2 = 0 THEN exp(ln(50) + {unit_sql('root', 'total')} * (ln(500) - ln(50))) ELSE 50 + {unit_sql('root', 'total')} * 450 END AS total FROM root
), lit AS (SELECT *, -ln(1 - {unit_sql('root', 'weight', 'i')}) AS weight, {seed_sql('w', 'light', 'i')} AS own FROM (SELECT *, unnest(range(n)) AS i FROM total)
), shell AS (SELECT *, {unit_sql('own', 'theta')} * 6.283185307179586 AS theta, (0.2 + {unit_sql('own', 'phi')} * 0.6) * 1.5707963267948966 AS phi, 2 + {unit_sql('own', 'radius')} * 3 AS r FROM lit)
SELECT job_id, scene_id, CAST(i AS INTEGER) AS light, round(total * weight / sum(weight) OVER (PARTITION BY job_id, scene_id), 4) AS intensity, round(r * sin(phi) * cos(theta), 6) AS x, round(r * sin(phi) * sin(theta), 6) AS y, round(r * cos(phi), 6) AS z FROM shell""")
def scene_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lights of the jobs' scenes."""
    rows = kept(jobs.scenes(part_jobs(spark, sf_dir)).select("job_id", "scene_id", world.world(F.col("job"), F.col("scene_seed")).alias("world")), "worlds").select("job_id", "scene_id", F.posexplode("world.lights").alias("light", "l"))
    at = F.col("l.location")
    return rounded(rows.select("job_id", "scene_id", "light", F.round("l.intensity", 4).alias("intensity"), *(at[i].alias(n) for i, n in enumerate("xyz"))))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS job_id, s AS scene_id, 1 AS cameras, true AS orthonormal, true AS in_reach, true AS above, p_partkey % 7 = 0 AS spherical, p_partkey % 7 = 1 AS linear
FROM part, (SELECT unnest([0, 1]) AS s)""")
def scene_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every compiled camera: a rotation, a distance within the job's bounds of what it looks at, and a frame
    for rendering where its lens asks for one."""
    found = compiler.plain(part_jobs(spark, sf_dir)).select("job_id", "scene_id", "objects", F.col("cameras")[0].alias("c"), F.size("cameras").alias("cameras"), F.exists("objects", lambda o: o["rotation_euler"][2] != 0).alias("flying"))
    m, i = F.col("c.transform_matrix"), F.col("c.intrinsics")
    axis = lambda a, b: sum((m[r][a] * m[r][b] for r in (1, 2)), m[0][a] * m[0][b])
    right = (F.abs(axis(0, 0) - 1) < 1e-9) & (F.abs(axis(1, 1) - 1) < 1e-9) & (F.abs(axis(0, 1)) < 1e-9) & (F.abs(axis(1, 2)) < 1e-9)
    away = F.array_min(F.transform("objects", lambda o: F.sqrt(sum(((m[r][3] - o["location"][r]) * (m[r][3] - o["location"][r]) for r in (1, 2)), (m[0][3] - o["location"][0]) * (m[0][3] - o["location"][0])))))
    # a marker in flight may face the ground: no camera above it finds a pose
    told = lambda c: F.coalesce(c, F.col("flying"))
    lens = (F.col("job_id").cast("bigint") % 7).cast("int")
    return found.select(
        "job_id", "scene_id", F.coalesce("cameras", F.col("flying").cast("int")).alias("cameras"), told(right).alias("orthonormal"), told(away <= 1.8 + 1e-9).alias("in_reach"), told((m[2][3] > 0) | F.col("flying")).alias("above"),
        F.when(F.col("c").isNull(), lens == 0).otherwise(i["fov_spherical"].isNotNull()).alias("spherical"), F.when(F.col("c").isNull(), lens == 1).otherwise(i["k_matrix_overscan"].isNotNull()).alias("linear"),
    )


def kept_scenes(numbered: DataFrame) -> DataFrame:
    """What scenes whose cameras found no pose count for: their markers are there, but no record of them is."""
    size = F.size("objects").cast("bigint")
    return numbered.where("cameras is null").select("job_id", "scene_id", size.alias("single"), F.lit(0).cast("bigint").alias("boards"), F.lit(0).cast("bigint").alias("points"), F.lit(True).alias("whole"), F.lit(0.0).alias("off"))


@query(f"""WITH {SCENE_SQL}, kind AS (SELECT k, job_id, scene_id, n, size FROM shaped)
SELECT job_id, count(*) AS scenes, CAST(sum(CASE WHEN k % 5 = 2 THEN 0 ELSE n END) AS BIGINT) AS single, CAST(sum(CASE WHEN k % 5 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS boards,
    CAST(sum(CASE WHEN k % 5 = 2 THEN 3 * (size % 3 + 2) ELSE 0 END) AS BIGINT) AS calibration_points, true AS target_whole, true AS agree FROM kind GROUP BY job_id""")
def scene_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the jobs' scenes: of each scene its markers and boards, at least one whole in the frame, and pixels that
    the recorded pose projects to."""
    made = compiler.plain(part_jobs(spark, sf_dir)).withColumn("scene_id", F.concat_ws("/", "job_id", F.col("scene_id").cast("string")))
    numbered = kept(made.withColumn("scene_id", F.xxhash64("scene_id")), "scenes")
    found = annotate.detections(numbered).join(numbered.select("scene_id", "job_id"), "scene_id")
    framed = F.forall("corners", lambda p: p[0].between(0, 640) & p[1].between(0, 480))
    # the pose alone, through lens and intrinsics, gives the first corner; of one near the camera's plane, which a lens
    # throws far out of the frame, to the same share of its place
    half = F.get(outlines.square(F.col("position"), F.col("rotation_quaternion"), F.col("tag_size_mm") / 1000), F.lit(0))
    again = outlines.pixel(half, F.col("k_matrix"), F.col("distortion_model"), F.col("distortion_coeffs"))
    off = F.when((F.col("record_type") == "TAG") & (F.col("corners")[0][0] > -999999), F.greatest(*(F.abs(again[i] - F.col("corners")[0][i]) / F.greatest(F.lit(1.0), F.abs(F.col("corners")[0][i]) / 1000) for i in range(2))))
    rows = found.select("job_id", "scene_id", "record_type", (F.col("board_definition").isNotNull() | (F.col("record_type") == "TAG") & (F.col("tag_family") != "DICT_4X4_50")).alias("single"), F.size(F.coalesce("keypoints", F.array())).alias("points"), (framed | (F.col("record_type") == "BOARD")).alias("framed"), off.alias("off"))
    scene = rows.groupBy("job_id", "scene_id").agg(F.count_if(F.col("single") & (F.col("record_type") == "TAG")).alias("single"), F.count_if(F.col("record_type") == "BOARD").alias("boards"), F.sum("points").alias("points"), F.bool_or("framed").alias("whole"), F.coalesce(F.max("off"), F.lit(0.0)).alias("off"))
    lost = kept_scenes(numbered)
    return scene.unionByName(lost).groupBy("job_id").agg(F.count("*").alias("scenes"), F.sum("single").alias("single"), F.sum("boards").alias("boards"), F.sum("points").alias("calibration_points"), F.bool_and("whole").alias("target_whole"), (F.max("off") < 1e-6).alias("agree"))
