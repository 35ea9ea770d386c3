"""Detections derived from the standard `events` table: integer arithmetic only, so that any engine gets the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, EDGE = 1920, 1080, 20


def detections(events: DataFrame) -> DataFrame:
    """One detection for each event, with `seq` as its place in the file."""
    e = F.col("event_id")
    cx, cy, h = F.col("cx"), F.col("cy"), F.col("h")
    base = events.select(
        e.alias("seq"),
        F.concat(F.lit("scene_"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("_cam_"), F.lpad((e % 4).cast("string"), 4, "0")).alias("image_id"),
        (e % 30).alias("tag_id"),
        F.element_at(F.array(F.lit("tag36h11"), F.lit("tag16h5"), F.lit("DICT_4X4_50")), (e % 3 + 1).cast("int")).alias("tag_family"),
        F.when(e % 50 == 0, "BOARD").otherwise("TAG").alias("record_type"),
        ((e * 7919) % WIDTH).cast("double").alias("cx"), ((e * 104729) % HEIGHT).cast("double").alias("cy"), (10 + (e * 31) % 90).cast("double").alias("h"),
        ((F.lit(0.5) + F.col("value") / 50) * F.when(e % 4999 == 0, -1.0).otherwise(1.0)).alias("distance"),
        ((e * 13) % 90).cast("double").alias("angle_of_incidence"), ((e % 20) / 40.0).alias("occlusion_ratio"), (100 + F.col("value")).alias("lighting_intensity"),
        F.col("user_id"),
    )
    p = {"tl": (cx - h, cy - h), "tr": (cx + h, cy - h), "br": (cx + h, cy + h), "bl": (cx - h, cy + h)}
    turned, mirrored = F.col("seq") % 89 == 0, (F.col("seq") % 89 == 0) | (F.col("seq") % 97 == 0)
    pick = lambda c, a, b: [F.when(c, u).otherwise(v) for u, v in zip(p[a], p[b], strict=True)]
    corners = [pick(turned, "br", "tl"), pick(mirrored, "bl", "tr"), pick(turned, "tl", "br"), pick(mirrored, "tr", "bl")]
    inside = lambda q: (q[0] >= EDGE) & (q[0] < WIDTH - EDGE) & (q[1] >= EDGE) & (q[1] < HEIGHT - EDGE)
    z = 1000 * 0.1 / (2 * h)
    zero, one = F.lit(0.0), F.lit(1.0)
    return base.select(
        "*",
        F.array(*(F.array(*q) for q in corners)).alias("corners"),
        F.array(*(F.when((F.col("seq") % 71 == 0) | inside(q), 2).otherwise(1).cast("tinyint") for q in corners)).alias("corners_visibility"),
        F.array(F.lit(WIDTH), F.lit(HEIGHT)).alias("resolution"),
        F.array((cx - 960) * z / 1000, (cy - 540) * z / 1000, z).alias("position"),
        F.array(one, zero, zero, zero).alias("rotation_quaternion"),
        F.array(F.array(F.lit(1000.0), zero, F.lit(960.0)), F.array(zero, F.lit(1000.0), F.lit(540.0)), F.array(zero, zero, one)).alias("k_matrix"),
        F.lit(100.0).alias("tag_size_mm"), F.lit("none").alias("distortion_model"), F.array(zero).alias("distortion_coeffs"),
    )


#: The same rows in SQL, with corners as columns x1 .. y4.
SQL = """det0 AS (
    SELECT event_id AS seq, 'scene_' || lpad(CAST(user_id AS VARCHAR), 4, '0') || '_cam_' || lpad(CAST(event_id % 4 AS VARCHAR), 4, '0') AS image_id,
        event_id % 30 AS tag_id, CASE event_id % 3 WHEN 0 THEN 'tag36h11' WHEN 1 THEN 'tag16h5' ELSE 'DICT_4X4_50' END AS tag_family,
        CASE WHEN event_id % 50 = 0 THEN 'BOARD' ELSE 'TAG' END AS record_type,
        CAST((event_id * 7919) % 1920 AS DOUBLE) AS cx, CAST((event_id * 104729) % 1080 AS DOUBLE) AS cy, CAST(10 + (event_id * 31) % 90 AS DOUBLE) AS h,
        (0.5 + value / 50) * CASE WHEN event_id % 4999 = 0 THEN -1.0 ELSE 1.0 END AS distance,
        CAST((event_id * 13) % 90 AS DOUBLE) AS angle_of_incidence, (event_id % 20) / 40.0 AS occlusion_ratio, 100 + value AS lighting_intensity, user_id
    FROM events
), det AS (
    SELECT *,
        CASE WHEN seq % 89 = 0 THEN cx + h ELSE cx - h END AS x1, CASE WHEN seq % 89 = 0 THEN cy + h ELSE cy - h END AS y1,
        CASE WHEN seq % 89 = 0 OR seq % 97 = 0 THEN cx - h ELSE cx + h END AS x2, CASE WHEN seq % 89 = 0 OR seq % 97 = 0 THEN cy + h ELSE cy - h END AS y2,
        CASE WHEN seq % 89 = 0 THEN cx - h ELSE cx + h END AS x3, CASE WHEN seq % 89 = 0 THEN cy - h ELSE cy + h END AS y3,
        CASE WHEN seq % 89 = 0 OR seq % 97 = 0 THEN cx + h ELSE cx - h END AS x4, CASE WHEN seq % 89 = 0 OR seq % 97 = 0 THEN cy - h ELSE cy + h END AS y4
    FROM det0
)"""
