"""Generation jobs as rows: their settings with defaults, and the scenes that they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.generation import draws

#: Settings of a job: type, and what holds where a table of jobs lacks the column or has null.
SETTINGS: dict[str, tuple[str, str]] = {
    "seed": ("bigint", "42"), "num_scenes": ("bigint", "1"), "sampling_mode": ("string", "'random'"),
    "subject": ("string", "'tags'"), "tags": ("array<int>", "array(1, 5)"), "size_mm": ("double", "100.0"), "families": ("array<string>", "array('tag36h11')"),
    "spacing_bits": ("double", "2.0"), "margin_bits": ("int", "0"), "flying": ("boolean", "false"), "use_board": ("boolean", "false"), "scatter_radius": ("double", "0.5"),
    "roughness": ("array<double>", "array(0.8, 0.8)"), "specular": ("array<double>", "array(0.2, 0.2)"), "cache": ("string", "null"),
    "board": ("struct<type:string,rows:int,cols:int,marker_size:double,square_size:double,dictionary:string,quiet_zone:double>", "null"),
    "resolution": ("array<int>", "array(640, 480)"), "fov": ("double", "70.0"), "samples": ("int", "1"), "distance": ("array<double>", "array(0.5, 2.0)"),
    "elevation": ("array<double>", "array(0.3, 0.9)"), "fixed_elevation": ("double", "null"), "azimuth": ("double", "null"), "roll": ("array<double>", "array(0.0, 0.0)"),
    "ppm": ("array<double>", "null"), "min_tag_pixels": ("double", "null"), "max_tag_pixels": ("double", "null"), "eval_margin_px": ("int", "0"),
    "distortion_model": ("string", "'none'"), "distortion_coeffs": ("array<double>", "array()"), "velocity": ("array<double>", "array(0.0, 0.0)"),
    "shutter_time_ms": ("double", "0.0"), "rolling_shutter_ms": ("double", "0.0"), "fstop": ("double", "null"),
    "iso": ("double", "100.0"), "iso_coupling": ("boolean", "false"), "iso_noise": ("double", "0.0"), "noise_stddev": ("double", "null"),
    "lights": ("array<int>", "array(3, 3)"), "intensity": ("array<double>", "array(50.0, 500.0)"), "intensity_log": ("boolean", "false"), "light_radius": ("array<double>", "array(0.0, 0.0)"),
    "suns": ("array<struct<azimuth:double,elevation:double,intensity:double>>", "array()"), "hdri": ("string", "null"),
    "textures": ("array<string>", "array()"), "texture_scale": ("array<double>", "array(1.0, 1.0)"), "texture_rotation": ("boolean", "false"),
}
BLOCK = 10_000  # scenes that one row becomes at once


def with_defaults(jobs: DataFrame) -> DataFrame:
    """job_id and all settings, as one column `job`; other columns go."""
    fields = [F.coalesce(F.col(n).cast(t) if n in jobs.columns else F.lit(None).cast(t), F.expr(f"cast({d} as {t})")).alias(n) for n, (t, d) in SETTINGS.items()]
    return jobs.select(F.col("job_id").cast("string"), F.struct(*fields).alias("job"))


def shard_range(total: Column, shards: Column, shard: Column) -> tuple[Column, Column]:
    """First scene of a shard and the one after its last: equal shares, the last takes what is left, none for shards beyond
    the number of scenes."""
    n = F.least(total, shards)
    each = F.floor(total / F.greatest(n, F.lit(1)))
    start = shard * each
    return F.when(shard < n, start).otherwise(F.lit(0)), F.when(shard >= n, F.lit(0)).when(shard == n - 1, total).otherwise(start + each)


def scenes(jobs: DataFrame, done: DataFrame | None = None, shard: int | None = None, shards: int = 1) -> DataFrame:
    """job_id, job, scene_id, scene_seed of all scenes, or of one shard of each job's, without those in done (job_id, scene_id).

    A job without scenes gives none; a repeated job_id gives its scenes again.
    """
    low, high = shard_range(F.col("job.num_scenes"), F.lit(shards), F.lit(shard or 0)) if shard is not None else (F.lit(0), F.col("job.num_scenes"))
    rows = with_defaults(jobs).select("job_id", "job", low.cast("bigint").alias("low"), high.cast("bigint").alias("high")).where("low < high")
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(low, high - 1, {BLOCK}L)")))
    rows = rows.select("job_id", "job", F.explode(F.expr(f"sequence(block, least(block + {BLOCK}, high) - 1)")).alias("scene_id"))
    if done is not None:
        rows = rows.join(done.select(F.col("job_id").cast("string"), "scene_id").distinct(), ["job_id", "scene_id"], "left_anti")
    return rows.withColumn("scene_seed", draws.seed(F.col("job.seed"), "scene", F.col("scene_id")))
