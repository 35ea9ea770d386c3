"""Recipes of scenes: worlds, objects and cameras put together, and drawn again until they pass the checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerlake.generation import cameras, draws, jobs, subjects, world
from markerlake.operators import recipes
from markerlake.sources.folders import kept, new_folder, spread

ATTEMPTS = 50


def built(scenes: DataFrame) -> DataFrame:
    """job_id, attempt, scene_id, random_seed, world, objects, cameras of scenes (job_id, job, scene_id, attempt, seed).

    Cameras are null where none was found, and empty where the job asks for none.
    """
    rows = kept(spread(scenes).select("job_id", "job", "scene_id", "attempt", "seed", subjects.objects(F.col("job"), F.col("seed")).alias("objects")), "objects")
    seen = cameras.sample(rows)
    rows = rows.join(seen, ["job_id", "scene_id", "attempt"], "left")
    none = F.array().cast(seen.schema["cameras"].dataType)
    return rows.select("job_id", "attempt", "scene_id", F.col("seed").alias("random_seed"), world.world(F.col("job"), F.col("seed")).alias("world"), "objects", F.when(F.col("job.samples") > 0, F.col("cameras")).otherwise(none).alias("cameras"))


def plain(jobs_: DataFrame, done: DataFrame | None = None, shard: int | None = None, shards: int = 1) -> DataFrame:
    """The first recipe of each scene, unchecked: each scene under the seed that its job and its number give it."""
    return built(jobs.scenes(jobs_, done, shard, shards).select("job_id", "job", "scene_id", F.lit(0).alias("attempt"), F.col("scene_seed").alias("seed")))


def faults(found: DataFrame, assets: DataFrame | None) -> DataFrame:
    """job_id, scene_id, attempt, messages of recipes that aren't to be kept: all findings but of files still to come."""
    key = F.concat_ws("\x01", "job_id", F.col("scene_id").cast("string"), F.col("attempt").cast("string"))
    keyed = found.withColumn("scene", key)
    of = recipes.findings(keyed.where("cameras is not null").drop("scene_id").withColumnRenamed("scene", "scene_id"), assets).where("check <> 'asset_pending'")
    lost = keyed.where("cameras is null").select(F.col("scene").alias("scene_id"), F.lit("error").alias("severity"), F.lit("no_pose").alias("check"), F.lit("").alias("what"))
    each = of.union(lost).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "severity", "check", "what"))).alias("messages"))
    part = F.split("scene_id", "\x01")
    return each.select(part[0].alias("job_id"), part[1].cast("bigint").alias("scene_id"), part[2].cast("int").alias("attempt"), "messages")


def checked(jobs_: DataFrame, assets: DataFrame | None = None, attempts: int = ATTEMPTS, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Recipes that pass the checks, each scene's first of at most `attempts`; and job_id, scene_id, messages of scenes that
    never pass: the first three of their last attempt.

    A round builds and checks the scenes that are still open, and writes what passes; so a round's work is that of the
    scenes it draws again, and a lost task's is its own.
    """
    spark = jobs_.sparkSession
    folder = new_folder(spark, "recipes")
    jobs.scenes(jobs_, done).write.parquet(f"{folder}/scenes")
    todo = spark.read.parquet(f"{folder}/scenes")
    good, wrong = [], None
    for attempt in range(attempts):
        at = F.lit(attempt)
        built(todo.select("job_id", "job", "scene_id", at.alias("attempt"), draws.seed(F.col("scene_seed"), "attempt", at).alias("seed"))).write.parquet(f"{folder}/built-{attempt}")
        made = spark.read.parquet(f"{folder}/built-{attempt}")
        faults(made, assets).write.parquet(f"{folder}/faults-{attempt}")
        wrong = spark.read.parquet(f"{folder}/faults-{attempt}")
        good.append(made.join(wrong, ["job_id", "scene_id", "attempt"], "left_anti"))
        todo = todo.join(wrong.select("job_id", "scene_id"), ["job_id", "scene_id"], "left_semi")
        if wrong.isEmpty():
            break
    return reduce(DataFrame.unionByName, good), wrong.select("job_id", "scene_id", F.slice("messages", 1, 3).alias("messages"))
