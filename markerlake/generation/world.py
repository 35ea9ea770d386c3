"""Worlds of scenes: lights, suns, background and texture, from a job's settings and a scene's seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markerlake.functions.geometry import let
from markerlake.generation import draws

TURN = 6.283185307179586
SUN_DISTANCE = 10.0
WIDE_RATIO = 10.0  # of scales, from which they are drawn by their logarithm


def light(kind: str, at: list[Column], intensity: Column, radius: Column, rotation: list[Column]) -> Column:
    zero = [F.lit(0.0)] * 3
    return F.struct(
        F.lit(kind).alias("type"), F.array(*at).alias("location"), intensity.cast("double").alias("intensity"), radius.cast("double").alias("radius"),
        F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("color"), F.array(*(rotation or zero)).alias("rotation_euler"),
    )


def sun(x: Column) -> Column:
    """A directional light far out, turned towards the origin; angles in radians."""
    a, e = x["azimuth"], x["elevation"]
    at = [SUN_DISTANCE * F.cos(e) * F.cos(a), SUN_DISTANCE * F.cos(e) * F.sin(a), SUN_DISTANCE * F.sin(e)]
    return light("SUN", at, x["intensity"], F.lit(0.0), [TURN / 4 - e, F.lit(0.0), TURN / 4 + a])


def lights(job: Column, seed: Column) -> Column:
    """Point lights on shells around the scene, then the job's suns.

    Three lights of linear intensity are drawn one by one and share their sum in thirds. Any other number is drawn first,
    then one intensity for all, split by exponential weights.
    """
    low, high = job["intensity"][0], job["intensity"][1]
    plain = (job["lights"][0] == 3) & (job["lights"][1] == 3) & ~job["intensity_log"]
    root = draws.seed(seed, "lighting_root")
    n = F.when(plain, 3).otherwise(draws.integer(root, "count", job["lights"][0], job["lights"][1]))
    floor = F.greatest(F.lit(1e-3), low)
    total = F.when(job["intensity_log"], draws.log_uniform(root, "total", floor, F.greatest(floor + 1e-3, high))).otherwise(draws.uniform(root, "total", low, high))
    each = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    weights = F.transform(each, lambda i: draws.exponential(root, "weight", i))

    def one(i: Column, s: Column, shared: Column) -> Column:
        theta, phi, r = draws.uniform(s, "theta", 0.0, TURN), draws.uniform(s, "phi", 0.2, 0.8) * (TURN / 4), draws.uniform(s, "radius", 2.0, 5.0)
        at = [r * F.sin(phi) * F.cos(theta), r * F.sin(phi) * F.sin(theta), r * F.cos(phi)]
        own = draws.uniform(s, "intensity", low, high) / 3
        part = shared["total"] * F.get(shared["weights"], i) / F.aggregate(shared["weights"], F.lit(0.0), lambda a, b: a + b)
        return light("POINT", at, F.when(plain, own).when(F.size(shared["weights"]) == 1, shared["total"]).otherwise(part), draws.uniform(s, "size", job["light_radius"][0], job["light_radius"][1]), [])

    points = let(F.struct(total.alias("total"), weights.alias("weights"), each.alias("each")), lambda shared: F.transform(shared["each"], lambda i: let(draws.seed(seed, "light", i), lambda s: one(i, s, shared))))
    return F.concat(points, F.transform(job["suns"], sun))


def world(job: Column, scene_seed: Column) -> Column:
    """struct(background_hdri, lights, texture_path, texture_scale, texture_rotation)."""
    seed = draws.seed(scene_seed, "world")
    textured = F.size(job["textures"]) > 0
    low, high = job["texture_scale"][0], job["texture_scale"][1]
    scale = F.when(high / low > WIDE_RATIO, draws.log_uniform(seed, "scale", low, high)).otherwise(draws.uniform(seed, "scale", low, high))
    rotation = F.when(textured & job["texture_rotation"], draws.uniform(seed, "rotation", 0.0, TURN)).otherwise(0.0)
    return F.struct(
        job["hdri"].alias("background_hdri"), lights(job, seed).alias("lights"), draws.choice(seed, "texture", job["textures"]).alias("texture_path"),
        F.when(textured, scale).otherwise(1.0).alias("texture_scale"), rotation.alias("texture_rotation"),
    )
