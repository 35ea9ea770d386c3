"""Cameras of scenes: poses drawn until one sees its target whole, intrinsics, noise and motion.

A pose is a function of a seed and the number of the try, so all tries of a camera are rows that are tested side by side;
the first good one is taken. A second round makes the rest of the tries only for cameras that the first left without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import records
from markerlake.functions.frames import hold, mat, vec
from markerlake.generation import draws
from markerlake.generation.subjects import marker_share
from markerlake.sources.folders import kept

TURN = 6.283185307179586
TRIES, FIRST = 50, 4
LEAST_FACING = 0.1
#: How sensor noise follows from the ISO number.
BASE_SIGMA, EXPONENT, GAIN_FLOOR, GAIN_CEILING = 0.002, 0.8, 800.0, 6400.0
KEYS = ["job_id", "scene_id", "attempt", "camera"]


def intrinsics(job: Column) -> tuple[Column, Column, Column, list[list[Column]]]:
    """Width, height, focal length and matrix."""
    width, height = job["resolution"][0].cast("double"), job["resolution"][1].cast("double")
    f = g.focal_from_fov(width, job["fov"], height, job["distortion_model"])
    zero, one = F.lit(0.0), F.lit(1.0)
    return width, height, f, [[f, zero, width / 2], [zero, f, height / 2], [zero, zero, one]]


def targets(scenes: DataFrame) -> DataFrame:
    """A row for each camera of each scene, with its target and what is fixed before its first try."""
    job, o = F.col("job"), F.col("target")
    rows = scenes.withColumn("camera_seed", draws.seed(F.col("seed"), "camera")).withColumn("camera", F.explode(F.when(job["samples"] > 0, F.sequence(F.lit(0), job["samples"] - 1))))
    tags = F.filter("objects", lambda x: x["type"] == "TAG")
    rows = rows.withColumn("tags", tags).withColumn("target", F.when(F.size("tags") > 0, draws.choice(F.col("camera_seed"), "target", F.col("tags"), F.col("camera"))).otherwise(F.get("objects", F.lit(0)))).drop("tags")
    t = F.when(job["num_scenes"] > 1, F.col("scene_id") / (job["num_scenes"] - 1))
    swept = lambda name: job[name][0] + t * (job[name][1] - job[name][0])
    family = F.coalesce(o["properties"]["tag_family"], F.lit("tag36h11"))
    size = F.coalesce(o["properties"]["tag_size"], F.lit(0.1))
    shown = F.when(o["type"] == "TAG", size * marker_share(family, F.coalesce(o["properties"]["margin_bits"], F.lit(0)))).otherwise(F.coalesce(o["board"]["marker_size"], size))
    plain_focal = g.focal_from_fov(job["resolution"][0].cast("double"), job["fov"])
    ppm = draws.uniform(F.col("camera_seed"), "ppm", job["ppm"][0], job["ppm"][1], F.col("camera"))
    by_ppm = F.greatest(job["distance"][0], F.least(job["distance"][1], g.distance_for_ppm(plain_focal, shown, ppm, records.tag_grid(family))))
    random = job["sampling_mode"] == "random"
    # what must lie in the frame: a marker's plane, a backing board's cells, a calibration board's plane of size 1 under its scale
    cells = lambda n: o["properties"][n] * o["properties"]["square_size"] / 2
    half = [F.when(o["board"].isNotNull(), 0.5).when(o["type"] == "BOARD", cells(n)).otherwise(size / 2) for n in ("cols", "rows")]
    largest = F.when(o["board"].isNotNull(), F.greatest(o["board"]["cols"], o["board"]["rows"]) * o["board"]["marker_size"]).otherwise(size)
    return rows.withColumns({
        "given_distance": F.when(random & job["ppm"].isNotNull() & o.isNotNull(), by_ppm).when(job["sampling_mode"] == "distance", swept("distance")),
        "given_elevation": F.coalesce(F.when(job["sampling_mode"] == "angle", swept("elevation")), job["fixed_elevation"]),
        "half_x": half[0], "half_y": half[1], "largest": largest, "family": family, "focal": plain_focal, "aimed": random & o.isNotNull(),
    })


def poses(rows: DataFrame) -> DataFrame:
    """The pose of each row's `try`: e0 .. e2 and r00 .. r22, a camera that looks along its -z."""
    job, o = F.col("job"), F.col("target")
    seed, n = F.col("camera_seed"), F.col("camera") * 1000 + F.col("try")
    d = lambda name, low, high: draws.uniform(seed, name, low, high, n)
    rows = rows.withColumns({
        "far": F.coalesce("given_distance", d("distance", job["distance"][0], job["distance"][1])),
        "high": F.coalesce("given_elevation", d("elevation", job["elevation"][0], job["elevation"][1])),
        "turn": F.coalesce(job["azimuth"], d("azimuth", 0.0, TURN)),
        "roll": F.when(F.abs(job["roll"][1] - job["roll"][0]) > 1e-6, F.radians(d("roll", job["roll"][0], job["roll"][1]))).otherwise(0.0),
    })
    width, height = job["resolution"][0].cast("double"), job["resolution"][1].cast("double")
    margin = F.col("focal") * F.col("largest") / F.col("far")
    fits = F.col("aimed") & (margin * 2 < F.least(width, height))
    rows = rows.withColumns({"u": F.when(fits, d("u", margin, width - margin)), "v": F.when(fits, d("v", margin, height - margin))})
    look = [F.when(F.col("aimed"), o["location"][i]).otherwise(0.0) for i in range(3)]
    sine = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("high") * F.col("high")))
    way = (F.col("far") * sine * F.cos("turn"), F.col("far") * sine * F.sin("turn"), F.col("far") * F.col("high"))
    rows = hold(rows, z=[w / F.col("far") for w in way], e=[a + b for a, b in zip(look, way, strict=True)])
    # upright, with its own z from the target to the camera; near the vertical, y serves as up
    zero, one = F.lit(0.0), F.lit(1.0)
    near = F.abs(F.col("z2")) > 0.999
    rows = hold(rows, x=[F.when(near, p).otherwise(q) for p, q in zip(g.cross((zero, one, zero), vec("z")), g.cross((zero, zero, one), vec("z")), strict=True)])
    rows = hold(rows, x=g.unit(vec("x")))
    rows = hold(rows, s=g.transpose([vec("x"), g.cross(vec("z"), vec("x")), vec("z")]))
    # turned so that the target lies at (u, v): the rotation that takes the view's middle to that ray, undone
    _, _, f, k = intrinsics(job)
    rows = hold(rows, y=((F.col("u") - k[0][2]) / f, -(F.col("v") - k[1][2]) / f, F.lit(-1.0)))
    rows = hold(rows, y=g.unit(vec("y")))
    ray = vec("y")
    v, w = (ray[1], -ray[0], zero), 1 / (1 - ray[2])
    skew = [[zero, zero, v[1]], [zero, zero, -v[0]], [-v[1], v[0], zero]]
    rows = hold(rows, a=[[(-ray[2] if i == j else zero) + skew[i][j] + v[i] * v[j] * w for j in range(3)] for i in range(3)])
    aside = g.multiply(mat("s"), g.transpose(mat("a")))
    rows = hold(rows, b=[[F.when(F.col("u").isNull(), F.col(f"s{i}{j}")).otherwise(aside[i][j]) for j in range(3)] for i in range(3)])
    c, s = F.cos("roll"), F.sin("roll")
    return hold(rows, r=g.multiply(mat("b"), [[c, -s, zero], [s, c, zero], [zero, zero, one]]))


def tested(rows: DataFrame) -> DataFrame:
    """Rows with `ok`, whether their pose is good: the target faces the camera, lies whole in the closed frame, and has an
    allowed area. A scene without objects takes any pose.

    A column and no filter, as the optimizer writes a filter out in terms of what lies beneath all these steps.
    """
    job, o = F.col("job"), F.col("target")
    turn = g.euler_rotation(*(F.coalesce(o["rotation_euler"][i], F.lit(0.0)) for i in range(3)))
    scale = [F.coalesce(o["scale"][j], F.lit(1.0)) for j in range(3)]
    rows = hold(rows, m=[[turn[i][j] * scale[j] for j in range(3)] for i in range(3)], t=[F.coalesce(o["location"][i], F.lit(0.0)) for i in range(3)])
    rows = hold(rows, c=g.transpose(g.opencv_axes(mat("r"))))
    corners = {f"p{n}": g.apply(mat("c"), g.minus(g.place(mat("m"), vec("t"), (sx * F.col("half_x"), sy * F.col("half_y"), F.lit(0.0))), vec("e"))) for n, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))}
    rows = hold(rows, **corners)
    width, height, _, k = intrinsics(job)
    rows = hold(rows, **{f"q{n}": [F.when(F.col(f"p{n}2") > g.NEAR, F.col(f"p{n}{i}") / F.col(f"p{n}2")) for i in range(2)] for n in range(4)})
    rows = rows.withColumns({f"d{n}": g.distort_point(F.col(f"q{n}0"), F.col(f"q{n}1"), job["distortion_model"], job["distortion_coeffs"]) for n in range(4)})
    rows = hold(rows, **{f"q{n}": [F.col(f"d{n}")[i] * k[i][i] + k[i][2] for i in range(2)] for n in range(4)})
    ok = g.facing(vec("t"), vec("e"), tuple(F.col(f"m{i}2") for i in range(3)), LEAST_FACING)
    for n in range(4):
        ok = ok & F.col(f"q{n}0").between(0, width) & F.col(f"q{n}1").between(0, height)
    area = F.abs(g.signed_area([(F.col(f"q{n}0"), F.col(f"q{n}1")) for n in range(4)]))
    least, most = (F.when(job[n] != 0, job[n]) for n in ("min_tag_pixels", "max_tag_pixels"))
    allowed = area.between(F.coalesce(least, records.tag_bits(F.col("family")).cast("double")), F.coalesce(most, width * height))
    ok = ok & (least.isNull() & most.isNull() | allowed)
    return rows.withColumn("ok", o.isNull() | F.coalesce(ok, F.lit(False)))


def first_good(cameras: DataFrame, low: int, high: int) -> DataFrame:
    """KEYS and the first good try of cameras that have one from low to high."""
    rows = cameras.withColumn("try", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return tested(poses(rows)).groupBy(*KEYS).agg(F.min(F.when(F.col("ok"), F.col("try"))).alias("try")).where("try is not null")


def noise(job: Column) -> tuple[Column, Column]:
    """ISO noise and the deviation of sensor noise: what the job sets, else coupled to its ISO number if it asks so."""
    coupled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (job["iso"] - GAIN_FLOOR) / (GAIN_CEILING - GAIN_FLOOR)))
    return F.when(job["iso_coupling"] & (job["iso_noise"] == 0.0), coupled).otherwise(job["iso_noise"]), F.coalesce(job["noise_stddev"], F.when(job["iso_coupling"], BASE_SIGMA * F.pow(job["iso"] / 100, F.lit(EXPONENT))))


def recipe(rows: DataFrame) -> DataFrame:
    """KEYS and c: the camera's recipe, null without a good try."""
    job, seed, n = F.col("job"), F.col("camera_seed"), F.col("camera")
    width, height, f, k = intrinsics(job)
    active = g.active(job["distortion_coeffs"])
    wide = job["distortion_model"] == "kannala_brandt"
    # edges are sampled once a job: all its cameras share the lens
    lenses = rows.select("job_id", F.col("job.resolution").alias("size"), F.col("job.fov").alias("fov"), "job").where(active).dropDuplicates(["job_id"])
    lenses = lenses.select("job_id", "job", g.edge_rays(k, width, height, job["distortion_model"], job["distortion_coeffs"]).alias("rays"))
    lenses = lenses.select("job_id", F.when(~wide, g.overscan(F.col("rays"), k, width, height)).alias("over"), F.when(wide, g.spherical_overscan(F.col("rays"), k)).alias("sphere"))
    rows = rows.join(lenses, "job_id", "left")
    side = [draws.normal(seed, f"way_{a}", n) for a in "xyz"]
    length = F.sqrt(sum((x * x for x in side[1:]), side[0] * side[0]))
    speed = F.greatest(F.lit(0.0), job["velocity"][0] + job["velocity"][1] * draws.normal(seed, "speed", n))
    moving = (job["velocity"][0] > 0) | (job["velocity"][1] > 0)
    iso_noise, stddev = noise(job)
    matrix = F.array(*(F.array(*row) for row in k))
    over = F.col("over")
    linear = F.when(over.isNotNull(), F.array(F.array(f, F.lit(0.0), over["width"] / 2), F.array(F.lit(0.0), f, over["height"] / 2), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    inner = F.struct(
        job["resolution"].alias("resolution"), matrix.alias("k_matrix"), job["fov"].alias("fov"), F.when(active, job["distortion_model"]).otherwise("none").alias("distortion_model"),
        F.when(active, job["distortion_coeffs"]).otherwise(F.array().cast("array<double>")).alias("distortion_coeffs"), linear.alias("k_matrix_overscan"),
        F.when(over.isNotNull(), F.array(over["width"], over["height"])).alias("resolution_overscan"), F.col("sphere.fov").alias("fov_spherical"),
        F.when(F.col("sphere").isNotNull(), F.array("sphere.size", "sphere.size")).alias("resolution_spherical"), job["eval_margin_px"].alias("eval_margin_px"),
    )
    pose = F.array(*(F.array(*(F.col(f"r{i}{j}") for j in range(3)), F.col(f"e{i}")) for i in range(3)), F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))
    camera = F.struct(
        pose.alias("transform_matrix"), inner.alias("intrinsics"), job["min_tag_pixels"].alias("min_tag_pixels"), job["max_tag_pixels"].alias("max_tag_pixels"),
        F.struct(F.when(moving, F.array(*(x / length * speed for x in side))).alias("velocity"), job["shutter_time_ms"].alias("shutter_time_ms"), job["rolling_shutter_ms"].alias("rolling_shutter_ms")).alias("sensor_dynamics"),
        job["fstop"].alias("fstop"), iso_noise.alias("iso_noise"), F.when(stddev.isNotNull(), F.struct(stddev.alias("stddev"), draws.seed(seed, "noise", n).alias("seed"))).alias("sensor_noise"), F.col("try").alias("tries"),
    )
    return rows.select(*KEYS, F.when(F.col("try").isNotNull(), camera).alias("c"))


def sample(scenes: DataFrame) -> DataFrame:
    """job_id, scene_id, attempt, cameras of scenes (job_id, job, scene_id, attempt, seed, objects): null where a camera
    finds no pose in TRIES tries."""
    cameras = kept(targets(scenes), "cameras")
    found = kept(first_good(cameras, 0, FIRST - 1), "poses")
    rest = kept(first_good(cameras.join(found.select(*KEYS), KEYS, "left_anti"), FIRST, TRIES - 1), "poses")
    chosen = cameras.join(found.union(rest), KEYS, "left")
    each = recipe(poses(chosen)).groupBy("job_id", "scene_id", "attempt").agg(F.array_sort(F.collect_list(F.struct("camera", "c"))).alias("all"), F.bool_and(F.col("c").isNotNull()).alias("whole"))
    return each.select("job_id", "scene_id", "attempt", F.when(F.col("whole"), F.transform("all", lambda x: x["c"])).alias("cameras"))
