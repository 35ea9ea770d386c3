"""Generated scenes: the same rows however they are dealt, poses against numpy, rejection, and settings' edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerlake.generation import cameras, compiler, jobs
from markerlake.operators import annotate

JOBS = "job_id string, num_scenes long, tags array<int>, flying boolean, samples int, sampling_mode string, distortion_model string, distortion_coeffs array<double>"


@pytest.fixture(scope="module")
def some(spark):
    rows = [("a", 3, [1, 4], False, 2, "random", "none", None), ("b", 2, [0, 0], False, 1, "random", "none", None), ("c", 3, [2, 2], False, 1, "distance", "brown_conrady", [0.1, -0.02, 0.001, 0.002, 0.0]), ("d", 0, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, JOBS)


@pytest.fixture(scope="module")
def made(some):
    return compiler.plain(some.repartition(1)).orderBy("job_id", "scene_id").collect()


def test_rows_do_not_depend_on_the_dealing(some, made):
    assert compiler.plain(some.repartition(7)).orderBy("job_id", "scene_id").collect() == made
    assert [(r["job_id"], r["scene_id"]) for r in made] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2)]
    assert {len(r["cameras"]) for r in made if r["job_id"] == "a"} == {2} and all(r["objects"] == [] for r in made if r["job_id"] == "b")


def projected(camera, point):
    m = np.array(camera["transform_matrix"])
    x, y, z = np.diag([1, -1, -1]) @ m[:3, :3].T @ (np.array(point) - m[:3, 3])
    x, y = x / z, y / z
    c = list(camera["intrinsics"]["distortion_coeffs"]) + [0.0] * 5
    if any(c):
        k1, k2, p1, p2, k3 = c[:5]
        r2 = x * x + y * y
        s = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
        x, y = x * s + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * s + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    k = np.array(camera["intrinsics"]["k_matrix"])
    return k[0, 0] * x + k[0, 2], k[1, 1] * y + k[1, 2], z


def test_cameras_see_a_marker_whole_and_records_agree(spark, some, made):
    records = {}
    rows = compiler.plain(some).withColumn("scene_id", F.xxhash64("job_id", "scene_id"))
    key = {r["s"]: (r["job_id"], r["scene_id"]) for r in compiler.plain(some).select(F.xxhash64("job_id", "scene_id").alias("s"), "job_id", "scene_id").collect()}
    for r in annotate.detections(rows).collect():
        records[(*key[r["scene_id"]], r["camera"], r["place"])] = r
    for scene in made:
        for n, camera in enumerate(scene["cameras"]):
            m = np.array(camera["transform_matrix"])
            assert np.allclose(m[:3, :3].T @ m[:3, :3], np.eye(3), atol=1e-9) and math.isclose(np.linalg.det(m[:3, :3]), 1, abs_tol=1e-9)
            whole = False
            for place, o in enumerate(scene["objects"]):
                h = o["properties"]["tag_size"] / 2
                corners = [projected(camera, np.array(o["location"]) + [sx * h, sy * h, 0]) for sx, sy in ((-1, 1), (1, 1), (1, -1), (-1, -1))]
                whole |= all(z > 0 and 0 <= u <= 640 and 0 <= v <= 480 for u, v, z in corners)
                found = records[scene["job_id"], scene["scene_id"], n, place]
                if all(z > 0 for _, _, z in corners):
                    assert np.allclose(found["corners"], [(u, v) for u, v, _ in corners], atol=1e-6)
                assert math.isclose(found["distance"], np.linalg.norm(m[:3, 3] - np.array(o["location"])), rel_tol=1e-9)
                assert found["tag_size_mm"] == 100.0 and not found["is_mirrored"]
            assert whole or not scene["objects"]
    far = [np.linalg.norm(np.array(r["cameras"][0]["transform_matrix"])[:3, 3]) for r in made if r["job_id"] == "c"]
    assert np.allclose(far, [0.5, 1.25, 2.0])  # a sweep of distances about the origin


def test_scenes_are_drawn_again_until_they_pass(spark):
    """Nothing that is larger than the frame ever passes; four markers in flight often have one that no camera sees."""
    rows = [("never", 2, 5000.0, False, [1, 1]), ("mostly", 6, 100.0, True, [1, 1])]
    df = spark.createDataFrame(rows, "job_id string, num_scenes long, size_mm double, flying boolean, tags array<int>")
    good, lost = compiler.checked(df, attempts=6)
    assert {(r["job_id"], r["scene_id"]) for r in lost.collect()} >= {("never", 0), ("never", 1)}
    found = good.select("job_id", "scene_id", "attempt").collect()
    assert len({(r["job_id"], r["scene_id"]) for r in found}) == len(found) and all(r["job_id"] == "mostly" for r in found) and found
    assert all(1 <= len(r["messages"]) <= 3 for r in lost.collect())


def test_shards(spark):
    for total, shards in ((10, 3), (2, 5), (0, 2), (7, 7), (10_001, 2)):
        df = spark.createDataFrame([("j", total)], "job_id string, num_scenes long")
        ids = [sorted(r["scene_id"] for r in jobs.scenes(df, shard=i, shards=shards).collect()) for i in range(shards)]
        assert sorted(sum(ids, [])) == list(range(total)) and all(x == list(range(x[0], x[-1] + 1)) for x in ids if x)
        n = min(total, shards)
        assert all(len(x) == total // n for x in ids[: n - 1]) and not any(ids[n:]) if n else not any(ids)
    df = spark.createDataFrame([("j", 4)], "job_id string, num_scenes long")
    done = spark.createDataFrame([("j", 2), ("j", 2), ("k", 1)], "job_id string, scene_id long")
    assert sorted(r["scene_id"] for r in jobs.scenes(df, done).collect()) == [0, 1, 3]


def test_noise_follows_the_iso_number(spark):
    df = spark.createDataFrame([("a", 3600.0, True, 0.0, None), ("b", 100.0, True, 0.0, None), ("c", 9999.0, True, 0.5, 0.1), ("d", 3600.0, False, 0.0, None)], "job_id string, iso double, iso_coupling boolean, iso_noise double, noise_stddev double")
    got = {r["job_id"]: (r["n"], r["s"]) for r in jobs.with_defaults(df).select("job_id", *(c.alias(n) for c, n in zip(cameras.noise(F.col("job")), "ns"))).collect()}
    assert got["a"] == (0.5, pytest.approx(0.002 * 36**0.8)) and got["b"] == (0.0, pytest.approx(0.002)) and got["c"] == (0.5, 0.1) and got["d"] == (0.0, None)
