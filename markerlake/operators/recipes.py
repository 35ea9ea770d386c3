"""Checks and statistics of scene recipes: rows of schema.RECIPE, one scene each, with nested objects and cameras.

What is compared lies within one scene, so nothing here is shuffled but the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import records

TOLERANCE = 0.001  # metres
STEEPEST = 80.0  # degrees
DEFAULT_SIZE = 0.1
DEFAULT_FAMILY = "tag36h11"


def tags() -> Column:
    return F.filter("objects", lambda o: o["type"] == "TAG")


def size_of(tag: Column) -> Column:
    return F.coalesce(tag["properties"]["tag_size"], F.lit(DEFAULT_SIZE))


def box_of(tag: Column) -> dict[str, Column]:
    """A marker's box on the ground, whichever way it is turned."""
    half = [size_of(tag) * tag["scale"][i] / 2 for i in range(2)]
    return {n: tag["location"][i] + sign * half[i] for i, axis in enumerate("xy") for n, sign in ((f"{axis}0", -1), (f"{axis}1", 1))}


def outside_board(tag: Column, board: Column) -> Column:
    """Whether a marker's box leaves a board's by more than the tolerance."""
    own, props = box_of(tag), board["properties"]
    side = F.coalesce(props["square_size"], F.lit(DEFAULT_SIZE))
    half = [F.coalesce(props[n], F.lit(1)) * side / 2 for n in ("cols", "rows")]
    out = F.lit(False)
    for i, axis in enumerate("xy"):
        centre = board["location"][i]
        out = out | (own[f"{axis}0"] < centre - half[i] - TOLERANCE) | (own[f"{axis}1"] > centre + half[i] + TOLERANCE)
    return out


def overlapping(a: Column, b: Column) -> Column:
    """Whether two markers lie at one height and their boxes share more than the tolerance in both directions."""
    p, q = box_of(a), box_of(b)
    both = F.abs(a["location"][2] - b["location"][2]) < TOLERANCE
    for axis in "xy":
        both = both & (p[f"{axis}0"] < q[f"{axis}1"] - TOLERANCE) & (p[f"{axis}1"] > q[f"{axis}0"] + TOLERANCE)
    return both


def matrix_of(values: Column) -> list[list[Column]]:
    return [[values[i][j] for j in range(3)] for i in range(3)]


def pose_of(tag: Column) -> tuple[list[list[Column]], tuple[Column, ...]]:
    """Rotation with scale, and place."""
    turn = g.euler_rotation(*(tag["rotation_euler"][i] for i in range(3)))
    return [[turn[i][j] * tag["scale"][j] for j in range(3)] for i in range(3)], tuple(tag["location"][i] for i in range(3))


def visible_tags(recipes: DataFrame) -> DataFrame:
    """scene_id, camera (place), tags, visible: of each camera in scenes with markers, how many markers it can use.

    A marker must face the camera, lie whole in its closed frame, be neither too small nor too large, nor too steep. Steps
    are columns of their own, so that none is expanded into the next.
    """
    rows = recipes.select("scene_id", tags().alias("tags"), "cameras").select("scene_id", "tags", F.posexplode("cameras").alias("camera", "c"))
    rows = rows.select("scene_id", "camera", "c", F.explode("tags").alias("tag"))
    tag, c = F.col("tag"), F.col("c")
    linear, at = pose_of(tag)
    entries = {f"m{i}{j}": linear[i][j] for i in range(3) for j in range(3)} | {f"t{i}": at[i] for i in range(3)} | {f"e{i}": c["transform_matrix"][i][3] for i in range(3)}
    axes, k = g.transpose(g.opencv_axes(matrix_of(c["transform_matrix"]))), matrix_of(c["intrinsics"]["k_matrix"])
    entries |= {f"a{i}{j}": axes[i][j] for i in range(3) for j in range(3)} | {f"k{i}{j}": k[i][j] for i in range(3) for j in range(3)}
    family = F.coalesce(tag["properties"]["tag_family"], F.lit(DEFAULT_FAMILY))
    width, height = c["intrinsics"]["resolution"][0], c["intrinsics"]["resolution"][1]
    least, most = (F.when(c[n] != 0, c[n]) for n in ("min_tag_pixels", "max_tag_pixels"))
    entries |= {"half": size_of(tag) / 2, "width": width, "height": height, "least": F.coalesce(least, records.tag_bits(family).cast("double")), "most": F.coalesce(most, (width * height).cast("double"))}
    keep = ["scene_id", "camera", "width", "height", "least", "most"]
    rows = rows.select("scene_id", "camera", *(v.alias(n) for n, v in entries.items()))
    col = lambda p: [[F.col(f"{p}{i}{j}") for j in range(3)] for i in range(3)]
    vec = lambda p: tuple(F.col(f"{p}{i}") for i in range(3))
    normal = g.world_normal(col("m"))
    local = {f"p{n}": g.minus(g.place(col("m"), vec("t"), (sx * F.col("half"), sy * F.col("half"), F.lit(0.0))), vec("e")) for n, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))}
    rows = rows.select(*keep, *(f"a{i}{j}" for i in range(3) for j in range(3)), *(f"k{i}{j}" for i in range(3) for j in range(3)), *(f"t{i}" for i in range(3)), *(f"e{i}" for i in range(3)), *(v.alias(f"n{i}") for i, v in enumerate(normal)), *(v[i].alias(f"{n}{i}") for n, v in local.items() for i in range(3)))
    seen = {f"q{n}": g.apply(col("a"), vec(f"p{n}")) for n in range(4)}
    rows = rows.select(*keep, *(f"k{i}{j}" for i in range(3) for j in range(3)), g.facing(vec("t"), vec("e"), vec("n")).alias("facing"), g.angle_of_incidence(vec("t"), vec("e"), vec("n")).alias("angle"), *(v[i].alias(f"{n}{i}") for n, v in seen.items() for i in range(3)))
    pixels = [g.project(vec(f"q{n}"), col("k")) for n in range(4)]
    rows = rows.select(*keep, "facing", "angle", *(p[i].alias(f"{'uv'[i]}{n}") for n, p in enumerate(pixels) for i in (0, 1)))
    points = [(F.col(f"u{n}"), F.col(f"v{n}")) for n in range(4)]
    ok = F.col("facing") & (F.col("angle") <= STEEPEST) & F.abs(g.signed_area(points)).between(F.col("least"), F.col("most"))
    for u, v in points:
        ok = ok & u.between(0, F.col("width")) & v.between(0, F.col("height"))
    return rows.groupBy("scene_id", "camera").agg(F.count("*").alias("tags"), F.count_if(F.coalesce(ok, F.lit(False))).alias("visible"))


def findings(recipes: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """scene_id, severity, check, what: a row for each fault.

    Errors: no_cameras, resolution (of a camera), asset (a file that isn't in `assets`, column path). Warnings: overlap (of
    two markers), outside_board (of the first board), unseen (a camera without usable markers), asset_pending (a missing
    file of a cache).
    """

    def rows(severity: str, check: str, what: Column) -> DataFrame:
        return recipes.select("scene_id", F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.explode(what).alias("what"))

    board = F.get(F.filter("objects", lambda o: o["type"] == "BOARD"), 0)
    marked = recipes.select("scene_id", tags().alias("tags"), board.alias("board"))
    each = marked.select("scene_id", "tags", "board", F.posexplode("tags").alias("i", "a"))
    off = each.where("board is not null").where(outside_board(F.col("a"), F.col("board"))).select("scene_id", F.lit("warning"), F.lit("outside_board"), "a.name")
    both = each.select("scene_id", "i", "a", F.posexplode("tags").alias("j", "b")).where("i < j").where(overlapping(F.col("a"), F.col("b")))
    pairs = both.select("scene_id", F.lit("warning"), F.lit("overlap"), F.concat_ws("-", "a.name", "b.name"))
    places = F.filter(F.transform("cameras", lambda c, i: F.when((c["intrinsics"]["resolution"][0] <= 0) | (c["intrinsics"]["resolution"][1] <= 0), i.cast("string"))), lambda x: x.isNotNull())
    none = F.when(F.coalesce(F.size("cameras"), F.lit(0)) <= 0, F.array(F.lit("")))
    out = rows("error", "no_cameras", none).union(rows("error", "resolution", places)).union(off).union(pairs)
    unseen = visible_tags(recipes).where("visible = 0")
    out = out.union(unseen.select("scene_id", F.lit("warning"), F.lit("unseen"), F.col("camera").cast("string")))
    if assets is not None:
        named = F.concat(F.transform(F.array("world.background_hdri", "world.texture_path"), lambda p: F.struct(p.alias("path"), F.lit(False).alias("late"))), F.transform(tags(), lambda t: F.struct(t["texture_path"].alias("path"), F.contains(t["texture_path"], F.lit("cache")).alias("late"))))
        wanted = recipes.select("scene_id", F.explode(named).alias("a")).select("scene_id", "a.*").where(F.length("path") > 0).join(assets.select("path").distinct(), "path", "left_anti")
        out = out.union(wanted.select("scene_id", F.when(F.col("late"), "warning").otherwise("error"), F.when(F.col("late"), "asset_pending").otherwise("asset"), "path"))
    return out


def validity(recipes: DataFrame, found: DataFrame) -> DataFrame:
    """scene_id, valid, errors, warnings of all scenes, from their findings."""
    counts = found.groupBy("scene_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = recipes.select("scene_id").join(counts, "scene_id", "left").na.fill(0, ["errors", "warnings"])
    return rows.select("scene_id", (F.col("errors") == 0).alias("valid"), "errors", "warnings")


def measures(recipes: DataFrame) -> DataFrame:
    """scene_id, intensity (sum of its lights), tags, cameras, and of each camera towards the first marker: distance, angle."""
    first = F.get(tags(), 0)
    linear, at = pose_of(F.col("first"))
    eye = tuple(F.col("c")["transform_matrix"][i][3] for i in range(3))
    intensity = F.aggregate("world.lights", F.lit(0.0), lambda a, x: a + x["intensity"])
    rows = recipes.select("scene_id", intensity.alias("intensity"), F.size(tags()).alias("tags"), F.size("cameras").alias("cameras"), first.alias("first"), F.posexplode_outer("cameras").alias("camera", "c"))
    known = F.col("first").isNotNull() & F.col("c").isNotNull()
    return rows.select("scene_id", "intensity", "tags", "cameras", "camera", F.when(known, g.distance(at, eye)).alias("distance"), F.when(known, g.angle_of_incidence(at, eye, g.world_normal(linear))).alias("angle"))


def totals(measured: DataFrame) -> DataFrame:
    """One row of population statistics over scenes (intensity, tags) and over cameras (distance, angle)."""
    scenes = F.coalesce("camera", F.lit(0)) == 0
    out = [F.count_if(scenes).alias("scenes"), F.count("camera").alias("cameras"), F.sum(F.when(scenes, F.col("tags"))).alias("tags")]
    for name in ("distance", "angle", "intensity", "tags"):
        value = F.col(name) if name in ("distance", "angle") else F.when(scenes, F.col(name))
        out += [F.coalesce(f(value.cast("double")), F.lit(0.0)).alias(f"{name}_{s}") for f, s in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_pop, "std"))]
    return measured.agg(*out)
