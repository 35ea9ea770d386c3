"""Detection records from recipes of scenes: what each camera sees of each object, by geometry alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import records
from markerlake.functions.frames import hold, mat, vec, with_camera_pose, with_rigid

SQUARE = 0.01  # by which a marker's sides, or a board's scales, may differ
FACING = 0.15


def parts(recipes: DataFrame) -> DataFrame:
    """image_id and a row for each thing that a camera may see: single markers, a board's markers, boards themselves.

    local: its points in the object's own metres; centre: where its own centre lies there.
    """
    rows = recipes.select("scene_id", "objects", F.posexplode("cameras").alias("camera", "c")).select("scene_id", "camera", "c", F.posexplode("objects").alias("place", "o"))
    o, p = F.col("o"), F.col("o.properties")
    turn = g.euler_rotation(*(o["rotation_euler"][i] for i in range(3)))
    rows = rows.withColumn("image_id", records.image_id(F.col("scene_id"), F.col("camera")))
    rows = hold(rows, w=[[turn[i][j] * o["scale"][j] for j in range(3)] for i in range(3)], t=[o["location"][i] for i in range(3)], n=[F.abs(o["scale"][j]) for j in range(3)])
    scaled = lambda points, s: F.transform(points, lambda q: F.array(*(q[i] * s[i] for i in range(3))))
    board, one = o["board"], [F.lit(1.0)] * 3
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    four = F.transform(F.sequence(F.lit(0), (F.size(o["keypoints_3d"]) / 4).cast("int") - 1), lambda i: F.slice(o["keypoints_3d"], i * 4 + 1, F.lit(4)))

    def thing(kind: str, tag: Column, family: Column, local: Column, keys: Column, centre: Column, size: Column, definition: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"), tag.cast("bigint").alias("tag_id"), family.alias("tag_family"), local.alias("local"), keys.cast("array<array<double>>").alias("keys"),
            centre.alias("centre"), size.alias("tag_size_mm"), definition.cast(BOARD_DEFINITION).alias("board_definition"),
        )

    none = F.lit(None)
    family = F.coalesce(p["tag_family"], F.lit("unknown"))
    grid = records.tag_grid(family)
    share = grid / (grid + 2 * F.coalesce(p["margin_bits"], F.lit(0)))
    single = thing("TAG", F.coalesce(p["tag_id"], F.lit(0)), family, scaled(o["keypoints_3d"], vec("h")), none, zero, F.col("h0") * 2000 * share, none)
    middle = lambda q: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (q[0][i] + q[2][i]) / 2)
    each = F.transform(four, lambda q, i: thing("TAG", i, board["dictionary"], q, none, middle(q), board["marker_size"] * 1000, none))
    keys = F.coalesce(o["calibration_points_3d"], F.array().cast("array<array<double>>"))
    definition = F.struct(
        board["type"], board["rows"], board["cols"], F.round(board["square_size"] * 1000, 4), F.round(board["marker_size"] * 1000, 4), board["dictionary"], F.size(keys),
        F.when(board["type"] == "aprilgrid", board["square_size"] / board["marker_size"] - 1),
    )
    whole = thing("BOARD", F.lit(-1), F.concat(F.lit("board_"), board["type"]), F.array(zero), keys, zero, board["cols"] * board["square_size"] * 1000, definition)
    # a marker's plane spans -1 to 1: half its printed side, or its scale where that isn't known
    side = F.coalesce(p["tag_size"] / 2, F.lit(1.0))
    rows = hold(rows, h=[side * F.col(f"n{i}") for i in range(2)] + [F.lit(1.0)])
    seen = F.when(board.isNotNull(), F.concat(each, F.array(whole))).when((o["type"] == "TAG") & (F.size(o["keypoints_3d"]) == 4), F.array(single)).otherwise(F.array().cast(f"array<{THING}>"))
    fair = (o["type"] != "TAG") | (F.abs(F.col("n0") - F.col("n1")) <= SQUARE * F.abs(F.col("n1")))
    failed = F.raise_error(F.concat(F.lit("a marker isn't square: "), o["name"])).cast(f"array<{THING}>")
    return rows.withColumn("thing", F.explode(F.when(fair, seen).otherwise(failed))).select("image_id", "scene_id", "camera", "place", "c", *(f"w{i}{j}" for i in range(3) for j in range(3)), *(f"t{i}" for i in range(3)), "thing.*", (board.isNotNull() & (F.col("thing.record_type") == "TAG")).alias("of_board"))


BOARD_DEFINITION = "struct<type:string,rows:int,cols:int,square_size_mm:double,marker_size_mm:double,dictionary:string,total_keypoints:int,spacing_ratio:double>"
THING = f"struct<record_type:string,tag_id:bigint,tag_family:string,local:array<array<double>>,keys:array<array<double>>,centre:array<double>,tag_size_mm:double,board_definition:{BOARD_DEFINITION}>"


def detections(recipes: DataFrame, everything: bool = False) -> DataFrame:
    """Records of all cameras of scenes (scene_id, objects, cameras): columns of schema.DETECTION that geometry gives.

    Single markers are recorded wherever they lie; a board's markers only where they face the camera and lie whole in the
    frame, and its calibration points outside the frame become sentinels, unless `everything` is asked for. Points behind
    a camera get the place for that. Scenes without cameras or objects, and backing boards, give no rows. A marker whose
    scale isn't square, to a hundredth, is an error.
    """
    rows = parts(recipes)
    c = F.col("c")
    m = c["transform_matrix"]
    linear = [[m[i][j] for j in range(3)] for i in range(3)]
    rows = hold(with_rigid(rows, "r", "w"), e=[m[i][3] for i in range(3)], l=linear)
    rows = hold(rows, t=g.place(mat("r"), vec("t"), tuple(F.col("centre")[i] for i in range(3))), o=vec("t"))
    rows = hold(rows, b=g.inverse(g.opencv_axes(mat("l"))))
    # corners and key points in camera axes: b (r p + o - e), as one matrix and one vector
    rows = hold(rows, a=g.multiply(mat("b"), mat("r")), d=g.apply(mat("b"), g.minus(vec("o"), vec("e"))))
    k, model, lens = c["intrinsics"]["k_matrix"], c["intrinsics"]["distortion_model"], c["intrinsics"]["distortion_coeffs"]

    def seen(points: Column) -> Column:
        def pixel(p: Column) -> Column:
            u = g.let(g.distort_point(p["x"] / p["z"], p["y"] / p["z"], model, lens), lambda q: F.array(q[0] * k[0][0] + q[1] * k[0][1] + k[0][2], q[0] * k[1][0] + q[1] * k[1][1] + k[1][2]))
            return F.when(p["z"] <= g.NEAR, F.array(F.lit(g.BEHIND), F.lit(g.BEHIND))).otherwise(u)

        own = lambda p: F.struct(*(x.alias(n) for n, x in zip("xyz", g.place(mat("a"), vec("d"), tuple(p[i] for i in range(3))), strict=True)))
        return F.transform(F.transform(points, own), pixel)

    rows = rows.withColumns({"corners": seen(F.col("local")), "keypoints": seen(F.col("keys"))})
    normal = tuple(F.col(f"r{i}2") for i in range(3))
    rows = with_camera_pose(rows, "pose", "l", "e", "r", "t")
    width, height = c["intrinsics"]["resolution"][0], c["intrinsics"]["resolution"][1]
    framed = lambda p: (records.x(p) >= 0) & (records.x(p) < width) & (records.y(p) >= 0) & (records.y(p) < height)
    own = F.when(F.size("keypoints") > 0, F.transform("keypoints", lambda p: p if everything else F.when(framed(p), p).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))))
    depth = g.dot(g.minus(vec("t"), vec("e")), tuple(-F.col(f"l{i}2") for i in range(3)))
    shown = ~F.col("of_board") | g.facing(vec("t"), vec("e"), normal, FACING) & F.forall("corners", framed)
    dynamics = c["sensor_dynamics"]
    out = {
        "tag_id": F.col("tag_id"), "tag_family": F.col("tag_family"), "corners": F.col("corners"), "record_type": F.col("record_type"), "keypoints": own,
        "distance": g.distance(vec("t"), vec("e")), "angle_of_incidence": g.angle_of_incidence(vec("t"), vec("e"), normal),
        "pixel_area": F.when(F.size("corners") >= 3, F.abs(g.polygon_area(F.col("corners")))), "ppm": g.pixels_per_module(k[0][0], F.col("tag_size_mm") / 1000, depth, records.tag_grid(F.col("tag_family"))),
        "is_mirrored": F.col("r_mirrored"), "position": F.col("pose_position"), "rotation_quaternion": F.col("pose_quaternion"), "tag_size_mm": F.col("tag_size_mm"), "k_matrix": k,
        "resolution": c["intrinsics"]["resolution"], "distortion_model": model, "distortion_coeffs": lens, "velocity": dynamics["velocity"], "shutter_time_ms": dynamics["shutter_time_ms"],
        "rolling_shutter_ms": dynamics["rolling_shutter_ms"], "fstop": c["fstop"], "eval_margin_px": c["intrinsics"]["eval_margin_px"], "board_definition": F.col("board_definition"), "shown": F.lit(True) if everything else shown,
    }
    # held back from the optimizer, which would write the filter out in terms of all that lies beneath
    return rows.select("image_id", "scene_id", "camera", "place", F.explode(F.when(out.pop("shown"), F.array(F.struct(*(v.alias(n) for n, v in out.items()))))).alias("record")).select("image_id", "scene_id", "camera", "place", "record.*")
