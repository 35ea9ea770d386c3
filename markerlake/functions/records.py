"""Columns of detection records: corners, key points, boxes, names and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markerlake.functions.geometry import polygon_area

INVALID = -999999.0  # coordinates at or below it are markers, not places
OUT_OF_FRAME, MARGIN, VISIBLE = 0, 1, 2
#: Data bits of marker families; cells across are those of the data and a border cell on each side.
TAG_BITS = {
    "tag36h11": 36, "tag36h10": 36, "tag25h9": 25, "tag16h5": 16,
    "DICT_4X4_50": 16, "DICT_4X4_100": 16, "DICT_4X4_250": 16, "DICT_6X6_1000": 36,
    "DICT_7X7_50": 49, "DICT_7X7_100": 49, "DICT_7X7_250": 49, "DICT_7X7_1000": 49, "DICT_ARUCO_ORIGINAL": 25,
}
#: How many ids families have, where their names don't end with it.
TAG_IDS = {"tag16h5": 16, "tag25h9": 35, "tag36h10": 2320, "tag36h11": 587, "DICT_ARUCO_ORIGINAL": 1024}
OTHER_IDS = 100
OTHER_BITS, OTHER_GRID = 36, 8


def x(point: Column) -> Column:
    return F.get(point, F.lit(0))


def y(point: Column) -> Column:
    return F.get(point, F.lit(1))


def is_sentinel(point: Column) -> Column:
    return (x(point) == -1.0) & (y(point) == -1.0)


def is_invalid(point: Column) -> Column:
    return (x(point) <= INVALID) | (y(point) <= INVALID)


def inside(point: Column, width: Column, height: Column, margin: Column | int = 0) -> Column:
    """In the frame less a margin, right and lower edges excluded."""
    m = margin if isinstance(margin, Column) else F.lit(margin)
    return (x(point) >= m) & (x(point) < width - m) & (y(point) >= m) & (y(point) < height - m)


def visibility(points: Column, width: Column, height: Column, margin: Column | int) -> Column:
    """0 for sentinels, 2 inside the inner frame, 1 for all else."""
    return F.transform(points, lambda p: F.when(is_sentinel(p), OUT_OF_FRAME).when(inside(p, width, height, margin), VISIBLE).otherwise(MARGIN))


def clip(points: Column, width: Column, height: Column) -> Column:
    """Points moved into the closed frame; sentinels and invalid places stay."""
    limit = lambda v, top: F.greatest(F.lit(0.0), F.least(top.cast("double"), v))
    return F.transform(points, lambda p: F.when(is_sentinel(p) | is_invalid(p), p).otherwise(F.array(limit(x(p), width), limit(y(p), height))))


def bounding_box(points: Column) -> Column:
    """[x, y, width, height] of the valid points; null for fewer than two."""
    kept = F.filter(points, lambda p: ~is_sentinel(p) & ~is_invalid(p))
    lows = [F.array_min(F.transform(kept, f)) for f in (x, y)]
    highs = [F.array_max(F.transform(kept, f)) for f in (x, y)]
    return F.when(F.size(kept) >= 2, F.array(lows[0], lows[1], highs[0] - lows[0], highs[1] - lows[1]))


def point_box(points: Column) -> Column:
    """Box of one or two points: an axis without extent is half a pixel wide to each side."""
    lows = [F.array_min(F.transform(points, f)) for f in (x, y)]
    highs = [F.array_max(F.transform(points, f)) for f in (x, y)]
    flat = [h - lo <= 0 for lo, h in zip(lows, highs, strict=True)]
    start = [F.when(f, lo - 0.5).otherwise(lo) for f, lo in zip(flat, lows, strict=True)]
    size = [F.when(f, 1.0).otherwise(h - lo) for f, lo, h in zip(flat, lows, highs, strict=True)]
    return F.array(*start, *size)


def coco_keypoints(points: Column, width: Column, height: Column, margin: Column | int) -> Column:
    """Flat (x, y, v): visible 2, sentinel 0 0 0, else 1."""
    each = F.transform(points, lambda p: F.when(is_sentinel(p), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(x(p), y(p), F.when(inside(p, width, height, margin), 2.0).otherwise(1.0))))
    return F.flatten(each)


def num_keypoints(points: Column, width: Column, height: Column, margin: Column | int) -> Column:
    """How many are visible; all of them where the frame is not known."""
    known = width.isNotNull() & height.isNotNull()
    return F.when(known, F.size(F.filter(points, lambda p: ~is_sentinel(p) & inside(p, width, height, margin)))).otherwise(F.size(points))


def corners_from_coco(keypoints: Column, box: Column) -> Column:
    """Four corners from the first twelve numbers of key points, else from the box."""
    b = [F.get(box, F.lit(i)) for i in range(4)]
    from_box = F.array(*(F.array(*p) for p in ((b[0], b[1]), (b[0] + b[2], b[1]), (b[0] + b[2], b[1] + b[3]), (b[0], b[1] + b[3]))))
    own = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get(keypoints, i * 3), F.get(keypoints, i * 3 + 1)))
    return F.when(F.size(keypoints) >= 12, own).otherwise(from_box)


def relative_polyline(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: F.array(x(p) / width, y(p) / height))


def pairs_of_flat(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1), lambda i: F.array(F.get(values, i * 2), F.get(values, i * 2 + 1)))


def order_of(points: Column) -> Column:
    """cw or ccw of exactly four points; null otherwise. What has no area counts as ccw."""
    return F.when(F.size(points) == 4, F.when(polygon_area(points) > 1e-6, "cw").otherwise("ccw"))


def out_of_bounds(box: Column) -> Column:
    """Whether a box in shares of the frame leaves it; false without a box."""
    b = [F.get(box, F.lit(i)) for i in range(4)]
    return F.coalesce((b[0] < -1e-6) | (b[1] < -1e-6) | (b[0] + b[2] > 1 + 1e-6) | (b[1] + b[3] > 1 + 1e-6), F.lit(False))


def scale_drift(ppm: Column, box: Column) -> Column:
    return F.coalesce((ppm > 50) & (F.get(box, F.lit(2)) * F.get(box, F.lit(3)) < 0.001), F.lit(False))


def image_id(scene: Column, camera: Column) -> Column:
    return F.format_string("scene_%04d_cam_%04d", scene.cast("long"), camera.cast("long"))


def parse_image_id(name: Column) -> Column:
    """struct(scene, camera): the second and fourth part, 0 where there is none; null where one is no number."""
    parts = F.split(name, "_")
    number = lambda i: F.when(F.size(parts) > i, F.get(parts, F.lit(i)).try_cast("int")).otherwise(0)
    return F.when(number(1).isNotNull() & number(3).isNotNull(), F.struct(number(1).alias("scene"), number(3).alias("camera")))


def tag_bits(family: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in TAG_BITS.items() for v in kv))
    return F.coalesce(F.try_element_at(table, family), F.lit(OTHER_BITS))


def tag_grid(family: Column) -> Column:
    """Cells across a marker with its border."""
    table = F.create_map(*(F.lit(v) for k, bits in TAG_BITS.items() for v in (k, int(bits**0.5) + 2)))
    return F.coalesce(F.try_element_at(table, family), F.lit(OTHER_GRID))


def tag_id_count(family: Column) -> Column:
    """How many ids a family has: in a table, or as the number that ends a dictionary's name."""
    table = F.create_map(*(F.lit(v) for kv in TAG_IDS.items() for v in kv))
    named = F.when(family.rlike("^DICT_[4-7]X[4-7]_[0-9]+$"), F.regexp_extract(family, "([0-9]+)$", 1).try_cast("int"))
    return F.coalesce(F.try_element_at(table, family), named, F.lit(OTHER_IDS))


def is_apriltag(family: Column) -> Column:
    return family.startswith("tag")


def is_aruco(family: Column) -> Column:
    return family.startswith("DICT_")


def parameter_slug(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("_"))


def value_slug(value: Column) -> Column:
    return F.translate(value, "./ ", "p__")


def derive_seed(master: Column, context: Column, step: Column) -> Column:
    """31 bits of SHA-256 over master:context:step."""
    digest = F.sha2(F.concat_ws(":", master.cast("string"), context.cast("string"), step.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647))


def shard_seed(master: Column, shard: Column) -> Column:
    """32 bits of SHA-256 over master:shard."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", master.cast("string"), shard.cast("string")), 256), 1, 8), 16, 10).cast("long")


def board_points(kind: Column, rows: Column, cols: Column, square_mm: Column) -> Column:
    """Inner corners of a charuco or aprilgrid board, row by row from the top left, in mm from its centre, y up."""
    n = (rows - 1) * (cols - 1)
    point = lambda i: F.array(((i % (cols - 1)) + 1 - cols / 2) * square_mm, (rows / 2 - 1 - F.floor(i / (cols - 1))) * square_mm, F.lit(0.0))
    return F.when(kind.isin("charuco", "aprilgrid") & (n > 0), F.transform(F.sequence(F.lit(0), n.cast("int") - 1), point)).otherwise(F.array().cast("array<array<double>>"))


def skeleton_edges(rows: Column, cols: Column) -> Column:
    """Pairs of neighbours to the right and below in a grid of points, as [from, to]."""
    each = F.transform(F.sequence(F.lit(0), rows * cols - 1), lambda i: F.filter(F.array(F.when((i + 1) % cols != 0, F.array(i, i + 1)), F.when(i + cols < rows * cols, F.array(i, i + cols))), lambda e: e.isNotNull()))
    return F.flatten(each)
