"""Points of detections for viewers, calibration and checks of poses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import records


def plain_points(points: Column) -> Column:
    """The same points as doubles, in the same order: corners are never sorted."""
    return points.cast("array<array<double>>")


def is_whole(corners: Column) -> Column:
    """Whether there are four corners; false for null."""
    return F.coalesce(F.size(corners) == 4, F.lit(False))


def labelled(points: Column, width: Column, height: Column, margin: Column | int = 0, flags: Column | None = None, normalized: bool = False) -> Column:
    """Array of struct(label, x, y, visibility, tags) in shares of the frame: each point's own flag where there is one, else
    0 for a sentinel, 1 within the margin, 2 otherwise; points that aren't visible are tagged `sentinel` or `margin`."""
    m = margin if isinstance(margin, Column) else F.lit(margin)

    def one(p: Column, i: Column) -> Column:
        near = (m > 0) & ~records.inside(p, width, height, m) & F.lit(not normalized)
        computed = F.when(records.is_sentinel(p), 0).when(near, 1).otherwise(2)
        seen = computed if flags is None else F.coalesce(F.get(flags, i).cast("int"), computed)
        at = [records.x(p), records.y(p)] if normalized else [records.x(p) / width, records.y(p) / height]
        tags = F.when(seen == 1, F.array(F.lit("margin"))).when(seen == 0, F.array(F.lit("sentinel"))).otherwise(F.array().cast("array<string>"))
        return F.struct(i.cast("string").alias("label"), at[0].alias("x"), at[1].alias("y"), seen.alias("visibility"), tags.alias("tags"))

    return F.transform(points, one)


def with_visible(keypoints: Column, total: Column) -> Column:
    """struct(points, visible): sentinels keep their places; of a record without key points, `total` sentinels."""
    none = F.transform(F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>")), lambda _: F.array(F.lit(-1.0), F.lit(-1.0)))
    found = F.coalesce(keypoints, none)
    return F.struct(found.alias("points"), F.transform(found, lambda p: ~records.is_sentinel(p)).alias("visible"))


def in_frame(corners: Column, width: Column, height: Column, least_corners: int = 4, least_area: float = 0.0) -> Column:
    """struct(corners inside the half-open frame, area, whether both are enough)."""
    inside, area = F.size(F.filter(corners, lambda p: records.inside(p, width, height))), F.abs(g.polygon_area(corners))
    return F.struct(inside.alias("inside"), area.alias("area"), ((inside >= least_corners) & (area >= least_area)).alias("ok"))


def framed_or_sentinel(point: Column, width: Column, height: Column) -> Column:
    """A calibration point inside the half-open frame, else a sentinel; null counts as outside."""
    return F.when(records.inside(point, width, height), point).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def plausible_camera(eye: Sequence[Column], target: Sequence[Column], least_distance: float = 0.4, least_height: float = 0.05) -> Column:
    """Neither too near to what it looks at nor below the least height."""
    return (g.distance(eye, target) >= least_distance) & (eye[2] >= least_height)
