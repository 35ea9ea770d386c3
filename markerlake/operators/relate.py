"""Relations between records, images, files and shards: hydration, nesting, overlaps, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import records as r


def last_wins(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of rows with equal keys the one with the largest `seq`; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(seq), *(F.col(c) for c in rest if df.schema[c].dataType.typeName() not in ("map", "variant")))).alias("_last"))
    return found.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest)).select(*df.columns)


def first_of(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of rows with equal keys the one with the smallest `seq`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_first")).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)


HYDRATION_KEY = ["image_id", "tag_id", "record_type"]


def hydrate(samples: DataFrame, truth: DataFrame, fields: list[str], seq: str = "seq") -> DataFrame:
    """Samples with fields of their record; samples without one stay. The last of several records counts, type TAG if none."""
    typed = truth.withColumn("record_type", F.coalesce("record_type", F.lit("TAG"))).select(*HYDRATION_KEY, *fields, seq)
    return samples.join(last_wins(typed, HYDRATION_KEY, seq).drop(seq), HYDRATION_KEY, "left")


def nest(detections: DataFrame, fields: list[str], seq: str = "seq") -> DataFrame:
    """One row for each image with an array for each field, in the order of `seq`."""
    rows = F.array_sort(F.collect_list(F.struct(seq, *fields)))
    found = detections.groupBy("image_id").agg(rows.alias("_rows"))
    return found.select("image_id", *(F.col(f"_rows.{f}").alias(f) for f in fields))


def unnest(images: DataFrame, fields: list[str], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """One row for each detection of an image, with its place."""
    return images.select(*keys, F.posexplode(F.arrays_zip(*fields)).alias("pos", "x")).select(*keys, "pos", *(F.col(f"x.{f}").alias(f) for f in fields))


def overlap_pairs(boxes: DataFrame, threshold: float = 0.5, image: str = "image_id", seq: str = "seq") -> DataFrame:
    """(image, a, b, iou) of boxes x, y, w, h in one image whose intersection over union is over the threshold.

    Two such boxes share more than half of their extent on each axis, so their centres lie within half of the smaller
    extent: each box goes to cells as wide as its power of two, and a pair meets in the cell of the first one's centre.
    """
    base = boxes.select(image, seq, *"xywh").where("w > 0 and h > 0")
    level = F.floor(F.log2(F.greatest("w", "h"))).cast("int")
    sized = base.withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2).withColumn("_level", level)
    # over 0.5, sizes differ by less than twice: levels differ by one at most
    a = sized.select(F.col(image), F.explode(F.array(F.col("_level"), F.col("_level") + 1)).alias("_l"), F.col(seq).alias("a"), *(F.col(c).alias(f"a{c}") for c in "xywh"), F.col("cx"), F.col("cy"))
    side = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_l"))).cast("int")
    a = a.withColumn("_i", side("cx")).withColumn("_j", side("cy")).drop("cx", "cy")
    b = sized.select(F.col(image), F.explode(F.array(F.col("_level"), F.col("_level") + 1)).alias("_l"), F.col(seq).alias("b"), *(F.col(c).alias(f"b{c}") for c in "xywh"), F.col("cx"), F.col("cy"))
    near = F.sequence(F.lit(-1), F.lit(1))
    b = b.withColumn("_i", F.explode(F.transform(near, lambda d: side("cx") + d))).withColumn("_j", F.explode(F.transform(near, lambda d: side("cy") + d))).drop("cx", "cy")
    iou = g.box_iou([F.col(f"a{c}") for c in "xywh"], [F.col(f"b{c}") for c in "xywh"])
    met = a.join(b, [image, "_l", "_i", "_j"]).where(F.col("a") < F.col("b")).withColumn("iou", iou).where(F.col("iou") > threshold)
    return met.select(image, "a", "b", "iou").distinct()


def close_pairs(points: DataFrame, group: str, reach: float, seq: str = "seq") -> DataFrame:
    """(group, a, b, gap) of points (x, y) in one group that are closer than `reach`, by cells as wide as that."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    a = points.select(group, F.col(seq).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")).withColumn("_i", F.floor(F.col("ax") / reach).cast("long")).withColumn("_j", F.floor(F.col("ay") / reach).cast("long"))
    near = F.sequence(F.lit(-1), F.lit(1))
    b = points.select(group, F.col(seq).alias("b"), "x", "y", F.explode(F.transform(near, lambda d: cell("x") + d)).alias("_i"))
    b = b.withColumn("_j", F.explode(F.transform(near, lambda d: cell("y") + d)))
    gap = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    return a.join(b, [group, "_i", "_j"]).where("a < b").withColumn("gap", gap).where(F.col("gap") < reach).select(group, "a", "b", "gap")


def image_tags(detections: DataFrame, overlaps: DataFrame) -> DataFrame:
    """One row for each image: flags out_of_bounds, scale_drift, overlap, edge_case (key points in the margin)."""
    found = detections.groupBy("image_id").agg(
        F.bool_or("out_of_bounds").alias("out_of_bounds"), F.bool_or("scale_drift").alias("scale_drift"), F.sum("margin_points").alias("margin_points")
    )
    hit = overlaps.select("image_id").distinct().withColumn("overlap", F.lit(True))
    return found.join(hit, "image_id", "left").select("image_id", "out_of_bounds", "scale_drift", F.coalesce("overlap", F.lit(False)).alias("overlap"), (F.col("margin_points") > 0).alias("edge_case"))


def anomalies(tags: DataFrame) -> DataFrame:
    return tags.where("out_of_bounds or scale_drift or overlap")


def present(rows: DataFrame, files: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows whose file is there."""
    return rows.join(files.select(key).distinct(), key, "left_semi")


def remaining(wanted: DataFrame, done: DataFrame, key: str = "scene_id") -> DataFrame:
    """Rows that are not done yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def shard_plan(scenes: DataFrame, size: int, key: str = "scene_id") -> DataFrame:
    """Scenes with their shard: consecutive runs of `size` from 0."""
    return scenes.withColumn("shard", F.floor(F.col(key) / size).cast("long"))


def missing_shards(valid: DataFrame, total_scenes: int, size: int, count: str = "n") -> DataFrame:
    """Shards of a plan that are absent or don't hold as many scenes as they should."""
    shards = -(-total_scenes // size)
    expected = valid.sparkSession.range(shards).select(F.col("id").alias("shard"), F.when(F.col("id") == shards - 1, total_scenes - (shards - 1) * size).otherwise(size).cast("long").alias("expected"))
    return expected.join(valid.select("shard", F.col(count).alias("found")), "shard", "left").where(F.col("found").isNull() | (F.col("found") != F.col("expected"))).select("shard", "expected", F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def with_default(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """A small dimension's value for each row, or the default."""
    return rows.join(F.broadcast(dimension.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def calibration_pairs(boards: DataFrame) -> DataFrame:
    """Key points with the board point of the same place: (image_id, i, point, object_point), without sentinels and extra points."""
    spec = F.col("board_definition")
    points = boards.withColumn("_points", r.board_points(spec["type"], spec["rows"], spec["cols"], spec["square_size_mm"]))
    each = points.select("image_id", "_points", F.posexplode("keypoints").alias("i", "point"))
    return each.where((F.col("i") < F.size("_points")) & ~r.is_sentinel(F.col("point"))).select("image_id", "i", "point", F.get("_points", "i").alias("object_point"))


def query_logs(logs: DataFrame, level: str | None = None, where: str | None = None, limit: int | None = 100, fields: dict[str, str] | None = None) -> DataFrame:
    """Log rows of a level (any case) for which an SQL condition holds; what can't be evaluated is null and skipped.

    fields: names and types of keys of `context` and `payload` that the condition may use; payload wins.
    """
    rows = logs if level is None else logs.where(F.upper("level") == level.upper())
    own = rows.columns
    for name, kind in (fields or {}).items():
        path = f"$.{name}"
        rows = rows.withColumn(name, F.coalesce(*(F.get_json_object(c, path) for c in ("payload", "context") if c in own)).try_cast(kind))
    rows = rows.where(F.expr(where)) if where else rows
    rows = rows.select(*own, *(x for x in fields or {} if x not in own))
    return rows.limit(limit) if limit else rows


def latest(telemetry: DataFrame, key: str = "worker_id", at: str = "timestamp") -> DataFrame:
    rest = [c for c in telemetry.columns if c != key]
    return telemetry.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *(c for c in rest if c != at))).alias("x")).select(key, "x.*")


def silences(telemetry: DataFrame, seconds: float = 10.0, key: str = "worker_id", at: str = "timestamp") -> DataFrame:
    """Gaps of more than `seconds` between a worker's heartbeats: (worker, from, to, silence)."""
    order = Window.partitionBy(key).orderBy(at)
    gaps = telemetry.select(key, F.col(at).alias("from"), F.lead(at).over(order).alias("to"))
    return gaps.withColumn("silence", F.col("to") - F.col("from")).where(F.col("silence") > seconds)


def throughput(telemetry: DataFrame, at: str = "timestamp", vram: str = "vram") -> DataFrame:
    return telemetry.agg((F.max(at) - F.min(at)).alias("duration"), F.count("*").alias("events"), F.avg(vram).alias("mean_vram"), F.max(vram).alias("max_vram"))


def last_rows(telemetry: DataFrame, n: int = 10_000, at: str = "timestamp") -> DataFrame:
    return telemetry.orderBy(F.desc(at)).limit(n)


def verify_checksums(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of each file of a manifest: ok, tampered or missing."""
    found = files.select("path", F.col("sha256").alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("tampered")
    return manifest.join(found, "path", "left").select("path", status.alias("status"))


def camera_visibility(scenes: DataFrame, tags: DataFrame, sees: Column) -> DataFrame:
    """Cameras of each scene and how many of its tags they see: cameras and tags meet on scene_id only."""
    met = scenes.join(tags, "scene_id")
    return met.groupBy("scene_id", "camera").agg(F.sum(sees.cast("int")).cast("long").alias("visible"))
