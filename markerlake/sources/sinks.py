"""Writers of detection datasets' files. Spark's commit makes each write whole or absent.

Documents in JSON hold one shard each, as a shard is what one worker renders: a column `shard` says which rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markerlake.functions import records
from markerlake.functions.geometry import polygon_area
from markerlake.sources.files import files

#: Fixed values of the envelope.
VERSION, POLICY = "2.0", "ternary_visibility"
CORNER_NAMES = ("tl", "tr", "br", "bl")


def effective_margin(default: int) -> Column:
    """A record's own margin, where it has one."""
    own = F.col("eval_margin_px")
    return F.when(own > 0, own).otherwise(default).cast("int")


def with_visibility(detections: DataFrame, default_margin: int = 0) -> DataFrame:
    """Flags of corners and key points under the effective margin; eval_complete for records without key points."""
    width, height, margin = F.col("resolution")[0], F.col("resolution")[1], effective_margin(default_margin)
    known = F.size("resolution") == 2
    seen = F.when(known, records.visibility(F.col("corners"), width, height, margin))
    keys = F.when(known & (F.size("keypoints") > 0), records.visibility(F.col("keypoints"), width, height, margin))
    whole = F.when(known & keys.isNull(), F.forall(seen, lambda v: v == 2))
    return detections.withColumns({"corners_visibility": seen, "keypoints_visibility": keys, "eval_complete": whole})


def rich_truth(detections: DataFrame, folder: str, default_margin: int = 0, envelope: bool = True) -> None:
    """A document for each shard: the records, in an envelope with the evaluation context or bare."""
    rows = with_visibility(detections, default_margin)
    fields = F.struct(*(c for c in rows.columns if c != "shard"))
    each = rows.groupBy("shard").agg(F.max(effective_margin(default_margin)).alias("margin"), F.collect_list(fields).alias("records"))  # a shard is a file, and bounded as such
    context = F.struct(F.greatest("margin", F.lit(default_margin)).alias("photometric_margin_px"), F.lit(POLICY).alias("truncation_policy"))
    value = F.to_json(F.struct(F.lit(VERSION).alias("version"), context.alias("evaluation_context"), "records") if envelope else F.col("records"))
    each.select("shard", value.alias("value")).write.partitionBy("shard").text(folder)


def attributes(detections: DataFrame) -> Column:
    """What a COCO annotation has no place for, as JSON with its types; the metadata's keys never replace a record's own."""
    native = {"corners", "keypoints", "image_id", "shard", "metadata"}
    own = [c for c in detections.columns if c not in native]
    known = F.to_json(F.struct(*own), {"ignoreNullFields": "false"}) if own else F.lit("{}")
    if "metadata" not in detections.columns:
        return known
    more = F.map_filter(F.from_json("metadata", "map<string,variant>"), lambda k, v: ~k.isin(own))
    inside = F.regexp_extract(F.to_json(more), r"(?s)^\{(.*)\}$", 1)
    return F.when(F.coalesce(F.length(inside), F.lit(0)) == 0, known).otherwise(F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit("," if own else ""), inside, F.lit("}")))


def annotation(detections: DataFrame, margin: int = 0) -> dict[str, Column]:
    """bbox, area, segmentation, keypoints, num_keypoints of a detection.

    Box and area are those of the corners as projected, the outline is clipped to the frame; fewer than three corners
    are points with a small box and no outline. Key points follow the corners, each under the record's own margin.
    """
    corners, width, height = F.col("corners"), F.col("resolution")[0], F.col("resolution")[1]
    few = F.size(corners) < 3
    box = F.when(few, records.point_box(corners)).otherwise(F.coalesce(records.bounding_box(corners), F.array_repeat(F.lit(0.0), 4)))
    least = effective_margin(margin) if "eval_margin_px" in detections.columns else F.lit(margin)
    points = F.concat(corners, F.coalesce("keypoints", F.array().cast("array<array<double>>"))) if "keypoints" in detections.columns else corners
    outline = F.when(few, F.array().cast("array<array<double>>")).otherwise(F.array(F.flatten(records.clip(corners, width, height))))
    area = F.when(few, box[2] * box[3]).otherwise(F.abs(polygon_area(corners)))
    return {"bbox": box, "area": area, "segmentation": outline, "keypoints": records.coco_keypoints(points, width, height, least), "num_keypoints": records.num_keypoints(points, width, height, least)}


def coco(detections: DataFrame, folder: str, margin: int = 0) -> None:
    """A document for each shard with images, annotations and categories, numbered from 1 in order of their names.

    Needs shard, image_id, tag_id, tag_family, corners, resolution. An image whose records differ in resolution gets the
    largest. A shard is what one worker renders, and bounded as such.
    """
    part = Window.partitionBy("shard")
    more = {"size": F.max(F.struct(F.col("resolution")[0].alias("width"), F.col("resolution")[1].alias("height"))).over(Window.partitionBy("shard", "image_id")), "attributes": attributes(detections), **annotation(detections, margin)}
    numbers = {"image_number": F.dense_rank().over(part.orderBy("image_id")), "category_id": F.dense_rank().over(part.orderBy("tag_family"))}
    rows = detections.select("shard", "image_id", "tag_id", "tag_family", *(v.alias(n) for n, v in more.items())).withColumns(numbers)
    rows = rows.withColumn("id", F.row_number().over(part.orderBy("image_id", "tag_id", "tag_family", "bbox", "attributes")))
    image = F.struct(F.col("image_number").alias("id"), F.concat(F.lit("images/"), "image_id", F.lit(".png")).alias("file_name"), "size.width", "size.height")
    category = F.struct(F.col("category_id").alias("id"), F.col("tag_family").alias("name"), F.lit("fiducial_marker").alias("supercategory"), F.array(*map(F.lit, CORNER_NAMES)).alias("keypoints"), F.array(*(F.array(F.lit(i + 1), F.lit((i + 1) % 4 + 1)) for i in range(4))).alias("skeleton"))
    label = F.struct("id", F.col("image_number").alias("image_id"), "category_id", "segmentation", "bbox", "area", "keypoints", "num_keypoints", F.lit(0).alias("iscrowd"), F.parse_json("attributes").alias("attributes"))
    each = rows.groupBy("shard").agg(F.array_sort(F.collect_set(image)).alias("images"), F.collect_list(label).alias("annotations"), F.array_sort(F.collect_set(category)).alias("categories"))
    each.select("shard", F.to_json(F.struct("images", "annotations", "categories")).alias("value")).write.partitionBy("shard").text(folder)


def flat_csv(detections: DataFrame, folder: str, keypoints: int = 0) -> None:
    """Flat rows with corners, and the first `keypoints` key points, in the closed frame, to four places.

    Markers without four corners are left out; columns that the detections lack are written empty.
    """
    width, height = F.col("resolution")[0], F.col("resolution")[1]
    points = records.clip(F.col("corners"), width, height)
    numbers = [F.bround(F.get(F.get(points, F.lit(i)), F.lit(j)), 4).alias(f"{'xy'[j]}{i + 1}") for i in range(4) for j in range(2)]
    if keypoints:
        more = records.clip(F.col("keypoints"), width, height)
        numbers += [F.bround(F.get(F.get(more, F.lit(i)), F.lit(j)), 4).alias(f"kp{i + 1}_{'xy'[j]}") for i in range(keypoints) for j in range(2)]
    own = lambda name, kind: (F.col(name) if name in detections.columns else F.lit(None)).cast(kind)
    meta = [F.bround(own("tag_size_mm", "double"), 4).alias("tag_size_mm"), F.bround(own("ppm", "double"), 4).alias("ppm"), F.coalesce(own("is_mirrored", "int"), F.lit(0)).alias("is_mirrored")]
    rows = detections.where((F.col("record_type") != "TAG") | (F.size("corners") == 4))
    rows.select("image_id", "tag_id", "tag_family", "record_type", *meta, *numbers).write.csv(folder, header=True)


def provenance(records_: DataFrame, folder: str) -> None:
    """The last record (by seq) of each image_id, as JSON lines."""
    last = records_.groupBy("image_id").agg(F.max_by(F.struct(*(c for c in records_.columns if c not in ("image_id", "seq"))), "seq").alias("r"))
    last.select("image_id", "r.*").write.json(folder)


def report(rows: DataFrame, folder: str) -> None:
    """A report of few rows as one JSON file."""
    rows.coalesce(1).write.json(folder)


def images(detections: DataFrame, folder: str, config_name: str, split: str) -> None:
    """Image-wise rows in a Parquet table that is partitioned by configuration and split."""
    fields = F.struct(*(c for c in detections.columns if c != "image_id"))
    rows = detections.groupBy("image_id").agg(F.collect_list(fields).alias("records"))
    rows.withColumns({"config_name": F.lit(config_name), "split": F.lit(split)}).write.partitionBy("config_name", "split").parquet(folder)


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (below the folder), sha256 of each file."""
    rows = files(spark, folder, pattern)
    name = folder.rstrip("/").rpartition("/")[2]
    return rows.select(F.substring_index("path", f"/{name}/", -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def quarantine(outcome: DataFrame, folder: str) -> None:
    """A line for each failed gate of an outcome (quarantined, gate_failures); no lines where all gates pass."""
    outcome.where("quarantined").select(F.explode("gate_failures").alias("value")).coalesce(1).write.text(folder)


def telemetry_csv(beats: DataFrame, folder: str) -> None:
    """Heartbeats as flat rows; nothing is written where there are none."""
    if not beats.isEmpty():
        beats.select("timestamp", "worker_id", "telemetry.*").write.csv(folder, header=True)


def telemetry_lines(beats: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the heartbeats of a stream as JSON lines; returns the running query."""
    return beats.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()
