"""Readers of detection datasets' files. Shards are taken in the order of their names as text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markerlake import schema
from markerlake.functions import records

#: Columns of flat tables that aren't numbers, and what stands for those that a table lacks.
FLAT_TEXT = {"image_id": "string", "tag_id": "bigint", "tag_family": "string", "record_type": "string", "is_mirrored": "int"}
NUMBERS = r"[xy][0-9]+|kp[0-9]+_[xy]|tag_size_mm|ppm"
FLAT_DEFAULT = {"record_type": "TAG", "is_mirrored": 0}
BOARD_OF_OLD = f"struct<board_definition:{schema.BOARD}>"


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, value: whole text files, which hold one JSON value each, of one folder or several; an empty file too has its
    row, with an empty value. Files whose names end so (.gz, ..) are decompressed."""
    found = []
    for x in [path] if isinstance(path, str) else path:
        rows = spark.read.text(x, wholetext=True)
        found.append(rows.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), "value"))
        # Scans skip files without bytes; the driver has listed them all to plan the scan.
        names = spark.read.format("binaryFile").load(x).select(F.col("path").alias("file"))
        listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", f),) for f in rows.inputFiles()], "file string")
        found.append(listed.join(names, "file", "left_anti").select("file", F.lit("").alias("value")))
    return reduce(DataFrame.unionByName, found)


def is_object(value: Column) -> Column:
    return F.ltrim(value).startswith("{")


def unwrap(value: Column, kind: str) -> Column:
    """The array of a document: the document itself, or `records` of an envelope (none if it has no records).

    What doesn't parse as either, whole, is null.
    """
    whole = F.from_json(value, "map<string,string>")
    wrapped = F.when(whole.isNotNull(), F.coalesce(F.from_json(F.try_element_at(whole, F.lit("records")), kind), F.when(F.try_element_at(whole, F.lit("records")).isNull(), F.array().cast(kind))))
    return F.when(is_object(value), wrapped).otherwise(F.from_json(value, kind))


def or_fail(found: Column, broken: str) -> Column:
    """The parsed value; where there is none, an error that names the file, or null if broken files are kept."""
    if broken not in ("fail", "keep"):
        raise ValueError(f"broken files either fail or are kept, not {broken}")
    return found if broken == "keep" else F.coalesce(found, F.raise_error(F.concat(F.lit("no valid JSON in "), "file")).cast("void"))


def rich_truth(spark: SparkSession, path: str | list[str], broken: str = "fail") -> DataFrame:
    """Detections of both versions of the format: file, place in it, all columns of schema.DETECTION, `valid`.

    A board definition that older files keep in the metadata moves to its column. Records without an image id or corners
    aren't valid; they stay, so that a caller can set them aside or fail. A file that isn't whole JSON is an error; with
    broken="keep" it is a row without a place, not valid.
    """
    parsed = or_fail(unwrap(F.col("value"), f"array<struct<{as_struct(schema.DETECTION)}>>"), broken)
    each = documents(spark, path).select("file", parsed.alias("found"))
    rows = each.select("file", F.posexplode_outer("found").alias("place", "r"), F.col("found").isNull().alias("broken")).where("broken or place is not null").select("file", "place", "r.*")
    old = F.from_json("metadata", BOARD_OF_OLD)["board_definition"]
    rows = rows.withColumn("board_definition", F.coalesce("board_definition", old))
    return rows.withColumn("valid", F.col("image_id").isNotNull() & F.col("corners").isNotNull())


def as_struct(columns: str) -> str:
    """A schema's columns as the fields of a struct type's text."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(columns).simpleString().removeprefix("struct<").removesuffix(">")


def contexts(spark: SparkSession, path: str | list[str], broken: str = "fail") -> DataFrame:
    """file, photometric_margin_px, truncation_policy: an envelope's evaluation context, nulls for bare arrays."""
    whole = F.when(is_object(F.col("value")), or_fail(F.from_json("value", "map<string,string>"), broken))
    return documents(spark, path).select("file", F.from_json(F.try_element_at(whole, F.lit("evaluation_context")), schema.CONTEXT).alias("c")).select("file", "c.*")


def coco(spark: SparkSession, path: str | list[str], more: tuple[str, ...] = (), broken: str = "fail") -> DataFrame:
    """file, image (stem of its file's name), id, category, corners, attributes of annotations, and what `more` names of
    their other fields and their image's width and height; annotations of unknown images are left out.

    Corners come from the first four key points, else from the box. Each file is read and parsed once.
    """
    lists = {n: f"array<struct<{as_struct(k)}>>" for n, k in (("images", schema.COCO_IMAGE), ("categories", schema.COCO_CATEGORY), ("annotations", schema.COCO_ANNOTATION))}
    whole = or_fail(F.from_json("value", "map<string,string>"), broken)
    parts = documents(spark, path).select("file", whole.alias("w")).select("file", *(F.from_json(F.try_element_at("w", F.lit(n)), k).alias(n) for n, k in lists.items()))
    # an annotation meets its image and its category by sorting a shard's parts together, not by a search for each
    kinds = F.concat(
        F.coalesce(F.transform("images", lambda x: F.struct(x["id"].alias("image_id"), F.lit(0).alias("kind"), x.alias("image"), F.lit(None).cast(lists["annotations"][6:-1]).alias("a"))), F.array()),
        F.coalesce(F.transform("annotations", lambda x: F.struct(x["image_id"].alias("image_id"), F.lit(1).alias("kind"), F.lit(None).cast(lists["images"][6:-1]).alias("image"), x.alias("a"))), F.array()),
    )
    named = F.map_from_entries(F.transform(F.coalesce("categories", F.array()), lambda c: F.struct(c["id"], c["name"])))
    rows = parts.select("file", F.explode(kinds).alias("k"), named.alias("names")).select("file", "names", "k.*")
    rows = rows.withColumn("image", F.first("image", ignorenulls=True).over(Window.partitionBy("file", "image_id").orderBy("kind")))
    found = rows.where("kind = 1 and image is not null").select("file", F.regexp_extract("image.file_name", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("image_name"), F.try_element_at("names", F.col("a.category_id")).alias("category"), "image.width", "image.height", "a.*")
    return found.select("file", F.col("image_name").alias("image"), "id", "category", records.corners_from_coco(F.col("keypoints"), F.col("bbox")).alias("corners"), "attributes", *more)


def flat_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Detections of flat tables, old and new: columns are taken by the names in each file's header.

    Corners are x1, y1, x2, .. as far as they go, all taken as visible; key points kp1_x, kp1_y, ... A column that a
    file lacks is null, but record_type is TAG and is_mirrored false; columns of no meaning here are left out.
    """
    named = F.input_file_name()
    heads = spark.read.text(path).where(F.col("value").rlike("^\"?image_id\"?,")).select(named.alias("file"), "value")
    # one row a different header; each lists files that the driver has listed to read them at all
    kinds = heads.groupBy("value").agg(F.collect_set("file").alias("files")).collect()
    empty = spark.createDataFrame([], "image_id string, tag_id bigint, tag_family string, record_type string, tag_size_mm double, ppm double, is_mirrored boolean, corners array<array<double>>, keypoints array<array<double>>, corners_visibility array<tinyint>")
    return reduce(DataFrame.unionByName, [_flat(spark, [x.strip().strip('"') for x in r["value"].split(",")], r["files"]) for r in kinds], empty)


def _flat(spark: SparkSession, header: list[str], paths: list[str]) -> DataFrame:
    rows = spark.read.schema(", ".join(f"`{n}` {FLAT_TEXT.get(n, 'double' if re.fullmatch(NUMBERS, n) else 'string')}" for n in header)).csv(paths, header=True)

    def column(name: str, kind: str) -> Column:
        own = F.col(f"`{name}`") if name in header else F.lit(None)
        return F.coalesce(own.cast(kind), F.lit(FLAT_DEFAULT.get(name)).cast(kind)).alias(name)

    def points(x: str, y: str) -> Column:
        last = next(i for i in range(1, len(header) + 2) if x.format(i) not in header or y.format(i) not in header)
        return F.filter(F.array(*(F.array(x.format(i), y.format(i)) for i in range(1, last))).cast("array<array<double>>"), lambda p: p[0].isNotNull() & p[1].isNotNull())

    corners, keypoints = points("x{}", "y{}"), points("kp{}_x", "kp{}_y")
    return rows.select(
        column("image_id", "string"), column("tag_id", "bigint"), column("tag_family", "string"), column("record_type", "string"),
        column("tag_size_mm", "double"), column("ppm", "double"), column("is_mirrored", "boolean"), corners.alias("corners"),
        F.when(F.size(keypoints) > 0, keypoints).alias("keypoints"), F.transform(corners, lambda p: F.lit(2).cast("tinyint")).alias("corners_visibility"),
    )


def logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema.LOG).json(path, mode="DROPMALFORMED").where("level is not null or message is not null")


def recipes(spark: SparkSession, path: str | list[str], broken: str = "fail") -> DataFrame:
    """file and the columns of schema.RECIPE of files that hold one recipe or an array of them.

    A file that isn't whole JSON is an error; with broken="keep" it is a row of nulls.
    """
    kind, value = f"array<struct<{as_struct(schema.RECIPE)}>>", F.col("value")
    parsed = or_fail(F.from_json(F.when(is_object(value), F.concat(F.lit("["), value, F.lit("]"))).otherwise(value), kind), broken)
    each = documents(spark, path).select("file", parsed.alias("found"))
    return each.select("file", F.explode_outer("found").alias("r"), F.col("found").isNull().alias("broken")).where("broken or r is not null").select("file", "r.*")


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """image_id (from the name) and records of <image>_meta.json files; those that don't parse are left out."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*_meta.json").select(F.regexp_extract(F.input_file_name(), r"([^/]*)_meta\.json$", 1).alias("image_id"), "value")
    return rows.withColumn("records", unwrap(F.col("value"), f"array<struct<{as_struct(schema.DETECTION)}>>")).where("records is not null").select("image_id", F.size("records").alias("n"), "records")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, content of all files in a folder and below."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def completed_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of scenes of which a file scene_<id>.., or one in a folder of such a name, is there; only names are read."""
    found = files(spark, folder).select(F.regexp_extract("path", r"scene_0*([0-9]+)", 1).alias("id"))
    return found.where("id <> ''").select(F.col("id").cast("bigint").alias("scene_id")).distinct()


def pull(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Records of an image-wise Parquet table; of `limit` images, all if that is 0."""
    images = spark.read.parquet(path)
    return (images.limit(limit) if limit else images).select(*(c for c in images.columns if c != "records"), F.explode("records").alias("r")).select(*(c for c in images.columns if c != "records"), "r.*")


def first_that_exists(spark: SparkSession, folder: str, names: tuple[str, ...] = ("coco_labels.json", "ground_truth.csv", "annotations.json", "tags.csv")) -> str:
    """The source that goes before the others in a dataset's folder; an error if none is there."""
    found = {r["name"] for r in files(spark, folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).where(F.col("name").isin(*names)).distinct().collect()}  # at most one row a name
    for name in names:
        if name in found:
            return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def audited(spark: SparkSession, folder: str) -> DataFrame:
    """The detections that an audit of a dataset's folder reads: rich_truth.json, else tags.csv; an error without both."""
    found = first_that_exists(spark, folder, ("rich_truth.json", "tags.csv"))
    return rich_truth(spark, found).drop("file", "place", "valid") if found.endswith(".json") else flat_csv(spark, found)
