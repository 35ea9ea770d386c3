"""Merging the shards of a dataset: running id offsets, foreign keys, records, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markerlake.operators.relate import last_wins


def offsets(rows: DataFrame, shard: str = "shard", id_: str = "id") -> DataFrame:
    """(shard, offset): sum of largest id + 1 over the shards before, in the order of their names. One row for each shard."""
    sizes = rows.groupBy(shard).agg((F.max(id_) + 1).alias("_n"))
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))


def merge_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, remap_categories: bool = True, shard: str = "shard") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of all shards as one dataset.

    Ids move by their shard's offset. An annotation of an image that its shard doesn't hold keeps its image_id. Categories
    are joined by name, with the id they have in the first shard that holds them (new ones follow); without
    remap_categories, the first shard's categories stand and category_id stays.
    """
    image_offsets = F.broadcast(offsets(images, shard))  # one row for each shard
    annotation_offsets = F.broadcast(offsets(annotations, shard))
    moved = images.join(image_offsets, shard).select((F.col("id") + F.col("offset")).alias("id"), *(c for c in images.columns if c not in ("id",)), F.col("id").alias("_old"))
    keys = moved.select(shard, F.col("_old").alias("image_id"), F.col("id").alias("_image"))
    notes = annotations.join(annotation_offsets, shard).withColumn("id", F.col("id") + F.col("offset")).drop("offset")
    notes = notes.join(keys, [shard, "image_id"], "left").withColumn("image_id", F.coalesce("_image", "image_id")).drop("_image")
    if not remap_categories:
        first = categories.agg(F.min(shard).alias(shard))
        kept = categories.join(F.broadcast(first), shard, "left_semi").drop(shard)
        return moved.drop("_old", shard), notes.drop(shard).select(*(c for c in annotations.columns if c != shard)), kept
    names = categories.groupBy("name").agg(F.min(F.struct(shard, "id")).alias("_first"), F.min_by(F.struct(*(c for c in categories.columns if c not in (shard, "id", "name"))), F.struct(shard, "id")).alias("_rest"))
    named = names.select(F.row_number().over(Window.orderBy("_first", "name")).cast("long").alias("id"), "name", "_rest.*")  # one row for each category
    ids = categories.select(shard, F.col("id").alias("category_id"), "name").join(F.broadcast(named.select("name", F.col("id").alias("_category"))), "name").drop("name")
    notes = notes.join(F.broadcast(ids), [shard, "category_id"], "left").withColumn("category_id", F.coalesce("_category", "category_id")).drop("_category")
    return moved.drop("_old", shard), notes.select(*(c for c in annotations.columns if c != shard)), named


def merge_rows(*shards: DataFrame) -> DataFrame:
    """All rows of flat shards, by column name; columns that a shard lacks are null."""
    out = shards[0]
    for x in shards[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def merge_context(contexts: DataFrame, shard: str = "shard") -> DataFrame:
    """One row: the first shard's context, with the largest margin of all."""
    rest = [c for c in contexts.columns if c not in (shard, "photometric_margin_px")]
    return contexts.agg(F.max("photometric_margin_px").alias("photometric_margin_px"), F.min_by(F.struct(*rest), shard).alias("_first")).select("photometric_margin_px", "_first.*")


def merge_provenance(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """One row for each image: that of the last shard."""
    return last_wins(rows, ["image_id"], shard)


def surrogate_ids(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, id): 1, 2, .. in the order in which keys are first seen.

    Keys are numbered within ranges of `first` and moved by the sizes of the ranges before, so no task orders them all.
    """
    firsts = rows.groupBy(key).agg(F.min(seq).alias("first"))
    ranged = firsts.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first").sortWithinPartitions("first", key).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy("first", key))
    return ranged.withColumn("_i", inner).join(F.broadcast(starts), "_part").select(key, (F.col("_i") + F.col("_start")).cast("long").alias("id"))
