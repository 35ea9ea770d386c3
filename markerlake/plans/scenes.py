"""Scene recipes derived from the standard `orders` and `lineitem` tables, by arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.sources.folders import spread


def recipes(orders: DataFrame, lineitem: DataFrame, shard: Column | None = None) -> DataFrame:
    """A scene for each order: a marker for each line, a board for every third, none to two cameras that look down.

    Orders and lines are dealt as the few numbers that scenes are made of. With `shard`, an expression of scene_id, all
    scenes of a shard lie in one partition, and it is a column.
    """
    number, part, supplier = "l_linenumber", "l_partkey", "l_suppkey"
    lines = lineitem.where("l_orderkey is not null").select(F.col("l_orderkey").alias("scene_id"), F.struct(number, part, supplier).alias("line"), F.lit(None).cast("struct<price:bigint>").alias("head"))
    heads = orders.select(F.col("o_orderkey").alias("scene_id"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"), F.struct(F.floor("o_totalprice").alias("price")).alias("head"))
    dealt, keys = lines.union(heads), ["scene_id"]
    if shard is not None:
        keys = ["shard", "scene_id"]
        dealt = spread(dealt.withColumn("shard", shard), "shard")
    each = dealt.groupBy(*keys).agg(F.collect_list("head").alias("heads"), F.collect_list("line").alias("lines"))
    scene = F.col("scene_id")
    place = lambda c, m: (c % m) / 20.0 - 1

    def tag(line: Column) -> Column:
        n = line[number]
        return F.struct(
            F.lit("TAG").alias("type"), F.concat_ws("_", F.lit("t"), n.cast("string"), line[part].cast("string"), line[supplier].cast("string")).alias("name"),
            F.array(place(line[part], 40), place(line[supplier], 40), F.when(n % 4 == 0, 0.5).otherwise(0.0)).alias("location"),
            F.array(F.when(n % 5 == 0, 3.14159265).otherwise(0.0), F.lit(0.0), F.lit(0.0)).alias("rotation_euler"),
            F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("scale"),
            F.when(scene % 11 == 0, F.concat(F.lit("cache/"), n.cast("string"))).when(scene % 13 == 0, "lost.png").otherwise("known.png").alias("texture_path"),
            F.struct(F.lit("tag36h11").alias("tag_family"), (F.lit(0.1) + n / 50.0).alias("tag_size"), F.lit(None).cast("int").alias("cols"), F.lit(None).cast("int").alias("rows"), F.lit(None).cast("double").alias("square_size")).alias("properties"),
        )

    each = each.withColumn("tags", F.transform("lines", lambda x: F.struct(x[number].alias("i"), tag(x).alias("o"))))
    found = F.transform(F.array_sort("tags"), lambda x: x["o"])
    board = F.struct(
        F.lit("BOARD").alias("type"), F.lit("b").alias("name"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("location"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("rotation_euler"),
        F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("scale"), F.lit(None).cast("string").alias("texture_path"),
        F.struct(F.lit(None).cast("string").alias("tag_family"), F.lit(None).cast("double").alias("tag_size"), F.lit(8).alias("cols"), F.lit(6).alias("rows"), F.lit(0.25).alias("square_size")).alias("properties"),
    )
    zero, one = F.lit(0.0), F.lit(1.0)

    def camera(i: int):
        wide = F.when(scene % 29 == 0, 0).otherwise(640)
        down = F.array(F.array(one, zero, zero, F.lit(i * 0.25)), F.array(zero, one, zero, zero), F.array(zero, zero, one, F.lit(2.0 + i)), F.array(zero, zero, zero, one))
        k = F.array(F.array(F.lit(500.0), zero, F.lit(320.0)), F.array(zero, F.lit(500.0), F.lit(240.0)), F.array(zero, zero, one))
        return F.struct(down.alias("transform_matrix"), F.struct(F.array(wide, F.lit(480)).alias("resolution"), k.alias("k_matrix")).alias("intrinsics"), F.lit(None).cast("double").alias("min_tag_pixels"), F.when(scene % 2 == 0, 950.0).alias("max_tag_pixels"))

    rows = each.select(*keys, F.explode("heads").alias("head"), found.alias("tags")).withColumn("price", F.col("head.price"))
    light = lambda x: F.struct(F.lit("SUN").alias("type"), x.cast("double").alias("intensity"))
    world = F.struct(F.when(scene % 7 == 0, "sky.hdr").alias("background_hdri"), F.lit(None).cast("string").alias("texture_path"), F.array(light(F.col("price") % 100), light(F.lit(1.5))).alias("lights"))
    cameras = F.slice(F.array(camera(0), camera(1)), F.lit(1), (scene % 3).cast("int"))
    return rows.select(*keys, world.alias("world"), F.when(scene % 3 == 1, F.concat(F.array(board), F.col("tags"))).otherwise(F.col("tags")).alias("objects"), cameras.alias("cameras"))


#: The same objects and cameras in SQL, as flat rows.
SQL = """tag AS (
    SELECT l_orderkey AS scene_id, row_number() OVER () AS rid, l_linenumber AS i, 't_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS name, (l_partkey % 40) / 20.0 - 1 AS x, (l_suppkey % 40) / 20.0 - 1 AS y,
        CASE WHEN l_linenumber % 4 = 0 THEN 0.5 ELSE 0.0 END AS z, l_linenumber % 5 = 0 AS turned, 0.1 + l_linenumber / 50.0 AS size,
        CASE WHEN l_orderkey % 11 = 0 THEN 'cache/' || l_linenumber WHEN l_orderkey % 13 = 0 THEN 'lost.png' ELSE 'known.png' END AS texture
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), cam AS (
    SELECT o_orderkey AS scene_id, c AS camera, c * 0.25 AS cx, 2.0 + c AS cz, CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 640 END AS w
    FROM orders, (SELECT unnest([0, 1]) AS c) WHERE c < o_orderkey % 3
), seen AS (
    SELECT cam.scene_id, camera, size, w, turned, cx, cz, x, y, z, sqrt((cx - x) * (cx - x) + y * y + (cz - z) * (cz - z)) AS d,
        500 * (x - cx - size / 2) / (cz - z) + 320 AS u0, 500 * (x - cx + size / 2) / (cz - z) + 320 AS u1, 500 * (-y - size / 2) / (cz - z) + 240 AS v0, 500 * (-y + size / 2) / (cz - z) + 240 AS v1
    FROM cam JOIN tag USING (scene_id)
), ok AS (
    SELECT *, NOT turned AND (cz - z) / d > 0.15 AND u0 >= 0 AND u1 <= w AND v0 >= 0 AND v1 <= 480 AND (u1 - u0) * (v1 - v0) >= 36
        AND (u1 - u0) * (v1 - v0) <= CASE WHEN scene_id % 2 = 0 THEN 950 ELSE w * 480 END AND degrees(acos((cz - z) / d)) <= 80 AS usable
    FROM seen
)"""
