"""Exact medians of groups of any size: histograms narrow each group's values down to those around its middle.

Each round counts the values of a range in CELLS cells of equal width and goes on in the one cell where the wanted rank
lies; cells are summed before they are shuffled. At most FEW values of a group meet in one place. Groups of at most FEW
values take no round at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markerlake.sources.folders import kept

CELLS, FEW = 4096, 10_000


def medians(rows: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by and, for each column, its median, the mean of both middle values where there are two; null without values.

    Nulls, NaN and infinite values take no part. Groups are equal also where they are null. Without `by`, one row, none
    for an empty table.
    """
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("one"))
    value = F.struct(*(F.col(c).cast("double").alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col("v")[c].alias("value")) for c in columns)))
    each = rows.select(group.alias("g"), value.alias("v")).select("g", pairs.alias("p")).select("g", F.xxhash64("g").alias("h"), "p.*")
    finite = F.abs("value") < float("inf")
    each = kept(each.where(finite), "values")
    size = each.groupBy("g", "h", "measure").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = kept(size.withColumn("rank", F.explode(ranks)), "ranks")  # of a value, from 0, in its range
    found = []
    while True:
        narrow = (F.col("n") <= FEW) | (F.col("low") == F.col("high"))
        found.append(state.where(narrow))
        todo = state.where(~narrow)
        if todo.isEmpty():
            break
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS))
        counted = inside(each, todo).withColumn("cell", cell).groupBy("g", "h", "measure", "rank", "cell").agg(F.count("*").alias("size"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = F.sum("size").over(Window.partitionBy("g", "h", "measure", "rank").orderBy("cell"))
        here = counted.withColumn("upto", upto).where("rank < upto and rank >= upto - size")
        state = kept(here.select("g", "h", "measure", F.col("size").alias("n"), F.col("least").alias("low"), F.col("most").alias("high"), (F.col("rank") - F.col("upto") + F.col("size")).alias("rank"), F.col("rank").alias("asked")).drop("asked"), "ranks")
    last = found[0]
    for more in found[1:]:
        last = last.unionByName(more)
    alike = last.where("low = high").select("g", "h", "measure", F.col("low").alias("value"))
    few = inside(each, last.where("low < high")).groupBy("g", "h", "measure", "rank").agg(F.array_sort(F.collect_list("value")).alias("all"))
    middle = alike.union(few.select("g", "h", "measure", F.get("all", F.col("rank").cast("int")))).groupBy("g", "h", "measure").agg(F.avg("value").alias("median"))
    wide = middle.groupBy("g", "h").agg(*(F.max(F.when(F.col("measure") == c, F.col("median"))).alias(f"{c}_median") for c in columns))
    return wide.select(*([F.col(f"g.{b}").alias(b) for b in by]), *(f"{c}_median" for c in columns))


def inside(each: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values in the ranges that are asked for, with low, high and rank."""
    r = ranges.select(F.col("g").alias("rg"), F.col("h").alias("rh"), F.col("measure").alias("rm"), "low", "high", "rank")
    met = each.join(r, (F.col("h") == F.col("rh")) & (F.col("measure") == F.col("rm")) & F.col("value").between(F.col("low"), F.col("high")))
    return met.where(F.col("g").eqNullSafe(F.col("rg"))).drop("rg", "rh", "rm")
