"""Parameter sweeps and campaigns as rows."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.functions.records import parameter_slug, value_slug


def linear(low: float, high: float, step: float | None = None, steps: int | None = None) -> list[float]:
    """Values from low to high: by adding the step again and again, or equally spaced."""
    if step:
        out, value = [], low
        while value <= high + 1e-9:
            out.append(value)
            value += step
        return out
    if steps is None:
        return []
    return [low] if steps == 1 else [low + (high - low) * i / (steps - 1) for i in range(steps)]


def _digits(i: F.Column, sizes: list[int], k: int) -> F.Column:
    """Place of variant i on axis k: the last axis varies fastest."""
    after = 1
    for n in sizes[k + 1 :]:
        after *= n
    return F.floor(i / after) % sizes[k]


def variants(spark: SparkSession, axes: list[tuple[str, list[Any]]], base_seed: int = 42, unlocked: tuple[str, ...] = ()) -> DataFrame:
    """variant_id v000.., ordinal, overrides (map of text), description and a seed for each unlocked aspect.

    All combinations of the axes' values, the last axis fastest; without axes, one variant. Rows are computed from their
    ordinal, so that no product of tables is needed.
    """
    sizes = [len(v) for _, v in axes]
    total = 1
    for n in sizes:
        total *= n
    i = F.col("id")
    texts = [F.element_at(F.array(*(F.lit(x if isinstance(x, str) else json.dumps(x)) for x in values)), (_digits(i, sizes, k) + 1).cast("int")) for k, (_, values) in enumerate(axes)]
    names = [name for name, _ in axes]
    overrides = F.create_map(*(c for n, t in zip(names, texts, strict=True) for c in (F.lit(n), t))) if axes else F.create_map().cast("map<string,string>")
    describe = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), t) for n, t in zip(names, texts, strict=True))) if axes else F.lit("")
    slug = F.concat_ws("__", *(F.concat(parameter_slug(F.lit(n)), F.lit("-"), value_slug(t)) for n, t in zip(names, texts, strict=True))) if axes else F.lit("")
    factors = {"layout": 100, "lighting": 200, "camera": 300}
    seeds = [(F.lit(base_seed) + i * factors[a]).alias(f"{a}_seed") for a in unlocked]
    return spark.range(total).select(i.alias("ordinal"), F.format_string("v%03d", i).alias("variant_id"), overrides.alias("overrides"), describe.alias("description"), slug.alias("slug"), *seeds)


def campaign(spark: SparkSession, explicit: list[tuple[str, dict]], matrices: list[tuple[str, list[tuple[str, list[Any]]]]]) -> DataFrame:
    """(name, overrides) of sub-experiments: explicit ones first, then each matrix's combinations as name__slugs."""
    first = spark.createDataFrame([(i, n, {k: v if isinstance(v, str) else json.dumps(v) for k, v in o.items()}) for i, (n, o) in enumerate(explicit)], "place long, name string, overrides map<string,string>")
    out, start = first, len(explicit)
    for base, axes in matrices:
        own = variants(spark, axes)
        out = out.union(own.select((F.col("ordinal") + start).alias("place"), F.concat(F.lit(f"{base}__"), F.col("slug")).alias("name"), "overrides"))
        start += own.count()
    return out


def scenes(expanded: DataFrame, per_variant: int) -> DataFrame:
    """Each variant's scenes."""
    return expanded.withColumn("scene_id", F.explode(F.sequence(F.lit(0), F.lit(per_variant - 1))).cast("long"))
