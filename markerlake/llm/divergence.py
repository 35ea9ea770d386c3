"""Source divergence audit: how the words of each source depart from other sources and from its language (operator 11).

Pairs of sources: a term that a source never has shares one smoothed value, its baseline, with all others it lacks. So a
divergence over all kept terms is V times the value of both baselines, corrected by the terms that occur: on one side by
how many terms have each count, on both sides by a join of the terms that two sources share. Ranks of terms: histograms
over the bits of the values, most significant first, narrow each group's list down to its kth value, and histograms over
the bytes of the terms settle the ties there. Only sums and cells meet in one task, never a group's terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerlake.llm.common import Scratch, arrow_map, partitions

SCALE = 1_000_000_000
LEAST_DOCUMENTS, RANKS = 3, 200
HELD_TERMS = 400_000  # terms that a task counts before it hands them on
BITS, TOP = 15, 60  # of a digit; of the largest value, below SCALE squared
BROADCAST_GROUPS = 100_000  # groups, of under 100 bytes unless their names are long, that are sent to every task at most
SOURCES_A_SALT = 256  # sources that share a term and are paired in one place

#: Bytes to themselves, A-Z to a-z, all that is no part of a term to a space.
FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))
GROUP = ["lang", "source"]


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); a row with a null term for each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (often, docs) in counts.items():
                terms = [None, *often]
                columns = [
                    pa.array([lang] * len(terms), pa.binary()).cast(pa.string()), pa.array([source] * len(terms), pa.binary()).cast(pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *often.values()], pa.int64()), pa.array([0, *(docs[x] for x in often)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            counts.clear()

        held = 0
        for batch in batches:
            rows = zip(*(batch.column(x).cast(pa.binary()).to_pylist() for x in ("lang", "source", "text")))
            for lang, source, text in rows:
                often, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                found = text.translate(FOLD).split()
                before = len(often)
                often.update(found)
                docs.update(set(found))
                held += len(often) - before
                if held >= HELD_TERMS:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    whole = documents.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")))
    return arrow_map(whole, work, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)), without rounding."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))


def departure(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def attach(rows: DataFrame, few: DataFrame, on: list[str], n: int, salt: str) -> DataFrame:
    """rows joined with the `n` rows of `few`: sent to every task if they are few enough, else over salted keys, so that
    rows of one key don't meet in one task."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(few), on)
    k = partitions(rows.sparkSession)
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(k)).cast("int")).join(spread, [*on, "salt"]).drop("salt")


def cells(rows: DataFrame, order: Column) -> DataFrame:
    """The cell (cell, high, need, ... per group) in which a group's `need` rows end, with what is still needed of it."""
    counted = rows.groupBy(*GROUP, "base", "need", "cell").agg(F.count("*").alias("size"))
    upto = counted.withColumn("upto", F.sum("size").over(Window.partitionBy(*GROUP).orderBy(order)))
    ends = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("size") < F.col("need")))
    return ends.withColumn("need", F.col("need") - F.col("upto") + F.col("size"))


def last_of(rows: DataFrame, groups: DataFrame, n_groups: int, k: int, scratch: Scratch) -> DataFrame:
    """lang, source, least, last: where the first k rows (lang, source, key, value) of a group end, by value descending
    and key ascending. Rows of a larger value are in, of an equal one those whose key begins with `last` or less; groups
    with at most k rows aren't listed. Keys are binary, none begins with another, and distinct within a group.
    """
    done = []
    state = groups.select(*GROUP, F.lit(0).cast("long").alias("base"), F.lit(k).cast("long").alias("need"))
    for shift in range(TOP - BITS, -1, -BITS):
        inside = attach(rows, state, GROUP, n_groups, "key").where(F.shiftright("value", shift + BITS) == F.col("base"))
        state = scratch.keep(cells(inside.withColumn("cell", F.shiftright("value", shift)), F.col("cell").desc()))
        done.append(state.where("size = need").select(*GROUP, F.shiftleft("cell", shift).alias("least"), F.lit(b"").alias("last")))
        state = state.where("size > need").select(*GROUP, F.col("cell").alias("base"), "need")
        if state.isEmpty():
            break
    ties = state.select(*GROUP, F.col("base").alias("least"), F.lit(b"").alias("base"), "need")
    while not ties.isEmpty():
        equal = attach(rows, ties, GROUP, n_groups, "key").where("value = least AND substring(key, 1, length(base)) = base")
        ends = equal.groupBy(*GROUP, "least", "need").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        # All keys of the cell share what its first and last share: the next two bytes tell some of them apart.
        same = "aggregate(sequence(1, least(length(lo), length(hi))), 0, (a, i) -> IF(a = i - 1 AND substring(lo, i, 1) = substring(hi, i, 1), i, a))"
        begun = scratch.keep(ends.select(*GROUP, "least", "need", F.expr(f"substring(lo, 1, {same})").alias("base")))
        inside = attach(rows, begun, GROUP, n_groups, "key").where("value = least AND substring(key, 1, length(base)) = base")
        digit = F.expr("substring(key, 1, length(base) + 2)")
        ends = scratch.keep(cells(inside.withColumn("cell", digit), F.col("cell").asc()).join(begun.select(*GROUP, "least"), GROUP))
        done.append(ends.where("size = need").select(*GROUP, "least", F.col("cell").alias("last")))
        ties = ends.where("size > need").select(*GROUP, "least", F.col("cell").alias("base"), "need")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def first_ranks(rows: DataFrame, groups: DataFrame, n_groups: int, k: int, scratch: Scratch) -> DataFrame:
    """The rows (lang, source, item, value) of each group's first k ranks, by value descending and item ascending."""
    keyed = rows.withColumn("key", F.concat(F.col("item").cast("binary"), F.lit(b"\0\0")))
    ends = scratch.keep(last_of(keyed, groups, n_groups, k, scratch))
    bounds = groups.join(ends, GROUP, "left").select(*GROUP, F.coalesce("least", F.lit(-1)).alias("least"), F.coalesce("last", F.lit(b"")).alias("last"))
    inside = attach(keyed, bounds, GROUP, n_groups, "key").where("value > least OR value = least AND substring(key, 1, length(last)) <= last")
    return inside.select(*GROUP, "item", "value")


def pair_values(terms: DataFrame, groups: DataFrame, n_groups: int, scratch: Scratch) -> DataFrame:
    """lang, source, item, value for every two sources of a language."""
    g = groups.select("lang", "source", F.col("base").alias("b"), "v")
    h = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("c"))
    plain = g.join(h, "lang").where("source <> item").select("lang", "source", "item", F.expr("v * IF(v = 0, 0, (b - c) * (b - c) div c)").alias("value"))
    # One side: terms of the same count have the same value, so only how many there are of each is paired.
    alike = scratch.keep(terms.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("k")))
    n = partitions(terms.sparkSession)
    salted = alike.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(n)).cast("int"))
    others = h.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = salted.join(others, ["lang", "salt"]).where("source <> item")
    both = departure(F.col("base"), F.col("c"))
    ours = met.select("lang", "source", "item", (F.col("k") * (departure(F.col("p"), F.col("c")) - both)).alias("value"))
    back = departure(F.col("c"), F.col("base"))
    theirs = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * (departure(F.col("c"), F.col("p")) - back)).alias("value"))
    # Both sides: terms that both have. A term's sources are dealt to as many places as there are hundreds of them.
    salts = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES_A_SALT).cast("int").alias("salts"))
    sides = attach(terms, salts, ["lang"], n_groups, "term")
    left = sides.select("lang", "term", "source", "p", F.col("base").alias("b"), F.pmod(F.xxhash64("source"), F.col("salts")).cast("int").alias("salt"))
    right = sides.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("c"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    p, q, b, c = map(F.col, "pqbc")
    shared = left.join(right, ["lang", "term", "salt"]).where("source <> item").select(
        "lang", "source", "item", (departure(p, q) - departure(p, c) - departure(b, q) + departure(b, c)).alias("value")
    )
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (ours, theirs, shared)]
    return plain.union(parts[0]).union(parts[1]).union(parts[2]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    Null text, lang and source count as empty. Terms are runs of letters and of code points from U+0080 on, only A-Z
    lower-cased; a language keeps those in at least LEAST_DOCUMENTS of its rows (repeated rows count each). Part `pair`
    ranks all other sources of the language, part `term` the first RANKS terms that the source has more often than its
    language. A language without kept terms has pairs of value 0; one source alone has no pairs; an empty table gives no
    rows. Other columns are ignored. Values are exact.
    """
    scratch = Scratch(documents.sparkSession, "divergence")
    counts = scratch.keep(term_counts(documents).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    named = counts.where("term IS NOT NULL").withColumns({"all_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term)})
    kept = scratch.keep(named.where(F.col("all_docs") >= LEAST_DOCUMENTS).select(*GROUP, "term", "n", "all_n"))
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    sizes = kept.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    every = counts.where("term IS NULL").select(*GROUP)
    groups = scratch.keep(
        every.join(totals, GROUP, "left").join(sizes, "lang", "left")
        .select(*GROUP, *(F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "v", "lang_total")))
        .withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(1)))
    )
    n_groups = groups.count()
    terms = scratch.keep(
        attach(kept, groups, GROUP, n_groups, "term").select(
            *GROUP, "term", "base", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("v")).alias("q")
        )
    )
    pairs = pair_values(terms, groups, n_groups, scratch).withColumn("part", F.lit("pair"))
    over = scratch.keep(terms.where("p > q").select(*GROUP, F.col("term").alias("item"), departure(F.col("p"), F.col("q")).alias("value")))
    best = first_ranks(over, groups.select(*GROUP), n_groups, RANKS, scratch).withColumn("part", F.lit("term"))
    order = Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), F.asc("item"))
    both = pairs.unionByName(best).withColumn("rank", F.row_number().over(order))
    return scratch.result(both.select(*GROUP, "part", "item", "value", "rank"))
