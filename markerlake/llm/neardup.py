"""Near duplicates by b-bit MinHash (operator 7).

A document's set is its distinct 5-word shingles. Copies (equal word sequences) meet by a 128-bit fingerprint. Of each
other text, MinHash minima give the keys of bands; the low bits of the minima are kept, packed as bit planes, and their
bit counts estimate the similarity of two texts that share a band. What passes is confirmed on full sets.

Within a band's bucket a member is first held against the smallest member only. A bucket whose members then lie in more
than one component has all its pairs across components estimated: as a join where it is small, else between blocks of
BLOCK members, so that no task takes a whole bucket. With 32 bands of 4 minima, a link at similarity 0.75 shares no band
in 5 of a million cases, and at 0.8 in 5 of a hundred million; an exact way, by shared rare shingles, has no such cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerlake.llm.common import Scratch, arrow_map, texts, words_of
from markerlake.llm.graph import components
from markerlake.llm.pieces import Parts

WORDS = 5
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
PERCENT = 75  # least share of the union, in hundredths
LEAST_ESTIMATE = 0.55  # more than 4 standard errors below 0.75
SMALL, BLOCK = 24, 4096  # members of a bucket that is paired by a join; of a block otherwise
KEPT_WORDS = 100_000  # words whose hashes a task keeps
SENT_IDS = 2_000_000  # ids, of 8 bytes, that are sent to every task at most
MOST_PIVOTS = 50_000  # rows of the list of pivots that have too many partners for one task

_numbers = np.random.Generator(np.random.PCG64(7))
#: 64-bit multipliers (odd) and offsets of the hash functions, two 32-bit minima to each.
MULTIPLY = _numbers.integers(0, 1 << 63, HASHES // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _numbers.integers(0, 1 << 63, HASHES // 2, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """64-bit hashes of the distinct shingles of texts."""

    def __init__(self) -> None:
        self.hash_of = Parts(xxhash.xxh64_intdigest)

    def sets(self, some: list[str], words: int = WORDS) -> list[np.ndarray]:
        """Sorted arrays. A text with fewer words than a shingle is one shingle; without words it has none."""
        out = []
        for text in some:
            found = words_of(text)
            h = np.array(list(map(self.hash_of.__getitem__, found)), np.uint64)
            if len(h) < words:
                value = len(h)
                for x in h.tolist():
                    value = (value * int(BASE) + x) & 0xFFFFFFFFFFFFFFFF
                out.append(mixed(np.array([value], np.uint64)) if len(h) else np.empty(0, np.uint64))
                continue
            n = len(h) - words + 1
            value = h[:n].copy()
            for i in range(1, words):
                value *= BASE
                value += h[i : n + i]
            out.append(np.unique(mixed(value)))
        if len(self.hash_of) > KEPT_WORDS:
            self.hash_of.clear()
        return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 32-bit minima of each set; of an empty set, the largest number."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    held = [i for i, x in enumerate(sets) if len(x)]
    if held:
        flat = np.concatenate([sets[i] for i in held])
        begins = np.cumsum([0, *(len(sets[i]) for i in held[:-1])])
        for lo in range(0, len(begins), 64):  # few at a time: what is multiplied stays in the cache
            first, end = begins[lo], begins[lo + 64] if lo + 64 < len(begins) else len(flat)
            at = begins[lo : lo + 64] - first
            for k in range(HASHES // 2):
                product = flat[first:end] * MULTIPLY[k] + OFFSET[k]
                product ^= product >> np.uint64(32)
                low = np.minimum.reduceat((product & np.uint64(0xFFFFFFFF)).astype(np.uint32), at)
                high = np.minimum.reduceat((product >> np.uint64(32)).astype(np.uint32), at)
                rows = held[lo : lo + 64]
                out[rows, 2 * k], out[rows, 2 * k + 1] = low, high
    return out


def planes(found: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum as bit planes: BITS times HASHES / 64 longs to a text."""
    out = [np.packbits(((found >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little").view("<i8") for b in range(BITS)]
    return np.concatenate(out, axis=1)


def band_keys(found: np.ndarray) -> np.ndarray:
    out = np.empty((len(found), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(found), band + 1, np.uint64)
        for x in found[:, band * ROWS : (band + 1) * ROWS].T:
            value = mixed(value * BASE + x.astype(np.uint64))
        out[:, band] = value
    return out.view(np.int64)


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, copy (fingerprint of the words, null without any), planes, bands of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            some = texts(batch)
            sets = shingler.sets(some)
            found = minima(sets)
            copies = [xxhash.xxh3_128_digest(b" ".join(words_of(x))) if len(s) else None for x, s in zip(some, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(copies, pa.binary()), pa.array(list(planes(found)), pa.list_(pa.int64())), pa.array(list(band_keys(found)), pa.list_(pa.int64()))], ["doc_id", "n_shingles", "copy", "planes", "bands"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, work, "doc_id long, n_shingles long, copy binary, planes array<long>, bands array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two texts' bit planes: equal low bits, less those that are equal by chance."""
    longs = HASHES // 64
    differ = None
    for i in range(longs):
        either = None
        for plane in range(BITS):
            x = F.col(a)[plane * longs + i].bitwiseXOR(F.col(b)[plane * longs + i])
            either = x if either is None else either.bitwiseOR(x)
        n = F.bit_count(either)
        differ = n if differ is None else differ + n
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(HASHES))) - chance) / (1 - chance)


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and set (binary, sorted 64-bit hashes) of the documents whose doc_id is wanted; equal ones once.

    Texts are filtered where they are read while the wanted ids are few enough to be sent to every task; beyond that, ids
    and texts meet by a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in shingler.sets(texts(batch))], pa.binary())], ["doc_id", "set"])

    few = wanted.count() <= SENT_IDS
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return arrow_map(rows, work, "doc_id long, set binary").where(F.length("set") > 0).dropDuplicates(["doc_id", "set"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def with_pivots(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, ..) joined by `a` with rows (a, ..), of which a has few.

    Where more than `line` pairs have one a, they are dealt over several tasks, and that a's row goes to each of them. The
    list of such a is broadcast: it has at most MOST_PIVOTS rows.
    """
    line = max(1024, pairs.count() // MOST_PIVOTS)
    many = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("*") / line).cast("int").alias("ways")).where("ways > 1"))
    left = pairs.join(many, "a", "left").withColumn("way", F.pmod(F.xxhash64("b"), F.coalesce("ways", F.lit(1)))).drop("ways")
    dealt = right.join(many, "a", "left").withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("ways", F.lit(1)).cast("long") - 1))).drop("ways")
    return left.join(dealt, ["a", "way"]).drop("way")


def confirmed(pairs: DataFrame, documents: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full sets hold 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array([linked(*p, percent) for p in zip(x, y, strict=True)], pa.bool_()))

    wanted = scratch.keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = scratch.keep(full_sets(documents, wanted))
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    both = with_pivots(right, sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")))
    return scratch.keep(arrow_map(both.select("a", "b", "x", "y"), work, "a long, b long"))


def likely(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of which the packed low bits say so."""
    right = pairs.join(bits.select(F.col("doc_id").alias("b"), F.col("planes").alias("q")), "b")
    return with_pivots(right, bits.select(F.col("doc_id").alias("a"), F.col("planes").alias("p"))).where(estimate("p", "q") >= least).select("a", "b").distinct()


def across_small(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of rows (key, doc_id, component, planes) that share a key, differ in component and are likely."""
    other = rows.select("key", F.col("doc_id").alias("b"), F.col("component").alias("other"), F.col("planes").alias("q"))
    near = rows.join(other, "key").where("doc_id < b and component <> other").where(estimate("planes", "q") >= least)
    return near.select(F.col("doc_id").alias("a"), "b").distinct()


def across_large(rows: DataFrame, sets: DataFrame, least: float, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) across components among rows (key, n, doc_id, component, planes, bands) that share a key.

    A bucket is dealt out as pairs of blocks of BLOCK members. Within a pair of blocks the likeliest partners come first,
    and what a confirmed link has joined isn't held against each other again; only links leave. Two texts that share
    several buckets meet in the first of them only.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component", "planes", "bands")
    dealt = dealt.join(sets, "doc_id")

    def work(table: pa.Table) -> pa.Table:
        ids, part, own = (np.array(table.column(c).to_numpy()) for c in ("doc_id", "component", "own"))
        bits = np.array(table.column("planes").to_pylist(), np.int64).view(np.uint64).reshape(len(ids), BITS, -1)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        held = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        i, j, key = (table.column(c)[0].as_py() for c in ("i", "j", "key"))
        band = int(np.flatnonzero(bands[0] == key)[0]) if bands.shape[1] else 0
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        chance, found = 2.0**-BITS, []
        for x in left:
            some = right[(part[right] != part[x]) & ((ids[right] > ids[x]) | (i != j))]
            some = some[~(bands[some, :band] == bands[x, :band]).any(axis=1)]
            if not len(some):
                continue
            differ = np.bitwise_count(np.bitwise_or.reduce(bits[some] ^ bits[x], axis=1)).sum(axis=1)
            alike = ((1 - differ / HASHES) - chance) / (1 - chance)
            order = np.argsort(-alike, kind="stable")
            for y in some[order[alike[order] >= least]]:
                if part[x] != part[y] and linked(held[x], held[y], percent):
                    found.append(sorted((int(ids[x]), int(ids[y]))))
                    part[part == part[y]] = part[x]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(work, "a long, b long")


def rarest(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, doc_id: so many of each set's rarest members that two sets which are alike enough always share one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("set").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.int64()), pa.array(own), pa.array([len(own)] * len(own), pa.int64())], ["doc_id", "key", "size"])

    each = arrow_map(sets, work, "doc_id long, key long, size long")
    often = each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")  # what one set alone holds joins nothing
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("often", F.lit(1)), "key"))
    return each.join(often, "key", "left").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).select("key", "doc_id").distinct()


def near_duplicates(documents: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    One row for each row. Null, empty and blank texts have empty sets and are linked with nothing; rows with a null
    doc_id are linked with nothing, have a null component_id and are kept. Rows that repeat a doc_id are one document,
    linked with what any of its texts is linked with. exact: propose pairs by shared rare shingles in place of bands, and
    estimate nothing, so that no link at all can be missed, at several times the shuffle.
    """
    scratch = Scratch(documents.sparkSession, "neardup")
    base = scratch.keep(signed(documents))
    held = base.where(F.col("doc_id").isNotNull() & F.col("copy").isNotNull())
    own = scratch.keep(held.groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("planes").alias("planes"), F.first("bands").alias("bands")))
    copies = own.where("n > 1").select("copy", F.col("doc_id").alias("first"))
    bits = own.select("doc_id", "planes", "bands")
    least = LEAST_ESTIMATE
    rows = own.select(F.explode("bands").alias("key"), "doc_id").distinct()
    if exact:
        rows = scratch.keep(rarest(full_sets(documents, own.select("doc_id").distinct())))
        bits, least = bits.withColumn("bands", F.array().cast("array<long>")), -1.0
    several = held.groupBy("doc_id").agg(F.min("copy").alias("x"), F.max("copy").alias("y")).where("x <> y").select("doc_id")
    same = held.join(several, "doc_id", "left_semi").join(copies, "copy").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))

    buckets = scratch.keep(rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    members = scratch.keep(rows.join(buckets, "key").select("key", "doc_id", "pivot", "n"))
    stars = scratch.keep(members.where("pivot < doc_id").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = confirmed(scratch.keep(likely(stars, bits, least)), documents, scratch).union(same)
    first = components(links, scratch)

    placed = members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = scratch.keep(placed.select("key", "doc_id", "n", "component"))
    open_ = scratch.keep(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    rest = scratch.keep(placed.join(open_, "key", "left_semi").join(bits, "doc_id"))
    small, large = rest.where(F.col("n") <= SMALL), rest.where(F.col("n") > SMALL)
    more = scratch.keep(across_small(small, least))
    more = confirmed(more, documents, scratch) if not more.isEmpty() else more
    if not large.isEmpty():
        more = more.union(scratch.keep(across_large(large, full_sets(documents, large.select("doc_id").distinct()), least)))
    if not more.isEmpty():
        first = components(links.union(more), scratch)

    found = base.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("copy")).alias("copy")).join(copies, "copy", "left").withColumn("first", F.coalesce("first", "doc_id"))
    found = found.select("doc_id", "n_shingles", "first").join(first.withColumnRenamed("node", "first"), "first", "left")
    found = found.withColumn("component_id", F.coalesce("component", "first"))
    return scratch.result(found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def without_copies(documents: DataFrame) -> DataFrame:
    """The rows, with all their columns, of the first document of each group and of all that are in no group."""
    gone = near_duplicates(documents).where("not kept").select("doc_id").distinct()
    few = gone.count() <= SENT_IDS
    return documents.join(F.broadcast(gone) if few else gone, documents["doc_id"].cast("long") == gone["doc_id"], "left_anti")
