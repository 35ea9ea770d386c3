"""Token files under Re-Pair grammars (operator 6).

Documents are encoded in ascending order of doc_id and cut into blocks. In each block, frequent pairs of ids are
replaced by new symbols, round after round, until none is left that is worth a rule; a block holds its rules, the lengths to which symbols expand, the remaining
sequence, and the ids and lengths of its documents, so that any range can be decoded without the rest. Blocks are rows
of a Parquet table: it can lie in any store that Spark reaches, and lost tasks write theirs anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markerlake.llm.common import arrow_map, new_folder, partitions, read_only
from markerlake.llm.pieces import codec

AT_ONCE = 256  # documents whose range is decoded together
BLOCK_IDS = 1 << 21  # ids after which a block ends, at the end of a document
#: Occurrences from which a pair is worth a rule: one takes 12 bytes (two symbols and a length) and must save as much again,
#: at 4 bytes an occurrence.
LEAST_COUNT = 6
#: The first round takes pairs that occur this many times as often: they lose fewer occurrences to rare neighbours.
FIRST = 5
MIX = np.array([0x9E3779B1, 0x85EBCA6B], np.uint32)  # odd multipliers: ties between pairs are broken by a hash of both symbols
AT_LEAST = 4 << 20  # bytes of text that are encoded together

SCHEMA = "shard int, block int, doc_ids array<long>, lengths binary, symbols long, rules binary, expansions binary, sequence binary, n_ids long"


def compress(ids: np.ndarray, symbols: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Rules, as rows of two symbols each, and the remaining sequence. Rule i makes the symbol `symbols` + i.

    In each round all pairs that occur `least` times or more are replaced side by side, until there is none; the first
    round takes only those that occur FIRST times as often. Where occurrences touch, the more frequent pair goes first,
    among equally frequent ones the same everywhere, so that copies of a passage are replaced alike. A pair that loses
    too many of its occurrences to its neighbours waits for the next round, so every rule is used `least` times at least.
    """
    sequence, rules, top = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)], symbols
    near, most = np.arange(len(sequence) - 1), FIRST * least  # positions whose pair may be frequent
    while True:
        pairs, n, near, which = frequent(sequence, near, top, most)
        if not len(near):
            if most == least:
                break
            near, most = np.arange(len(sequence) - 1), least
            continue
        rank = np.empty(len(n), np.int32)
        rank[np.lexsort(((pairs * MIX).sum(axis=1, dtype=np.uint32), n))] = np.arange(len(n))
        often = rank[which]
        taken = apart(near, often)
        chosen = np.bincount(which[taken], minlength=len(pairs)) >= least
        if chosen.any():
            taken = taken[chosen[which[taken]]]
        else:  # all lose occurrences to each other: the most frequent pair alone can't
            chosen[n.argmax()] = True
            taken = np.flatnonzero(chosen[which])
            taken = taken[apart(near[taken], often[taken])]
        at = near[taken]
        sequence[at] = (top - 1 + np.cumsum(chosen))[which[taken]]
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        rules.append(pairs[chosen])
        top += len(rules[-1])
        if most > least:
            near, most = np.arange(len(sequence) - 1), least
        else:  # other pairs are not frequent, and counts of pairs without a new symbol only fall
            may = np.zeros(len(keep), bool)
            may[near] = True
            may = may[keep]
            near = np.flatnonzero(may[:-1] | may[1:])
    return np.concatenate(rules), sequence


def frequent(sequence: np.ndarray, near: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of symbols below `top` that begin at `least` of the ascending positions or more, of which no two of one pair
    overlap; at how many each does; all positions where they begin, and the numbers of their pairs."""
    bits, places = np.uint64(int(top).bit_length()), np.uint64(len(near).bit_length())
    whole = len(near) == len(sequence) - 1
    key = (sequence[:-1] if whole else sequence[near]).astype(np.uint64)
    key <<= bits
    key |= sequence[1:] if whole else sequence[near + 1]
    if 2 * bits + places <= 64:  # pair and place sort as one number, far faster than by argsort
        key <<= places
        key |= np.arange(len(near), dtype=np.uint64)
        key.sort()
        place = (key & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int32 if places < 32 else np.int64)
        key >>= places
    else:
        place = np.argsort(key, kind="stable")
        key = key[place]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n = np.diff(begins, append=len(key))
    many = n >= least
    which = np.empty(len(near), np.int32)
    which[place] = np.repeat(np.where(many, np.cumsum(many) - 1, -1).astype(np.int32), n)
    kept, key, n = np.flatnonzero(which >= 0), key[begins[many]], n[many]
    near, which = near[kept], which[kept]
    again = np.flatnonzero((near[1:] - near[:-1] == 1) & (which[1:] == which[:-1])) + 1  # in a run of one symbol
    n -= np.bincount(which[again[every_second(again)]], minlength=len(n))
    many = n >= least
    if not many.all():
        kept = np.flatnonzero(many[which])
        near, which, key, n = near[kept], (np.cumsum(many) - 1)[which[kept]], key[many], n[many]
    return np.stack([key >> bits, key & ((np.uint64(1) << bits) - np.uint64(1))], axis=1).astype(np.uint32), n, near, which


def apart(at: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which of the ascending positions are taken so that no two are neighbours: peaks of `often` first, then every second
    one of what is left between them.
    """
    joined = at[1:] - at[:-1] == 1
    taken = np.ones(len(at), bool)
    taken[1:] = ~joined | (often[1:] > often[:-1])
    taken[:-1] &= ~joined | (often[:-1] > often[1:])
    free = ~taken
    free[1:] &= ~(taken[:-1] & joined)
    free[:-1] &= ~(taken[1:] & joined)
    rest = np.flatnonzero(free)
    taken[rest[every_second(at[rest])]] = True
    return np.flatnonzero(taken)


def every_second(at: np.ndarray) -> np.ndarray:
    """Of ascending positions, the first, third, fifth and so on of each run of neighbours."""
    first = np.ones(len(at), bool)
    first[1:] = at[1:] - at[:-1] != 1
    place = np.arange(len(at))
    return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0


def expansion_lengths(rules: np.ndarray, symbols: int) -> np.ndarray:
    """To how many ids each rule's symbol expands."""
    out = [1] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (1 if a < symbols else out[a - symbols]) + (1 if b < symbols else out[b - symbols])
    return np.array(out, np.uint32)


def expand(sequence: np.ndarray, rules: np.ndarray, symbols: int, expansions: np.ndarray | None = None) -> np.ndarray:
    """The ids that a sequence stands for: each round puts both symbols of the rules that the last one put in their places."""
    known = expansion_lengths(rules, symbols) if expansions is None else expansions

    def sizes(some: np.ndarray) -> np.ndarray:
        out, wide = np.ones(len(some), np.int64), some >= symbols
        out[wide] = known[some[wide] - symbols]
        return out

    first, second, step = rules[:, 0].copy(), rules[:, 1].copy(), sizes(rules[:, 0])
    ends = np.cumsum(sizes(sequence))
    out, some, at = np.empty(ends[-1] if len(ends) else 0, np.uint32), sequence, np.append(0, ends)[:-1]
    while len(some):
        out[at] = some  # what a rule stands for takes its place in the next round
        wide = np.flatnonzero(some >= symbols)
        rule, at = some[wide] - symbols, at[wide]
        some, at = np.concatenate([first[rule], second[rule]]), np.concatenate([at, at + step[rule]])
    return out


class Block:
    """A block of which any range of ids can be decoded from the few symbols of its sequence that cover it."""

    def __init__(self, block: dict) -> None:
        self.symbols = int(block["symbols"])
        self.rules, self.sequence = np.frombuffer(block["rules"], "<u4").reshape(-1, 2), np.frombuffer(block["sequence"], "<u4")
        self.expansions = np.frombuffer(block["expansions"], "<u4")
        lengths = np.concatenate([np.ones(self.symbols, np.int64), self.expansions])
        self.ends = np.cumsum(lengths[self.sequence])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids [start, stop)."""
        if start >= stop:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, stop, side="left") + 1
        before = int(self.ends[i - 1]) if i else 0
        return expand(self.sequence[i:j], self.rules, self.symbols, self.expansions)[start - before : stop - before]


def write(documents: DataFrame, tokenizer: str, folder: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Write the token files of whole texts in ascending doc_id order, `end_id` after each document.

    Null texts are empty; null doc_ids come first; rows that repeat a doc_id are documents of their own. A folder
    without any rows is written for an empty table.
    """
    read_only(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = codec(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        symbols = len(own.bytes_of)
        names: list[int | None] = []
        parts: list[bytes] = []
        size = block = 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            rules, sequence = compress(ids, symbols)
            lengths = np.array([len(x) // 4 for x in parts], "<u4")
            values = [shard, block, names, lengths.tobytes(), symbols, rules.tobytes(), expansion_lengths(rules, symbols).tobytes(), sequence.astype("<u4").tobytes(), len(ids)]
            return pa.RecordBatch.from_pylist([dict(zip(("shard", "block", "doc_ids", "lengths", "symbols", "rules", "expansions", "sequence", "n_ids"), values, strict=True))], schema=arrow)

        arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("symbols", pa.int64()), ("rules", pa.binary()), ("expansions", pa.binary()), ("sequence", pa.binary()), ("n_ids", pa.int64())])
        for batch in together(batches, AT_LEAST):
            flat, sizes = own.words.encode(batch.column("text"))
            raw, cuts = flat.tobytes(), np.append(0, np.cumsum(sizes) * 4).tolist()
            for i, name in enumerate(batch.column("doc_id").to_pylist()):
                names.append(name)
                parts.append(raw[cuts[i] : cuts[i + 1]] + end)
                size += len(parts[-1]) // 4
                if size >= block_ids:
                    yield row()
                    names, parts, size, block = [], [], 0, block + 1
        if names:
            yield row()

    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(partitions(documents.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")  # null or repeated ids may fill several tasks
    arrow_map(ordered, work, SCHEMA).write.mode("overwrite").parquet(folder)


def together(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `least` bytes or more, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens (with the end id), ids_crc32, and ids (binary, unless left out) of every document in token
    files. Null and repeated doc_ids come back as they were written; an empty folder gives no rows."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block")
    blocks = files.select("shard", "block", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("block_start"))
    starts = blocks.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                own, named = Block(block), block["doc_ids"]
                lengths = np.frombuffer(block["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                for i in range(0, len(ends), AT_ONCE):
                    first = int(ends[i] - lengths[i])
                    ids = own.ids(first, int(ends[min(i + AT_ONCE, len(ends)) - 1])).astype("<u4").tobytes()
                    cuts = [((int(e - n) - first) * 4, (int(e) - first) * 4) for e, n in zip(ends[i : i + AT_ONCE], lengths[i : i + AT_ONCE], strict=True)]
                    m = len(cuts)
                    yield pa.RecordBatch.from_arrays([pa.array([block["shard"]] * m, pa.int32()), pa.array([block["block"]] * m, pa.int32()), pa.array(named[i : i + m], pa.int64()), pa.array((ends - lengths)[i : i + m], pa.int64()), pa.array(lengths[i : i + m], pa.int64()), pa.array([ids[p:q] if with_ids else None for p, q in cuts], pa.binary()), pa.array([zlib.crc32(ids[p:q]) for p, q in cuts], pa.int64())], ["shard", "block", "doc_id", "inside", "n_tokens", "ids", "ids_crc32"])

    found = arrow_map(files.drop("n_ids"), work, "shard int, block int, doc_id long, inside long, n_tokens long, ids binary, ids_crc32 long")
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids", "ids_crc32")


def digests(documents: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 of each document.

    A null text is a document of the end id alone; null doc_ids come first; an empty table gives no rows."""
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "repair")
    write(documents, tokenizer, folder)
    return read(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
