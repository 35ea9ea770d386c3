"""Token counts of documents in flat token files without an index (operator 8), by a separator scan.

A flat file is a run of 16-bit ids in which an end-of-document id follows each document. It is cut into blocks of one
size, wherever documents end. The scan looks for the end id in a whole block at once; a prefix scan over the blocks of
a file adds to the first document of a block what earlier blocks hold of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markerlake.llm.common import arrow_map, new_folder, read_only
from markerlake.llm.pieces import codec

BLOCK_IDS = 1 << 20
END_ID = 50256  # of byte_bpe_50k.json; texts are encoded so that no text holds it

SCHEMA = "shard int, block int, tokens binary, names array<long>"


def write_flat(documents: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write flat token files: one for each partition of the documents, in its order; a file's blocks share `shard`.

    names, apart from the tokens, holds the ids of the documents that end in a block. Null texts are empty documents,
    null doc_ids stay null, repeated doc_ids are documents of their own. Nothing is shuffled.
    """
    read_only(tokenizer)
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("tokens", pa.binary()), ("names", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = codec(tokenizer, special=False), TaskContext.get().partitionId()
        if max(len(own.bytes_of), end_id + 1) > 1 << 16:
            raise ValueError("ids of two bytes hold vocabularies of up to 65,536 entries")
        end, width = np.array([end_id], "<u2"), 2 * block_ids
        kept, block = bytearray(), 0
        ends: list[tuple[int | None, int]] = []  # documents and where they end, in bytes from the start of `kept`

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, block, ends
            while len(kept) >= width or (last and kept):
                names = [x for x, at in ends if at <= width]
                yield pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "tokens": bytes(kept[:width]), "names": names}], schema=arrow)
                kept, block, ends = kept[width:], block + 1, [(x, at - width) for x, at in ends[len(names) :]]

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                kept += np.frombuffer(own.encode(text or ""), "<u4").astype("<u2").tobytes() + end.tobytes()
                ends.append((name, len(kept)))
                if len(kept) >= width:
                    yield from rows(last=False)
        yield from rows(last=True)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    arrow_map(rows, work, SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def scan(tokens: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    """Lengths of the pieces that end in a block, without their end ids, and how many ids follow the last end."""
    at = np.flatnonzero(tokens == end_id)
    return np.diff(at, prepend=-1) - 1, len(tokens) - (int(at[-1]) + 1 if len(at) else 0)


def count(spark: SparkSession, folder: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and n_tokens, without the end id, of every document in flat files."""
    files = spark.read.schema(SCHEMA).parquet(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(np.frombuffer(x, "<u2"), end_id) for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("block"), batch.column("names"), pa.array([x.tolist() for x, _ in found], pa.list_(pa.int64())), pa.array([t for _, t in found], pa.int64())], ["shard", "block", "names", "lengths", "tail"])

    blocks = arrow_map(files, work, "shard int, block int, names array<long>, lengths array<long>, tail long")
    # ids between the last end before a block and the block: tails add up since the last block that has an end
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("shard", "ended").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumn("ended", F.coalesce(F.sum((F.size("lengths") > 0).cast("int")).over(earlier), F.lit(0)))
    # the tail of the block that ended a document belongs to the next run: take it from the row before
    before = Window.partitionBy("shard").orderBy("block")
    stitched = marked.withColumn("left", F.coalesce(F.lag("tail").over(before), F.lit(0)))
    stitched = stitched.withColumn("carry", F.sum("left").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    each = stitched.select("carry", F.posexplode(F.arrays_zip("names", "lengths")).alias("i", "x"))
    return each.select(F.col("x.names").alias("doc_id"), (F.col("x.lengths") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def document_counts(documents: DataFrame, tokenizer: str, folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the flat files and count from them alone."""
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "flat")
    write_flat(documents, tokenizer, folder, block_ids=block_ids)
    return count(spark, folder)
