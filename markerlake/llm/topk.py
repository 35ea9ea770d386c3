"""Exact top-k search by inner product (operator 1), term at a time.

Candidates are packed into blocks; a block keeps, for each term (component), a posting list of rows and weights. A
block of sparse query rows goes through its terms one by one and scatters query weight times posting weight into a
dense score array. Partition selection keeps each query's best rows of a block, and a window merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerlake.llm.common import arrow_map, partitions

CANDIDATES = 8192  # rows in a block of candidates, at most
BLOCKS = 4  # blocks of candidates to a partition, at least, while a block keeps 64 rows
QUERIES = 1024  # rows in a block of queries
AT_ONCE = 32  # queries whose score arrays are held together


def usable(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def pack(ids: np.ndarray, rows: list[list[int]]) -> dict:
    """Rows as postings ordered by term: term and row of each weight that isn't 0."""
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    term = np.concatenate([np.arange(len(x)) for x in rows]) if rows else np.empty(0, np.int64)
    weight = np.array([y for x in rows for y in x], np.int64)
    order = np.lexsort((at, term))
    order = order[weight[order] != 0]
    return {"n": len(ids), "ids": ids.astype("<i8").tobytes(), "terms": term[order].astype("<i4").tobytes(), "at": at[order].astype("<i4").tobytes(), "weights": weight[order].astype("<i8").tobytes()}


def postings(block: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    term, at, weight = np.frombuffer(block["terms"], "<i4"), np.frombuffer(block["at"], "<i4"), np.frombuffer(block["weights"], "<i8")
    found, begins = np.unique(term, return_index=True)
    ends = [*begins[1:], len(term)]
    return {int(t): (at[i:j], weight[i:j]) for t, i, j in zip(found, begins, ends, strict=True)}


def best(queries: dict, candidates: dict, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query of a block: its place there, its k best candidates of another block, their scores; ties to smaller
    ids. Candidates lie in ascending order of id.
    """
    n, ids = candidates["n"], np.frombuffer(candidates["ids"], "<i8")
    lists, wanted, own = postings(candidates), postings(queries), np.frombuffer(queries["ids"], "<i8")
    # four bytes a score where no sum can need more
    most = sum(int(np.abs(w).max()) * int(np.abs(lists[t][1]).max()) for t, (_, w) in wanted.items() if t in lists)
    kind = np.int32 if most < 1 << 31 else np.int64
    lists = {t: (at, weights.astype(kind)) for t, (at, weights) in lists.items()}
    for i in range(0, queries["n"], AT_ONCE):
        scores = np.zeros((min(AT_ONCE, queries["n"] - i), n), kind)
        for term, (rows, weights) in wanted.items():
            if term not in lists:
                continue
            lo, hi = np.searchsorted(rows, [i, i + AT_ONCE])
            at, posted = lists[term]
            for q, w in zip((rows[lo:hi] - i).tolist(), weights[lo:hi].tolist(), strict=True):
                if len(at) == n:
                    scores[q] += kind(w) * posted
                else:
                    scores[q, at] += kind(w) * posted
        for q, row in enumerate(scores):
            others = np.flatnonzero(ids != own[i + q])
            values = row[others]
            if len(values) > k:
                line = -np.partition(-values, k - 1)[k - 1]
                above = np.flatnonzero(values > line)
                keep = np.concatenate([above, np.flatnonzero(values == line)[: k - len(above)]])
                others, values = others[keep], values[keep]
            yield i + q, ids[others], values.astype(np.int64)


def search(candidates: DataFrame, queries: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k highest integer inner products, ties to smaller vec_id.

    Both frames need vec_id and embedding. Components x count as floor(scale * x); vectors of different lengths meet in
    the components that both have. Vectors that are null or hold null or non-finite components, and null ids, take no
    part. A candidate with the query's own id is not its partner, which holds for all
    rows that repeat that id. Repeated rows are candidates and queries of their own: a
    query row that is there twice has its k rows twice. An empty table gives no rows.

    Queries go to every partition, candidates to one each; blocks are dealt in turn, and there are several to a partition
    so that none has much more work than another.
    """
    spark, buckets = candidates.sparkSession, partitions(candidates.sparkSession)
    size = max(min(64, CANDIDATES), min(CANDIDATES, -(-candidates.count() // (BLOCKS * buckets))))

    def prepared(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("row"))

    def packed(rows: int) -> object:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, blocks = TaskContext.get().partitionId(), 0
            ids: list[int] = []
            kept: list[list[int]] = []

            def row() -> pa.RecordBatch:
                order = np.argsort(np.array(ids, np.int64), kind="stable")
                block = pack(np.array(ids, np.int64)[order], [kept[i] for i in order])
                return pa.RecordBatch.from_pylist([block | {"block": (part << 32) + blocks}], schema=arrow)

            for batch in batches:
                ids += batch.column("vec_id").to_pylist()
                kept += batch.column("row").to_pylist()
                while len(ids) >= rows:
                    rest = ids[rows:], kept[rows:]
                    ids, kept = ids[:rows], kept[:rows]
                    yield row()
                    (ids, kept), blocks = rest, blocks + 1
            if ids:
                yield row()

        return work

    arrow = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("at", pa.binary()), ("weights", pa.binary())])
    schema = "block long, n long, ids binary, terms binary, at binary, weights binary"
    fields = ("n", "ids", "terms", "at", "weights")
    blocks = arrow_map(prepared(candidates), packed(size), schema).select(F.pmod(F.shiftright("block", 32) * 31 + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(buckets)).cast("int").alias("bucket"), *(F.col(x).alias(f"c_{x}") for x in fields))
    asked = arrow_map(prepared(queries), packed(QUERIES), schema).select(F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), *(F.col(x).alias(f"q_{x}") for x in fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.slice(i, 1).to_pylist()[0]
                found = list(best({x: pair[f"q_{x}"] for x in fields}, {x: pair[f"c_{x}"] for x in fields}, k))
                sizes = [len(x) for _, x, _ in found]
                at = np.repeat(np.array([q for q, _, _ in found], np.int64), sizes)
                ids = np.frombuffer(pair["q_ids"], "<i8")[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pair["q_block"])), pa.array(at), pa.array(ids), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["block", "place", "query_id", "vec_id", "score"])

    # as many partitions as asked for: what they hold is work, not bytes
    near = arrow_map(asked.repartition(buckets, "bucket").join(blocks.repartition(buckets, "bucket"), "bucket").drop("bucket"), work, "block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
