"""Byte-pair encoding and decoding of whole texts (operator 4), by tree concatenation; see pieces.py."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import arrow_map, read_only, texts
from markerlake.llm.pieces import Codec, codec


def encode_batch(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, ids and n_tokens of a batch with doc_id and text."""
    ids = [own.encode(x) for x in texts(batch)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])


def decode_batch(own: Codec, decimal: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, text, n_tokens and ids_sha256 of a batch of encode_batch(). decimal: each id in decimal digits."""
    found = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
    shown = [hashlib.sha256(",".join([decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in found]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x) for x in found], pa.string()), batch.column("n_tokens"), pa.array(shown, pa.string())], ["doc_id", "text", "n_tokens", "ids_sha256"])


def encode(documents: DataFrame, tokenizer: str, special: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and n_tokens of every row's whole text.

    Null and empty texts give no ids. Repeated rows and null ids of documents are kept as they are; other columns are
    left out, whatever their names. special: whether strings of special tokens become those tokens.
    """
    read_only(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, special)
        for batch in batches:
            yield encode_batch(own, batch)

    return arrow_map(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, n_tokens and ids_sha256 (lowercase hex of the decimal ids joined by commas) of rows of encode()."""
    read_only(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        decimal = [str(i) for i in range(len(own.bytes_of))]
        for batch in batches:
            yield decode_batch(own, decimal, batch)

    return arrow_map(encoded.select("doc_id", "ids", "n_tokens"), work, "doc_id long, text string, n_tokens long, ids_sha256 string")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of decode(encode(documents)), by one worker a task in place of two: ids stay in it, and one codec serves both ways."""
    read_only(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        decimal = [str(i) for i in range(len(own.bytes_of))]
        for batch in batches:
            yield decode_batch(own, decimal, encode_batch(own, batch))

    return arrow_map(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, text string, n_tokens long, ids_sha256 string")


def digests(documents: DataFrame, tokenizer: str) -> DataFrame:
    """What encode() and decode() return, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(documents, tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
