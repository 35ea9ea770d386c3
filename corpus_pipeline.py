"""A pipeline over the documents: toxic ones go, near duplicates and leaked benchmark items go, personal data is
redacted, and what is left is encoded. Each stage takes all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markerlake.llm import bpe, decontaminate, neardup, pii, toxicity
from markerlake.llm.common import new_folder, remove, rest, table
from markerlake.llm.queries import BYTE_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that score as toxic go. A null text is scored as an empty one; an empty table stays empty."""
    rest(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the smallest doc_id stays; texts without words are no duplicates."""
    rest(spark)
    return neardup.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go; a null text holds none, without items all stay."""
    rest(spark)
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: spans of personal data are replaced by their kind; a null text stays null."""
    rest(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token counts and digests of the encoded and decoded texts; a null text counts as empty."""
    rest(spark)
    return bpe.digests(docs, BYTE_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: SQL expresses neither the models nor the tokenizer: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`; what a stage wrote goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
