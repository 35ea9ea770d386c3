"""Spelling variants by symmetric deletion (operator 13).

Every word emits a hash of itself and of each of its distinct single deletions; words that share one are candidates. A
pair one edit apart always shares a key: the shorter word is a deletion of the longer, or both lack the replaced code
point. Candidates are then held against each other exactly. Keys are 64-bit polynomial hashes that are taken for all
deletions of a word at once, so a run of letters of any length costs memory in proportion to its length; equal hashes of
different texts only make a candidate more. A key is shared by no more words than an alphabet can insert into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import Scratch, arrow_map

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97  # one run in so many loses a code point
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
BASE = 0x9E3779B97F4A7C15  # odd, so that powers of it never vanish
KEYS_A_BATCH = 1 << 18


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without its code point h % length where SLIP divides h, the crc32 of `<doc_id>:<run>` (null id: empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIP == 0, without).otherwise(run)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n: the words that are long and frequent enough."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))
    each = documents.select("doc_id", F.explode(runs).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    words = each.select(slipped(F.col("doc_id"), F.translate("run", UPPER, LOWER)).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])


def keys_of(word: str, power: np.ndarray) -> np.ndarray:
    """Hashes of the word and of its distinct single deletions; power holds at least as many powers as the word is long.

    Deleting any letter of a stretch of equal letters gives the same text, so only each stretch's first is deleted.
    """
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    here = np.concatenate([[np.uint64(0)], np.cumsum(points * power[:n])])  # of the letters before each place
    shifted = np.concatenate([[np.uint64(0)], np.cumsum(points[1:] * power[: n - 1])])  # of those after it, each one place to the left
    first = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
    gone = here[first] + (shifted[-1] - shifted[first])
    return np.concatenate([here[-1:], gone])


def keyed(words: DataFrame) -> DataFrame:
    """key, id: a row for each word and each distinct deletion of it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = powers(64)
        for batch in batches:
            keys, ids, held = [], [], 0
            for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                if len(word) >= len(power):
                    power = powers(2 * len(word))
                found = keys_of(word, power)
                for lo in range(0, len(found), KEYS_A_BATCH):
                    part = found[lo : lo + KEYS_A_BATCH]
                    keys.append(part)
                    ids.append(np.full(len(part), i, np.int64))
                    held += len(part)
                    if held >= KEYS_A_BATCH:
                        yield pa.RecordBatch.from_arrays([np.concatenate(keys).view(np.int64), np.concatenate(ids)], ["key", "id"])
                        keys, ids, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([np.concatenate(keys).view(np.int64), np.concatenate(ids)], ["key", "id"])

    return arrow_map(words.select("id", "word"), work, "key long, id long")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """id, near_id, both ways: the words (id, word) that are one inserted, deleted or replaced code point apart."""
    keys = scratch.keep(keyed(words))
    shared = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    some = shared.select(F.col("a.id").alias("id"), F.col("b.id").alias("near_id")).distinct()
    left = words.select("id", F.col("word").alias("left_word"))
    right = words.select(F.col("id").alias("near_id"), F.col("word").alias("right_word"))
    near = some.join(left, "id").join(right, "near_id").where(F.levenshtein("left_word", "right_word", 1) == 1)
    one_way = scratch.keep(near.select("id", "near_id"))
    return one_way.union(one_way.select("near_id", "id"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root of the words (id, form) that have a form: the last word that its forms lead to.

    A form is at least twice as frequent, so ways are short and end; each round doubles the steps that a word has taken.
    """
    reached = scratch.keep(forms.select("id", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = scratch.keep(reached.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = step.select("id", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word that is long and frequent enough over all documents.

    Words are the runs of letters (`RUN`) with only A-Z lower-cased, where about one in SLIP has lost a code point. Near
    words are one edit apart. A word's form is its near word of largest n (of equal ones the smallest in code-point
    order) if that has at least twice the word's count, else null; root follows forms to the last, the word itself
    without a form. A null text has no words, a null doc_id counts as the empty text; repeated rows count each; an empty
    table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "spelling")
    words = scratch.keep(word_counts(documents).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = near_pairs(words, scratch)
    of = words.select(F.col("id").alias("near_id"), F.struct((-F.col("n")).alias("less"), F.col("word"), F.col("id")).alias("one"))
    best = near.join(of, "near_id").groupBy("id").agg(F.count("*").alias("n_near"), F.min("one").alias("best"))
    picked = scratch.keep(
        words.join(best, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("best"),
        )
    )
    last = roots(picked.where("best IS NOT NULL").select("id", F.col("best.id").alias("form")), scratch)
    named = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return scratch.result(
        picked.join(named, "id", "left").select(
            "word", F.col("best.word").alias("form"), F.coalesce("root_word", "word").alias("root"),
            "n", "n_near", (-F.col("best.less")).alias("form_n"),
        )
    )
