"""Toxicity of whole texts by class-conditional Kneser-Ney models of characters in words (operator 5).

Two models of the fifth character given four, one of toxic and one of ordinary texts, discount their own counts and back
off to one shared Kneser-Ney model of continuation counts, so that an expression that neither has seen tells nothing and
a new form of a known one still does. A word's evidence is the difference of its log-likelihoods; a text's features are
its strongest words' evidence, whole and by length, and that of the whole text by length. A logistic curve, fitted on
labelled texts that the models have not seen, makes the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import arrow_map, crc32_mod, keep_rows, texts

ORDER, BITS = 5, 12  # characters in a gram; bits of a character
PAD, LAST = 1, 2
DISCOUNT = 0.75
THRESHOLD = 0.3
#: Labelled rows of each class that the models and the curve learn from: a bounded sample, by hash of doc_id.
TOXIC_ROWS, ORDINARY_ROWS = 8_000, 16_000
FEATURES = 6
KEPT_WORDS = 120_000  # words whose evidence a task keeps
EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))  # ASCII punctuation


def lower_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of order 5 of words, each framed by pads and an end; where each word's grams begin."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = b"\n".join(words) + b"\n"  # no word holds white space
    flat = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = flat == ord("\n")
    sizes = np.diff(np.flatnonzero(ends), prepend=-1)
    at = np.arange(len(flat)) + (ORDER - 1) * (np.cumsum(ends) - ends + 1)
    key = np.full(at[-1] + 1, PAD, np.uint64)
    key[at] = np.where(ends, LAST, np.where(flat < 2048, flat, 2048 + flat % np.uint64(2039)))
    framed = key.copy()
    for i in range(1, ORDER):
        key[i:] |= framed[:-i] << np.uint64(BITS * i)
    return key[at], np.cumsum(sizes) - sizes


def low(keys: np.ndarray, order: int) -> np.ndarray:
    """The last `order` characters of grams."""
    return keys & np.uint64((1 << (BITS * order)) - 1)


@dataclass
class Models:
    """Both models as sorted keys and values; the curve's weights come last."""

    keys: list[np.ndarray]  # of orders 1 .. 5
    share: list[np.ndarray]  # discounted share of a gram after its context: orders 1 .. 4; order 5: a row for each class
    context: list[np.ndarray]  # keys of contexts: of orders 2 .. 5
    left: list[np.ndarray]  # what a context leaves to the lower order
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Of each word: log-likelihood by the toxic less that by the ordinary model."""
        keys, begins = grams(words)
        keys, of = np.unique(keys, return_inverse=True)
        p = np.full((1, len(keys)), 1 / 4096.0)
        for order in range(1, ORDER + 1):
            p = self.step(order, keys, p)
        return np.add.reduceat((np.log(p[1]) - np.log(p[0]))[of], begins) if len(keys) else np.empty(0)

    def step(self, order: int, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of sorted grams at an order from those at the one below; at the highest, a row for each class."""
        share, left = np.atleast_2d(self.share[order - 1]), np.atleast_2d(self.left[order - 1])
        if not share.size:
            return np.broadcast_to(p, (len(share), len(keys)))
        at, known = self.find(self.keys[order - 1], low(keys, order))
        in_context, seen = self.find(self.context[order - 1], low(keys, order) >> np.uint64(BITS))
        return np.where(known, share[:, at], 0.0) + np.where(seen, left[:, in_context], 1.0) * p

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def discounted(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of grams after their contexts, the contexts, and what is left of each, by absolute discounting."""
    context, of = np.unique(keys >> np.uint64(BITS), return_inverse=True)
    total = np.bincount(of, weights=counts, minlength=len(context))
    off = np.bincount(of, weights=np.minimum(counts, DISCOUNT), minlength=len(context))
    safe = np.where(total > 0, total, 1)
    return np.maximum(counts - DISCOUNT, 0) / safe[of], context, np.where(total > 0, off / safe, 1.0)


def build(keys: np.ndarray, counts: np.ndarray) -> Models:
    """Models from sorted keys of order 5 and their counts in ordinary (row 0) and toxic (row 1) texts."""
    levels: dict[int, tuple] = {}
    own = [discounted(keys, counts[c], ORDER) for c in (0, 1)]
    levels[ORDER] = (keys, np.stack([own[0][0], own[1][0]]), own[0][1], np.stack([own[0][2], own[1][2]]))
    longer = keys
    for order in range(ORDER - 1, 0, -1):
        shorter, different = np.unique(low(longer, order), return_counts=True)  # characters seen before each
        levels[order] = (shorter, *discounted(shorter, different.astype(float), order))
        longer = shorter
    ordered = [levels[i] for i in range(1, ORDER + 1)]
    return Models(*([x[i] for x in ordered] for i in range(4)), np.zeros(FEATURES), np.ones(FEATURES), np.array([-1.0, *[0.0] * FEATURES]))


class Reader:
    """Features of texts under the models; the evidence of words is kept in bounded arrays."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.evidence, self.length = np.empty(0), np.empty(0)

    def learn(self, words: list[bytes]) -> None:
        bare = [w.strip(EDGES) for w in words]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.evidence = np.concatenate([self.evidence, self.models.evidence(bare)])
        self.length = np.concatenate([self.length, [len(w) + 1.0 for w in bare]])

    def features(self, some: list[str]) -> np.ndarray:
        found = [lower_words(x) for x in some]
        new = list(set().union(*found) - self.place.keys())
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        out = np.zeros((len(some), FEATURES))
        for i, words in enumerate(found):
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                evidence, length = self.evidence[at], self.length[at]
                top = np.sort(np.partition(evidence, -min(3, len(words)))[-min(3, len(words)) :])[::-1]
                out[i, : len(top)] = top
                out[i, 3] = (evidence / length).max()
                out[i, 4] = evidence.sum() / length.sum()
                out[i, 5] = np.log1p((evidence > 3).sum())
        if len(self.place) > KEPT_WORDS:
            self.clear()
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a logistic curve over weighted rows, by Newton's method with a small ridge."""
    weight = weight * (len(x) / weight.sum())
    mean = np.average(x, axis=0, weights=weight)
    scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)), 1e-6)
    a = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a.T * (weight * np.maximum(p * (1 - p), 1e-9))) @ a + ridge * len(x) / 100 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * len(x) / 100 * w), -5, 5)
    return mean, scale, w


def train(documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Models:
    """Models from labelled rows whose crc32(doc_id as text) mod `modulus` isn't `held`.

    The models learn from two of three such rows and the curve from the third, in which each class has the weight that
    it has among all such labels: however small a share of a class is sampled, a score means the same. Rows without a label, id or text are
    passed over; of several labels of a document, toxic holds. Without both classes every text gets a low score.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = marked.where(crc32_mod(F.col("doc_id"), modulus) != held)
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, most / max(1, sizes.get(c, 0))) for c, most in ((0, ordinary_rows), (1, toxic_rows))}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    marked = marked.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(marked), "doc_id")  # at most toxic_rows + ordinary_rows labels
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(3)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict[bytes, int]] = [{}, {}]
        for batch in batches:
            for text, c in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                own = seen[c]
                for w in lower_words(text):
                    w = w.strip(EDGES)
                    own[w] = own.get(w, 0) + 1
        for c in (0, 1):
            if seen[c]:
                keys, begins = grams(list(seen[c]))
                n = np.repeat(list(seen[c].values()), np.diff(np.append(begins, len(keys))))
                found, which = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.full(len(found), c, np.int32)), pa.array(np.bincount(which, weights=n).astype(np.int64))], ["gram", "toxic", "n"])

    counted = arrow_map(rows.where("part <> 0").select("text", "toxic"), count, "gram long, toxic int, n long").groupBy("gram").agg(*(F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    found = counted.toArrow().sort_by("gram")
    models = build(found.column("gram").to_numpy().astype(np.uint64), np.stack([found.column("n0").to_numpy(), found.column("n1").to_numpy()]).astype(float))

    curve = features(rows.where("part = 0").select("doc_id", "text", "toxic"), models, "toxic int").toArrow()
    y = curve.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = np.array(curve.column("features").to_pylist())
        order = np.lexsort((*x.T, y))  # sums must not depend on the order in which rows arrive
        models.mean, models.scale, models.weights = logistic(x[order], y[order], np.where(y[order] > 0, 1 / share[1], 1 / share[0]))
    return models


def features(rows: DataFrame, models: Models, more: str) -> DataFrame:
    kept = rows.sparkSession.sparkContext.broadcast(models)  # as large as the grams of the bounded sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kept.value)
        for batch in batches:
            x = reader.features(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "toxic", "features"])

    return arrow_map(rows, work, f"doc_id long, {more}, features array<double>")


def score(documents: DataFrame, models: Models, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3) of every row's whole text.

    Null and empty texts are scored as texts without evidence. Null ids stay null and are not held out.
    """
    kept = documents.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kept.value)
        for batch in batches:
            found = kept.value.score(reader.features(texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = arrow_map(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, score double, predicted int")
    return rows.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(documents: DataFrame, models: Models) -> DataFrame:
    """The rows, with all their columns, whose score is under THRESHOLD."""
    kept = documents.sparkSession.sparkContext.broadcast(models)

    def make():
        reader = Reader(kept.value)
        return lambda some: (kept.value.score(reader.features(some)) < THRESHOLD).tolist()

    return keep_rows(documents, make)
