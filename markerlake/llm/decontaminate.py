"""Benchmark decontamination by latent semantic retrieval (operator 3).

Benchmark items are cut into passages, weighted by TF-IDF (document frequencies over all documents), and a randomised
singular value decomposition, its products summed over the partitions of the passages, gives a latent space. Windows of
documents are projected into it and searched for the passages whose cosine reaches LEAST_COSINE: their items are the
window's candidates. Both sides are divided by their length in the latent space, so that an exact copy has cosine 1
however many items there are. The longest common subsequence of words with the item decides, and for paraphrases also
whether the item's answer is there.

Only windows around which a text holds so many of some item's rarest words that it can pass that check are projected: no
other window could lead to a row, so this loses nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import arrow_map, keep_rows, texts

PASSAGE, STEP = 40, 20  # words in a window, and between windows; of documents and of long items
RANK, OVERSAMPLE = 128, 16
SAME = 0.8  # share of an item's words, in order, from which a document holds it
ALIKE = 0.6  # from which it holds it if the answer is there too
LEAST_COSINE = 0.25  # of a window and a passage; tests measure what it loses against all windows and items
HITS = 3  # different words of an item's rarest, at most, that a region must hold to be a candidate
ANSWER_WORDS = 3  # an item's rarest words stand for its answer; all but one must be there
ITEMS_AT_ONCE, WORDS_AT_ONCE = 2_000, 200_000  # items, and words in them, whose model is broadcast together: some MB
PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def plain_words(text: str) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(None, PUNCTUATION).split()


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = where.get(x, 0)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return (full ^ row).bit_count()


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    idf: np.ndarray
    space: np.ndarray  # a row for each word
    passages: np.ndarray  # unit rows in the latent space
    passage_items: np.ndarray  # the item of each passage
    items: list[int]
    words: list[list[int]]  # of each item
    counted: list[tuple[np.ndarray, np.ndarray]]  # each item's different words and how often each is there
    answers: list[list[int]]
    gates: np.ndarray  # gates that a word counts for, by word: 2 * item for its answer, 2 * item + 1 for its rarest words
    gates_at: np.ndarray  # where each word's begin
    hits: np.ndarray  # different words that each gate needs


def pieces(words: list[int]) -> list[list[int]]:
    return [words[i : i + PASSAGE] for i in range(0, max(1, len(words) - STEP), STEP)] if len(words) > PASSAGE + STEP else [words]


def frequencies(documents: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and how many documents there are."""
    kept = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept.value
        own, n = Counter(), 0
        for batch in batches:
            for text in texts(batch):
                own.update(words.keys() & set(plain_words(text)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(words[x] for x in own)], pa.int64()), pa.array([n, *own.values()], pa.int64())], ["word", "n"])

    found = arrow_map(documents.select(F.col("text").cast("string")), work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # one row for each word of the vocabulary
    out, total = np.zeros(len(vocabulary)), 0
    for word, n in zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True):
        if word < 0:
            total = n
        else:
            out[word] = n
    return out, total


SUMS = 8  # partial sums of a block's products, of words x width numbers each, that reach the driver


def latent(block: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    """The right singular vectors, scaled to unit length, of the TF-IDF rows of the passages of items (text): words x rank.

    Passages are cut where they are summed, so that a task holds one Python worker.
    """
    n, width = len(idf), min(RANK + OVERSAMPLE, len(idf))
    basis = np.random.Generator(np.random.PCG64(11)).standard_normal((n, width))
    context = block.sparkSession.sparkContext

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        """Sum over rows a of a' (a q), or of (a q)' (a q)."""
        kept = context.broadcast((q, idf, vocabulary))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, idf, vocabulary = kept.value
            total = np.zeros((q.shape[1], q.shape[1]) if gram else q.shape)
            for batch in batches:
                for words in passages_of(texts(batch), vocabulary):
                    at, tf = np.unique(np.array(words, np.int64), return_counts=True)
                    value = tf * idf[at]
                    value = value / max(1e-12, np.linalg.norm(value))
                    image = value @ q[at]
                    if gram:
                        total += np.outer(image, image)
                    else:
                        total[at] += np.outer(value, image)
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part"])

        # a block of items is small, so few tasks sum it, and the driver gets few sums however many partitions it lies in
        parts = arrow_map(block.select("text").coalesce(SUMS), work, "part binary").toArrow().column("part").to_pylist()
        return sum(np.frombuffer(x, np.float32).astype(float).reshape((width, width) if gram else q.shape) for x in parts)

    for _ in range(2):
        basis, _ = np.linalg.qr(product(basis, gram=False))
    values, vectors = np.linalg.eigh(product(basis, gram=True))
    order = np.argsort(-values)[: min(RANK, len(values))]
    return basis @ vectors[:, order[values[order] > 1e-9]]


def passages_of(some: list[str], vocabulary: dict[bytes, int]) -> list[list[int]]:
    """The passages of items' texts as lists of word numbers."""
    return [p for x in some if (words := plain_words(x)) for p in pieces([vocabulary[w] for w in words])]


def fit(documents: DataFrame, block: DataFrame, items: list[tuple[int, list[bytes]]]) -> Model:
    """The model of a block of items: the block's rows, and the same items as the driver has them."""
    vocabulary: dict[bytes, int] = {}
    for _, words in items:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    df, total = frequencies(documents, vocabulary)
    idf = np.log((total + 1) / (df + 1)) + 0.01
    coded = [[vocabulary[w] for w in words] for _, words in items]
    cut = [(i, p) for i, words in enumerate(coded) for p in pieces(words)]
    space = latent(block, vocabulary, idf)
    vectors = unit(np.stack([image_of(*np.unique(p, return_counts=True), idf, space) for _, p in cut]))
    answers = [sorted(set(words), key=lambda w: (-idf[w], w))[:ANSWER_WORDS] for words in coded]
    gates, hits = [], []
    for i, words in enumerate(coded):
        rarest, least = prefix(words, idf)
        gates += [(w, 2 * i) for w in answers[i]] + [(w, 2 * i + 1) for w in rarest]
        hits += [answers_needed(answers[i]), least]
    gates.sort()
    gates_at = np.searchsorted([w for w, _ in gates], np.arange(len(idf) + 1))
    return Model(vocabulary, idf, space.astype(np.float32), vectors.astype(np.float32), np.array([i for i, _ in cut]), [i for i, _ in items], coded, [np.unique(words, return_counts=True) for words in coded], answers, np.array([g for _, g in gates], np.int64), gates_at, np.array(hits, np.int64))


def image_of(words: np.ndarray, tf: np.ndarray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    return (tf * idf[words]) @ space[words]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def answers_needed(answer: list[int]) -> int:
    return max(1, len(answer) - 1)


def prefix(words: list[int], idf: np.ndarray) -> tuple[list[int], int]:
    """An item's rarest words, and how many different ones a text must hold to share SAME of the item's words with it.

    A text with fewer has, of the item's words, at most those outside the prefix and the most frequent of the prefix.
    """
    need = next(n for n in range(1, len(words) + 1) if n / len(words) >= SAME)
    own, times = np.unique(words, return_counts=True)
    order = np.lexsort((own, -idf[own]))
    for least in range(min(HITS, len(own)), 0, -1):
        held = 0
        for n, k in enumerate(order, 1):
            held += int(times[k])
            if n >= least and len(words) - held + np.sort(times[order[:n]])[n - least + 1 :].sum() < need:
                return own[order[:n]].tolist(), least
    raise AssertionError("a text without any of an item's words shares none with it")


def gated(model: Model, coded: list[np.ndarray], flat: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], set[int]]:
    """Items that the region around a window can hold, going by their rarest words; by text and the window's begin."""
    at = np.flatnonzero(flat >= 0)
    word = flat[at]
    n = (model.gates_at[1:] - model.gates_at[:-1])[word]
    at, word, n = at[n > 0], word[n > 0], n[n > 0]
    gate = model.gates[np.repeat(model.gates_at[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    text = np.repeat(np.searchsorted(first, at // STEP, side="right") - 1, n)
    place, word = np.repeat(at, n) - first[text] * STEP, np.repeat(word, n)
    key = text * len(model.hits) + gate
    different = np.unique(np.stack([key, word], axis=1), axis=0)[:, 0]
    keys, counts = np.unique(different, return_counts=True)
    keys = keys[counts >= model.hits[keys % len(model.hits)]]
    kept = np.flatnonzero(np.isin(key, keys))
    kept = kept[np.argsort(key[kept], kind="stable")]
    out: dict[tuple[int, int], set[int]] = {}
    for own in np.split(kept, np.flatnonzero(np.diff(key[kept])) + 1) if len(kept) else []:
        i, g = divmod(int(key[own[0]]), len(model.hits))
        size, last = len(model.words[g // 2]), -(-len(coded[i]) // STEP) - 1
        held: dict[int, set[int]] = {}
        for p, w in zip(place[own].tolist(), word[own].tolist(), strict=True):
            for half in range(max(0, -((size + PASSAGE - 1 - p) // STEP)), min(last, (p + size) // STEP) + 1):
                held.setdefault(half, set()).add(w)
        for half, words in held.items():
            if len(words) >= model.hits[g]:
                out.setdefault((i, half * STEP), set()).add(g // 2)
    return out


def matches(model: Model, some: list[list[bytes]]) -> list[list[tuple[int, float, float, bool]]]:
    """Of each text: (item, cosine, share of the item's words in order, answer there) of the items that it holds."""
    out: list[dict[int, tuple[int, float, float, bool]]] = [{} for _ in some]
    coded = [np.array(list(map(model.vocabulary.get, words, repeat(-1))), np.int64) for words in some]
    halves = np.array([-(-len(x) // STEP) for x in coded])
    first = np.cumsum(halves) - halves
    flat = np.full(halves.sum() * STEP, -1, np.int64)
    for x, at in zip(coded, first.tolist(), strict=True):
        flat[at * STEP : at * STEP + len(x)] = x
    for (i, begin), item, cosine in retrieved(model, coded, gated(model, coded, flat, first)):
        words = model.words[item]
        region = coded[i][max(0, begin - len(words)) : begin + PASSAGE + len(words)]
        different, times = model.counted[item]
        if np.minimum((region[:, None] == different).sum(axis=0), times).sum() / len(words) < ALIKE:
            continue  # fewer words in common, in any order, than the check wants in order
        region = region.tolist()
        share = common_length(words, region) / len(words)
        answered = len(set(model.answers[item]) & set(region)) >= answers_needed(model.answers[item])
        if share >= SAME or (share >= ALIKE and answered):
            name = model.items[item]
            old = out[i].get(name, (name, -1.0, 0.0, False))
            out[i][name] = (name, max(cosine, old[1]), max(share, old[2]), answered or old[3])
    return [sorted(x.values()) for x in out]


def retrieved(model: Model, coded: list[np.ndarray], windows: dict[tuple[int, int], set[int]]) -> Iterator[tuple[tuple[int, int], int, float]]:
    """Latent search: windows with the items of passages near them, and the cosine; items that a window can't hold go."""
    keys = list(windows)
    for lo in range(0, len(keys), 1024):
        some = keys[lo : lo + 1024]
        images = np.zeros((len(some), model.passages.shape[1]), np.float32)
        for row, (i, begin) in enumerate(some):
            own, tf = np.unique(coded[i][begin : begin + PASSAGE], return_counts=True)
            known = own >= 0
            images[row] = image_of(own[known], tf[known], model.idf, model.space)
        cosines = unit(images) @ model.passages.T
        rows, passages = np.nonzero(cosines >= LEAST_COSINE)
        best: dict[tuple[int, int], float] = {}
        for row, item, cosine in zip(rows.tolist(), model.passage_items[passages].tolist(), cosines[rows, passages].tolist(), strict=True):
            if item in windows[some[row]]:
                best[row, item] = max(best.get((row, item), -1.0), cosine)
        for (row, item), cosine in best.items():
            yield some[row], item, cosine


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer for each document and benchmark item that the document holds.

    A document is there once for each of its items, and not at all if it holds none. Null texts hold nothing; items
    that are null, blank or without an id are passed over; repeated items count once, several texts of one item as one item,
    repeated documents each. An empty benchmark gives no rows. The benchmark is read in blocks of about ITEMS_AT_ONCE items
    or WORDS_AT_ONCE words, each with its own pass.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer boolean"
    out = documents.sparkSession.createDataFrame([], schema)
    for model in models(documents, benchmark):
        out = out.union(found_in(rows, model, schema))
    return out


def models(documents: DataFrame, benchmark: DataFrame) -> Iterator[Model]:
    """A model for each block of the benchmark's items."""
    wanted = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    items, words = wanted.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    passes = max(-(-items // ITEMS_AT_ONCE), -(-(words or 0) // WORDS_AT_ONCE))
    for k in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        items = [(r["item_id"], plain_words(r["text"])) for r in block.orderBy("item_id", "text").collect()]
        items = [x for x in items if x[1]]
        if items:
            yield fit(documents, block, items)


def without_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, of documents that hold no benchmark item."""
    for model in models(documents, benchmark):
        kept = documents.sparkSession.sparkContext.broadcast(model)
        documents = keep_rows(documents, lambda kept=kept: lambda some: [not x for x in matches(kept.value, [plain_words(x) for x in some])])
    return documents


def found_in(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    kept = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = matches(kept.value, [plain_words(x) for x in texts(batch)])
            found = [(d, *x) for d, own in zip(batch.column("doc_id").to_pylist(), held, strict=True) for x in own]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer"])

    return arrow_map(rows, work, schema)
