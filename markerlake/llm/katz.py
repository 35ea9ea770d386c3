"""Language-model scores from a Katz back-off trigram model (operator 2).

Model, at each order n: P(w|h) = d(c) c(h,w) / c(h) for n-grams seen in training, with Good-Turing discounts d of that
order for counts up to LARGEST; otherwise alpha(h) P(w|h'), h' being h without its first word, with alpha(h) =
(1 - sum of seen P(w|h)) / (1 - sum of their P(w|h')), from all seen n-grams of h. P(w) is the discounted unigram
estimate; what the discounts leave is the probability of the unknown word. All distributions add up to 1 over the
training words, the end and the unknown word. Two starts stand before the first word; an unknown history backs off with
weight 1.

How it is computed. Texts become blocks of some million tokens, and a block asks only once for each of its distinct
words and trigrams. Words are counted in partitions by hash and get numbers in descending order of count, so that the
count of a number follows from the table of different counts, of which there are at most sqrt(2 tokens). A trigram
(u, v, w) goes to the partition of its middle word v, where all that a token's probability needs meets: the counts of
(u, v, w), (v, w), (u, v) and v. That partition keeps its part of the table, and answers with a logarithm for each
trigram that a block has asked for; the block adds them up by text. No task holds more than a block or a part.

A word so frequent that its trigrams would fill a part is split over several by u, and its pairs (v, w) are counted
before; a pair (u, v) as frequent is split by w too, and its sums are put together apart. There are at most 4 such words
and 4 such pairs to a part. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import arrow_map, clean_shuffles, importable, partitions, remove, stored, words_of

BLOCK_TOKENS = 1 << 20
PART_TOKENS = 1 << 20  # tokens to a part of the table
LARGEST = 5  # counts above it are not discounted
END_WORD = b"\n"  # no word holds it
UNKNOWN, START, FIRST = 0, 1, 2  # numbers of the unknown word and the start; words begin at the third
FIELDS = ("a", "b", "c", "d", "e", "f", "g")
ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), *((x, pa.binary()) for x in FIELDS)])
SCHEMA = "part int, block long, n long, " + ", ".join(f"{x} binary" for x in FIELDS)
MIX = np.uint64(0x9E3779B97F4A7C15)


# -- packed arrays ----------------------------------------------------------------------------------------------------
def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def widen(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(widen(packed[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.zeros(1, values.dtype)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def pack_runs(values: np.ndarray, first: np.ndarray) -> bytes:
    """Values that ascend between the places that `first` marks."""
    return pack(np.where(first, values, np.diff(values, prepend=np.zeros(1, values.dtype))))


def unpack_runs(packed: bytes, first: np.ndarray) -> np.ndarray:
    steps = unpack(packed)
    sums = np.cumsum(steps, dtype=np.uint64)
    at = np.flatnonzero(first)
    return sums - np.repeat(sums[at] - steps[at], np.diff(np.append(at, len(steps))))


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def pack_floats(values: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(values.astype("<f8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_floats(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(widen(packed), np.uint8).reshape(8, -1).T).view("<f8").ravel()


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(hashed: np.ndarray, parts: int) -> np.ndarray:
    return (((hashed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def counted(values: np.ndarray, most: int) -> np.ndarray:
    """How many of the values are 1, 2, .. most."""
    return np.bincount(np.minimum(values, most + 1).astype(np.int64), minlength=most + 2)[1 : most + 1]


# -- discounts --------------------------------------------------------------------------------------------------------
def discounts(of_counts: list[int]) -> np.ndarray:
    """d(0..LARGEST) by Good-Turing from the number of events seen 1, 2, .. LARGEST + 1 times; d(0) is unused.

    The numbers are smoothed first: a line is fitted to their logarithms over those of the counts, each number weighted
    by itself (the inverse of its logarithm's variance) after gaps are averaged out. Smoothed numbers n_r = r^b give
    r*/r = (1 + 1/r)^(b + 1). Discounts lie between 0 and 1 for any b under -1; a flatter line is taken as that limit,
    where r*/r is 1 - e log(1 + 1/r) as e goes to 0. Where only one of the numbers isn't 0 there is no line: absolute
    discounting takes its place. Without events seen once, nothing is discounted.
    """
    n = np.array(of_counts, float)
    out = np.ones(LARGEST + 1)
    r = np.arange(1.0, LARGEST + 1)
    seen = np.flatnonzero(n) + 1.0
    if not n[0]:
        return out
    if len(seen) == 1:
        out[1:] = (r - 0.5) / r
        return out
    before, after = np.append(0, seen[:-1]), np.append(seen[1:], 2 * seen[-1] - seen[-2])
    x, y, weight = np.log(seen), np.log(n[n > 0] / ((after - before) / 2)), n[n > 0]
    x, y = x - np.average(x, weights=weight), y - np.average(y, weights=weight)
    power = (weight * x * y).sum() / (weight * x * x).sum() + 1
    if power > -1e-6:
        out[1:] = 1 - np.log1p(1 / r) / np.log(LARGEST + 1)
    else:
        cut_off = (LARGEST + 1) ** power
        out[1:] = ((1 + 1 / r) ** power - cut_off) / (1 - cut_off)
    return out


def given(d: np.ndarray, seen: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histories: the factor of their seen n-grams and what these leave to the lower order.

    seen: how many n-grams of a history have the counts 1, .. LARGEST (a row each); total: the history's count. A history
    of which no count is discounted gives 1 / (total + 1) away.
    """
    total = np.maximum(total.astype(np.float64), 1)
    left = (seen * ((1 - d[1:]) * np.arange(1, LARGEST + 1))).sum(axis=1) / total
    return np.where(left > 0, 1.0, total / (total + 1)), np.where(left > 0, left, 1 / (total + 1))


def discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count > LARGEST, 1.0, d[np.minimum(count, LARGEST).astype(np.int64)]) * count


class Unigrams:
    """P(w) by training count; count 0 is the unknown word."""

    def __init__(self, tokens: int, types: int, of_counts: list[int]) -> None:
        self.tokens, self.types = tokens, types
        self.d = discounts(of_counts)
        left = sum((1 - self.d[r]) * r * of_counts[r - 1] for r in range(1, LARGEST + 1))
        self.unknown = left / tokens if tokens and left > 0 else 0.0

    def p(self, count: np.ndarray) -> np.ndarray:
        count = count.astype(np.float64)
        if not self.unknown:
            return (count + 1) / (self.tokens + self.types + 1)
        return np.where(count == 0, self.unknown, discounted(self.d, count) / self.tokens)


@dataclass
class Words:
    """What follows from a word's number: a row for each different count, from the highest down."""

    starts: np.ndarray  # the first number of each count
    counts: np.ndarray
    unigrams: Unigrams
    texts: int  # training texts: how often the start was seen
    line: int  # count from which a word is split
    parts: int

    def count(self, number: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.where(number == START, self.texts, 0)
        at = np.searchsorted(self.starts, number.astype(np.int64), side="right") - 1
        return np.where(number >= FIRST, self.counts[np.maximum(at, 0)], np.where(number == START, self.texts, 0))

    def number(self, count: np.ndarray, place: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Of words: their numbers, from their counts and their places among the words of a part with that count."""
        if not len(self.starts):
            return np.zeros(len(count), np.int64)
        at = len(self.counts) - 1 - np.searchsorted(self.counts[::-1], np.maximum(count, 1))
        return np.where(count > 0, self.starts[at] + place * self.parts + part, UNKNOWN)

    def hot(self, number: np.ndarray) -> np.ndarray:
        return self.count(number) >= self.line


# -- blocks -----------------------------------------------------------------------------------------------------------
def blocks(documents: DataFrame, modulus: int, held: int) -> DataFrame:
    """A row for each block: n tokens, a document ids, b flags (1 trains, 2 null id), c lengths, d local words, e their
    order by hash, f their hashes in order, g their counts in the block's training texts, in that order.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Index(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(self)
                return n

        part, number = TaskContext.get().partitionId(), 0
        index, names, flags, lengths, tokens, size = Index({END_WORD: 0}), [], [], [], [], 0

        def row() -> pa.RecordBatch:
            sequence = np.concatenate(tokens)
            counts = np.bincount(sequence, weights=np.repeat(np.array(flags) & 1, lengths), minlength=len(index))
            hashes = np.array([xxhash.xxh64_intdigest(x) for x in index], np.uint64)
            order = np.argsort(hashes)
            values = [np.array(names, "<i8").tobytes(), bytes(flags), pack(np.array(lengths)), pack(sequence), pack(order), pack_sorted(hashes[order]), pack(counts[order])]
            return pa.RecordBatch.from_pylist([dict(zip(FIELDS, values, strict=True)) | {"part": -1, "block": (part << 32) + number, "n": size}], schema=ARROW)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = list(map(index.__getitem__, words_of(text or "")))
                own.append(0)
                trained = name is None or zlib.crc32(str(name).encode()) % modulus != held
                names.append(name or 0)
                flags.append(trained + 2 * (name is None))
                lengths.append(len(own))
                tokens.append(np.array(own, np.uint32))
                size += len(own)
                if size >= BLOCK_TOKENS:
                    yield row()
                    index, names, flags, lengths, tokens, size, number = Index({END_WORD: 0}), [], [], [], [], 0, number + 1
        if names:
            yield row()

    return arrow_map(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, SCHEMA)


def word_questions(read: DataFrame, parts: int) -> DataFrame:
    """For each block and part: a the hashes of the part's words in order, b their counts in training."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                hashes, counts = unpack_sorted(block["f"]), unpack(block["g"])
                cuts = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
                rows = [{"part": p, "block": block["block"], "a": pack_sorted(hashes[i:j]), "b": pack(counts[i:j])} for p, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return arrow_map(read.select("part", "block", "n", *FIELDS), work, SCHEMA)


def count_words(table: pa.Table) -> pa.Table:
    """Answers: a each word's count, b its place among the part's words with that count. Block -1: a the part's different
    counts, b how many words have each.
    """
    asked = table.select(["part", "block", "a", "b"]).to_pylist()
    keys, counts = [unpack_sorted(x["a"]) for x in asked], np.concatenate([unpack(x["b"]) for x in asked])
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=counts).astype(np.int64)
    order = np.argsort(total, kind="stable")
    different, begins, n = np.unique(total[order], return_index=True, return_counts=True)
    place = np.empty(len(total), np.int64)
    place[order] = np.arange(len(total)) - np.repeat(begins, n)
    out = [{"part": asked[0]["part"], "block": -1, "a": pack(different[different > 0]), "b": pack(n[different > 0])}]
    ends = np.cumsum([len(x) for x in keys])
    for x, own, end in zip(asked, keys, ends, strict=True):
        at = which[end - len(own) : end]
        out.append({"part": x["part"], "block": x["block"], "a": pack(total[at]), "b": pack(np.where(total[at] > 0, place[at], 0))})
    return pa.Table.from_pylist(out, schema=ARROW)


def numbered(answered: DataFrame, texts: int, parts: int) -> Words:
    """The table of different counts: at most sqrt(2 tokens) rows come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(a).astype(np.int64)), pa.array(unpack(b).astype(np.int64))], ["count", "n"])

    found = arrow_map(answered.where("block = -1").select("a", "b"), work, "count long, n long").groupBy("count").agg(F.sum("n").alias("n"), F.max("n").alias("most")).toArrow().sort_by([("count", "descending")])
    count, n, most = (found.column(x).to_numpy().astype(np.int64) for x in ("count", "n", "most"))
    starts = FIRST + np.cumsum(np.append(0, most[:-1] * parts)) if len(count) else count
    tokens, of_counts = int((count * n).sum()), [int(n[count == r].sum()) for r in range(1, LARGEST + 2)]
    return Words(starts, count, Unigrams(tokens, int(n.sum()), of_counts), texts, max(1, tokens // (4 * parts)), parts)


def coded(block: dict, answers: list[dict], words: Words) -> dict:
    """A block in words' numbers: n tokens, a ids, b flags, c lengths, d numbers, e known tokens and f base score by text."""
    answers = sorted(answers, key=lambda x: x["part"])
    order = unpack(block["e"]).astype(np.int64)
    count, place = (np.concatenate([unpack(x[f]) for x in answers]).astype(np.int64) for f in ("a", "b"))
    part = np.repeat([x["part"] for x in answers], [len(unpack(x["a"])) for x in answers])
    number, of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    number[order], of[order] = words.number(count, place, part), count
    lengths, sequence = unpack(block["c"]).astype(np.int64), unpack(block["d"]).astype(np.int64)
    at = np.cumsum(lengths) - lengths
    base = np.log10((of + 1.0) / (words.unigrams.tokens + words.unigrams.types + 1))[sequence]
    return {"part": -1, "block": block["block"], "n": block["n"], "a": block["a"], "b": block["b"], "c": block["c"], "d": pack(number[sequence]), "e": pack(np.add.reduceat((of > 0)[sequence].astype(np.int64), at)), "f": pack_floats(np.add.reduceat(base, at))}


class Grams:
    """The distinct trigrams (u, v, w) of a block whose middle word is known, in the order u within v, w within u."""

    def __init__(self, block: dict, words: Words) -> None:
        self.lengths = unpack(block["c"]).astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        w = unpack(block["d"]).astype(np.int64)
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], v[self.begins] = w[:-1], START
        u[1:], u[self.begins] = v[:-1], START
        self.last, self.known = w, words.count(v) > 0
        names, local = np.unique(np.concatenate([w, [START]]), return_inverse=True)
        n = len(names)
        lw = local[:-1]
        lv, lu = np.empty_like(lw), np.empty_like(lw)
        lv[1:], lv[self.begins] = lw[:-1], local[-1]
        lu[1:], lu[self.begins] = lv[:-1], local[-1]
        at = np.flatnonzero(self.known)
        histories, history = np.unique(lv[at] * n + lu[at], return_inverse=True)
        grams, self.which = np.unique(history * n + lw[at], return_inverse=True)
        trains = np.repeat(np.frombuffer(block["b"], np.uint8) & 1, self.lengths)[at]
        self.trained = np.bincount(self.which, weights=trains, minlength=len(grams)).astype(np.int64)
        h = histories[grams // n] if len(grams) else grams
        self.v, self.u, self.w = names[h // n], names[h % n], names[grams % n]
        # the pairs (v, w) of words that are split
        self.split = np.flatnonzero(words.hot(self.v))
        pairs, self.pair = np.unique((h // n)[self.split] * n + (grams % n)[self.split], return_inverse=True)
        self.pair_v, self.pair_w = names[pairs // n], names[pairs % n]
        self.pair_trained = np.bincount(self.pair, weights=self.trained[self.split], minlength=len(pairs)).astype(np.int64)
        mixed = spread(self.pair_v.astype(np.uint64) * MIX + spread(self.pair_w.astype(np.uint64)))
        self.pair_part = part_of(mixed, words.parts)
        self.pair_order = np.argsort(self.pair_part, kind="stable")

    def pair_questions(self, block: int, parts: int) -> Iterator[dict]:
        """By part: a v and b w of pairs, c their counts in the block's training texts."""
        cuts = np.searchsorted(self.pair_part[self.pair_order], np.arange(parts + 1))
        for p, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if i < j:
                at = self.pair_order[i:j]
                v = self.pair_v[at]
                yield {"part": p, "block": block, "a": pack_sorted(v), "b": pack_runs(self.pair_w[at], firsts(v)), "c": pack(self.pair_trained[at])}

    def dealt(self, words: Words, hot_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each trigram's part, and the trigrams in the order of parts."""
        key = self.v.astype(np.uint64)
        key[self.split] += spread(self.u[self.split].astype(np.uint64)) * MIX
        both = self.split[np.isin(self.v[self.split] * MIX.astype(np.int64) + self.u[self.split], hot_pairs)] if len(hot_pairs) else self.split[:0]
        key[both] += spread(self.w[both].astype(np.uint64) + MIX)
        part = part_of(spread(key), words.parts)
        return part, np.argsort(part, kind="stable")

    def questions(self, block: int, words: Words, hot_pairs: np.ndarray, pair_counts: np.ndarray) -> Iterator[dict]:
        """By part: a v, b u, c w of trigrams, d their counts in training, e the counts of (v, w) where v is split."""
        part, order = self.dealt(words, hot_pairs)
        cuts = np.searchsorted(part[order], np.arange(words.parts + 1))
        of_pair = np.full(len(self.v), -1, np.int64)
        of_pair[self.split] = pair_counts[self.pair] if len(self.split) else 0
        for p, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if i < j:
                at = order[i:j]
                v, u = self.v[at], self.u[at]
                counts = of_pair[at]
                yield {"part": p, "block": block, "a": pack_sorted(v), "b": pack_runs(u, firsts(v)), "c": pack_runs(self.w[at], firsts(v, u)), "d": pack(self.trained[at]), "e": pack(counts[counts >= 0])}


def pair_key(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    return v * MIX.astype(np.int64) + u


def read_grams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = unpack_sorted(row["a"])
    u = unpack_runs(row["b"], firsts(v))
    return v.astype(np.int64), u.astype(np.int64), unpack_runs(row["c"], firsts(v, u)).astype(np.int64)


def count_pairs(table: pa.Table, words: Words) -> pa.Table:
    """Answers: a each pair's count. Block -1, a row for each v: n is v, a how many of its pairs have the counts 1, ..
    LARGEST + 1, b the sum of the seen pairs' P(w). Block -2, where a pair of split words is to be split itself: n is v,
    a holds w and the count.
    """
    asked = table.select(["part", "block", "a", "b", "c"]).to_pylist()
    vs = [unpack_sorted(x["a"]).astype(np.int64) for x in asked]
    v = np.concatenate(vs)
    w = np.concatenate([unpack_runs(x["b"], firsts(y)) for x, y in zip(asked, vs, strict=True)]).astype(np.int64)
    names, iv = np.unique(v, return_inverse=True)
    others, iw = np.unique(w, return_inverse=True)
    keys, which = np.unique(iv * len(others) + iw, return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([unpack(x["c"]) for x in asked]), minlength=len(keys)).astype(np.int64)
    own, second = keys // len(others), others[keys % len(others)]
    p = words.unigrams.p(words.count(second))
    out = []
    for i, name in enumerate(names.tolist()):
        at = np.flatnonzero((own == i) & (total > 0))
        out.append({"part": asked[0]["part"], "block": -1, "n": name, "a": pack(counted(total[at], LARGEST + 1)), "b": pack_floats(p[at].sum(keepdims=True))})
        at = at[(total[at] >= words.line) & words.hot(second[at])]
        out += [{"part": asked[0]["part"], "block": -2, "n": name, "a": pack(np.array([x, c]))} for x, c in zip(second[at], total[at], strict=True)]
    ends = np.cumsum([len(x) for x in vs])
    for x, y, end in zip(asked, vs, ends, strict=True):
        out.append({"part": x["part"], "block": x["block"], "a": pack(total[which[end - len(y) : end]])})
    return pa.Table.from_pylist(out, schema=ARROW)


def count_grams(table: pa.Table, words: Words, hot_pairs: dict[int, int]) -> pa.Table:
    """A part of the table, as the row with block 0: a v, b u, c w of its trigrams, d their counts, e those of (v, w), f of
    each v how many pairs have the counts 1, .. LARGEST and (floats) the sum of the seen pairs' P(w), g which blocks asked
    for which trigrams. Block -1: a counts of counts of trigrams and of pairs. Block -2, for each split pair: n is its
    key, a counts of counts of its trigrams, counts of the counts of their pairs (v, w), and the sum of those above LARGEST.
    """
    asked = table.select(["part", "block", "a", "b", "c", "d", "e"]).to_pylist()
    each = [read_grams(x) for x in asked]
    v, u, w = (np.concatenate([x[i] for x in each]) for i in range(3))
    sizes = [len(x[0]) for x in each]
    (names, iv), (befores, iu), (afters, iw) = (np.unique(x, return_inverse=True) for x in (v, u, w))
    histories, history = np.unique(iv * len(befores) + iu, return_inverse=True)
    keys, which = np.unique(history * len(afters) + iw, return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([unpack(x["d"]) for x in asked]), minlength=len(keys)).astype(np.int64)
    of_history, iw = keys // len(afters), keys % len(afters)
    iv = histories[of_history] // len(befores)
    kv, ku, kw = names[iv], befores[histories[of_history] % len(befores)], afters[iw]
    pairs, of_pair = np.unique(iv * len(afters) + iw, return_inverse=True)
    split = words.hot(kv)
    pair_total = np.bincount(of_pair, weights=total, minlength=len(pairs)).astype(np.int64)
    came = np.full(len(v), -1, np.int64)
    came[words.hot(v)] = np.concatenate([unpack(x["e"]) for x in asked]).astype(np.int64)
    given_pair = np.empty(len(keys), np.int64)
    given_pair[which] = came
    two = np.where(split, given_pair, pair_total[of_pair])
    whole = ~words.hot(names)[pairs // len(afters)] & (pair_total > 0)
    own = (pairs // len(afters))[whole]
    small = np.minimum(pair_total[whole], LARGEST + 1)
    n = np.bincount(own * (LARGEST + 2) + small, minlength=len(names) * (LARGEST + 2)).reshape(-1, LARGEST + 2)[:, 1 : LARGEST + 1]
    mass = np.bincount(own, weights=words.unigrams.p(words.count(afters[(pairs % len(afters))[whole]])), minlength=len(names))
    part, out = asked[0]["part"], []
    ends = np.cumsum(sizes)
    places = np.concatenate([pack_where(which[e - s : e]) for s, e in zip(sizes, ends.tolist(), strict=True)])
    header = np.array([len(asked), *(x["block"] for x in asked), *sizes], "<i8").tobytes()
    first = firsts(kv)
    stats = squeeze(n.astype("<i8").T.tobytes() + mass.astype("<f8").tobytes())
    out.append({"part": part, "block": 0, "n": len(keys), "a": pack_sorted(kv), "b": pack_runs(ku, first), "c": pack_runs(kw, firsts(kv, ku)), "d": pack(total), "e": pack(two), "f": stats, "g": len(header).to_bytes(8, "little") + header + pack(places)})
    out.append({"part": part, "block": -1, "a": pack(np.concatenate([counted(total, LARGEST + 1), counted(pair_total[whole], LARGEST + 1)]))})
    if hot_pairs:
        key = pair_key(kv, ku)
        hot = np.flatnonzero(np.isin(key, np.fromiter(hot_pairs, np.int64)) & (total > 0))
        for name in np.unique(key[hot]).tolist():
            at = hot[key[hot] == name]
            out.append({"part": part, "block": -2, "n": name, "a": pack(np.concatenate([counted(total[at], LARGEST), counted(two[at], LARGEST), [two[at][two[at] > LARGEST].sum()]]))})
    return pa.Table.from_pylist(out, schema=ARROW)


def pack_where(places: np.ndarray) -> np.ndarray:
    return np.diff(places, prepend=0)


@dataclass
class Table:
    """What all parts of the table share."""

    words: Words
    two: np.ndarray  # discounts of pairs
    three: np.ndarray  # and of trigrams
    hot: dict[int, tuple[np.ndarray, float]]  # of each split word: its pairs' counts of counts, their sum of P(w)
    pairs: dict[int, tuple[int, np.ndarray]]  # of each split pair: its count and its sums

    def logs(self, row: dict) -> np.ndarray:
        """log10 P(w|u,v) of a part's trigrams."""
        words = self.words
        v, u, w = read_grams(row)
        total, two = unpack(row["d"]).astype(np.int64), unpack(row["e"]).astype(np.int64)
        # order 1
        p = words.unigrams.p(words.count(w))
        # order 2: the histories v
        at = np.flatnonzero(firsts(v))
        stats = np.frombuffer(widen(row["f"]), "<i8")
        n, mass = stats[: -len(at)].reshape(LARGEST, -1).T.copy(), stats[-len(at) :].view("<f8").copy()
        for i, name in enumerate(v[at].tolist()):
            if name in self.hot:
                n[i], mass[i] = self.hot[name][0][:LARGEST], self.hot[name][1]
        seen_v = words.count(v[at])
        factor, left = given(self.two, n, seen_v)
        run = np.diff(np.append(at, len(v)))
        factor, alpha, of_v = (np.repeat(x, run) for x in (factor, left / np.maximum(1 - mass, 1e-300), seen_v))
        p = np.where(two > 0, factor * discounted(self.two, two) / of_v, alpha * p)
        # order 3: the histories (u, v)
        at = np.flatnonzero(firsts(v, u))
        run = np.diff(np.append(at, len(v)))
        count = np.add.reduceat(total, at)
        history = np.repeat(np.arange(len(at)), run)
        n = np.bincount(history * (LARGEST + 2) + np.minimum(total, LARGEST + 1), minlength=len(at) * (LARGEST + 2)).reshape(-1, LARGEST + 2)[:, 1 : LARGEST + 1]
        mass = np.add.reduceat(np.where(total > 0, p, 0.0), at)
        if self.pairs:
            key = pair_key(v[at], u[at])
            for i in np.flatnonzero(np.isin(key, np.fromiter(self.pairs, np.int64))).tolist():
                count[i], sums = self.pairs[int(key[i])]
                n[i] = sums[:LARGEST]
                seen = (self.two[1:] * np.arange(1, LARGEST + 1) * sums[LARGEST : 2 * LARGEST]).sum() + sums[-1]
                mass[i] = factor[at[i]] * seen / of_v[at[i]]
        factor, left = given(self.three, n, count)
        alpha = np.where(count > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
        factor, alpha, count = (np.repeat(x, run) for x in (factor, alpha, np.maximum(count, 1)))
        return np.log10(np.where(total > 0, factor * discounted(self.three, total) / count, alpha * p))


def answers(row: dict, table: Table) -> Iterator[dict]:
    """For each block that asked: a the logarithms, as single precision numbers in the order of its questions."""
    logs = table.logs(row).astype("<f4").view("<u4")
    length = int.from_bytes(row["g"][:8], "little")
    header = np.frombuffer(row["g"][8 : 8 + length], "<i8")
    m = int(header[0])
    steps = unpack(row["g"][8 + length :]).astype(np.int64)
    ends = np.cumsum(header[1 + m :])
    for block, size, end in zip(header[1 : 1 + m].tolist(), header[1 + m :].tolist(), ends.tolist(), strict=True):
        yield {"part": row["part"], "block": block, "a": pack(logs[np.cumsum(steps[end - size : end])])}


def finish(block: dict, found: list[dict], table: Table, hot_pairs: np.ndarray) -> pa.Table:
    words = table.words
    grams = Grams(block, words)
    _, order = grams.dealt(words, hot_pairs)
    logs = np.empty(len(order), np.float64)
    if len(order):
        logs[order] = np.concatenate([unpack(x["a"]).astype("<u4").view("<f4") for x in sorted(found, key=lambda x: x["part"])])
    each = np.empty(len(grams.last), np.float64)
    each[grams.known] = logs[grams.which]
    alone = ~grams.known
    each[alone] = np.log10(words.unigrams.p(words.count(grams.last[alone])))
    flags = np.frombuffer(block["b"], np.uint8)
    names = pa.array(np.frombuffer(block["a"], "<i8"), mask=(flags & 2) > 0)
    return pa.table({"doc_id": names, "held_out": pa.array((flags & 1) == 0), "n_tokens": grams.lengths, "n_known": unpack(block["e"]).astype(np.int64), "train_tokens": np.full(len(flags), words.unigrams.tokens, np.int64), "base_score": unpack_floats(block["f"]), "score": np.add.reduceat(each, grams.begins)})


def summed(rows: DataFrame, width: int) -> dict[int, tuple[np.ndarray, float]]:
    """By n: the sums of the packed `a` and of the number in `b`. For statistics of which there are few."""
    schema = "n long, s double, " + ", ".join(f"x{i} long" for i in range(width))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [unpack(x).astype(np.int64) for x in batch.column("a").to_pylist()]
            s = [float(unpack_floats(x)[0]) if x else 0.0 for x in batch.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(s, pa.float64()), *(pa.array([int(x[i]) for x in each], pa.int64()) for i in range(width))], ["n", "s", *(f"x{i}" for i in range(width))])

    total = arrow_map(rows.select("n", "a", "b"), work, schema).groupBy("n").agg(F.sum("s").alias("s"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(width)))
    return {r["n"]: (np.array([r[f"x{i}"] for i in range(width)], np.int64), r["s"]) for r in total.collect()}


def score(documents: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row's whole text.

    Rows with crc32(doc_id as text) mod `modulus` = `held` are held out of training. Null and empty texts have one
    token, the end. Rows with a null doc_id train and keep their null. Repeated rows train and score as often as they
    occur. Without any training text every word is unknown. The table and all that leads to it is deleted from the shared
    folder as soon as it has been read; what stays is the result.
    """
    spark = documents.sparkSession
    importable(spark)
    read, read_at = stored(blocks(documents, modulus, held), "katz-read", 16)
    parts = max(partitions(spark), -(-(read.agg(F.sum("n")).first()[0] or 0) // PART_TOKENS))
    with clean_shuffles(spark):
        answered, words_at = stored(word_questions(read, parts).groupBy("part").applyInArrow(count_words, SCHEMA), "katz-words")
        words = numbered(answered, training_texts(read), parts)

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([coded(x, right.select(["part", "a", "b"]).to_pylist(), words) for x in left.to_pylist()], schema=ARROW)

    sequences, sequences_at = stored(read.drop("f", "g").groupBy("block").cogroup(answered.where("block >= 0").groupBy("block")).applyInArrow(code, SCHEMA), "katz-coded", 16)
    remove(spark, read_at)
    remove(spark, words_at)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(Grams(block, words).pair_questions(block["block"], parts)), schema=ARROW)

    pairs, pairs_at = stored(arrow_map(sequences, ask_pairs, SCHEMA).groupBy("part").applyInArrow(lambda t: count_pairs(t, words), SCHEMA), "katz-pairs")
    with clean_shuffles(spark):
        hot = summed(pairs.where("block = -1"), LARGEST + 1)  # at most 4 words and 4 pairs to a part
        hot_counts = {int(pair_key(np.array([x[1]]), np.array([x[0]]))[0]): x[2] for x in split_pairs(pairs)}
    if words.texts >= words.line:
        hot_counts[int(pair_key(np.array([START]), np.array([START]))[0])] = words.texts
    hot_keys = np.fromiter(hot_counts, np.int64)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        for block in left.to_pylist():
            grams = Grams(block, words)
            counts = np.zeros(len(grams.pair_v), np.int64)
            if len(counts):
                counts[grams.pair_order] = np.concatenate([unpack(x["a"]) for x in sorted(right.select(["part", "a"]).to_pylist(), key=lambda x: x["part"])])
            rows += grams.questions(block["block"], words, hot_keys, counts)
        return pa.Table.from_pylist(rows, schema=ARROW)

    asked = sequences.groupBy("block").cogroup(pairs.where("block >= 0").groupBy("block")).applyInArrow(ask, SCHEMA)
    table, table_at = stored(asked.groupBy("part").applyInArrow(lambda t: count_grams(t, words, hot_counts), SCHEMA), "katz-table", 16)
    remove(spark, pairs_at)
    with clean_shuffles(spark):
        of_counts = summed(table.where("block = -1").withColumn("n", F.lit(0).cast("long")), 2 * (LARGEST + 1))
        hot_sums = summed(table.where("block = -2"), 2 * LARGEST + 1)
    of_counts = of_counts[0][0] if of_counts else np.zeros(2 * (LARGEST + 1), np.int64)
    of_pairs = of_counts[LARGEST + 1 :] + sum((x for x, _ in hot.values()), np.zeros(LARGEST + 1, np.int64))
    none = np.zeros(2 * LARGEST + 1, np.int64)
    shared = Table(words, discounts(of_pairs.tolist()), discounts(of_counts[: LARGEST + 1].tolist()), hot, {k: (c, hot_sums.get(k, (none, 0.0))[0]) for k, c in hot_counts.items()})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(answers(row, shared)), schema=ARROW)

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.select(["part", "a"]).to_pylist()
        return pa.concat_tables([finish(x, found, shared, hot_keys) for x in left.to_pylist()])

    replies = arrow_map(table.where("block = 0"), answer, SCHEMA)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores, _ = stored(sequences.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(end, schema), "katz-scores")
    remove(spark, table_at)
    remove(spark, sequences_at)
    return scores


def training_texts(read: DataFrame) -> int:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((np.frombuffer(x, np.uint8) & 1).sum()) for x in batch.column("b").to_pylist()], pa.int64())], ["n"])

    return arrow_map(read.select("b"), work, "n long").agg(F.sum("n")).first()[0] or 0


def split_pairs(pairs: DataFrame) -> list[tuple[int, int, int]]:
    """(u, v, count) of the pairs of words that are split by the third word too: at most 4 to a part."""
    return [(r["n"], *unpack(r["a"]).tolist()) for r in pairs.where("block = -2").select("n", "a").collect()]
