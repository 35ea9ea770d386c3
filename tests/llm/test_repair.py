"""What operator 6 costs: how often it looks at a block, and which words it takes one by one; that no frequent pair is left."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from markerlake.llm import pieces, repair
from markerlake.llm.queries import WORD_BPE


def block(seed):
    """Words of some ids, the frequent ones far more often, with passages that come again."""
    pick = np.random.default_rng(seed)
    words = [pick.integers(0, 400, pick.integers(1, 7)) for _ in range(3000)]
    ids = np.concatenate([words[i] for i in np.minimum(pick.zipf(1.3, 40_000), len(words)) - 1])
    return np.concatenate([ids, np.tile(ids[:5000], 8), np.full(77, 7)]).astype(np.uint32)


@pytest.mark.parametrize("seed", range(2))
def test_late_rounds_look_at_few_positions(seed, monkeypatch):
    ids, looks, found = block(seed), [], repair.frequent
    monkeypatch.setattr(repair, "frequent", lambda sequence, near, *more: looks.append(len(near)) or found(sequence, near, *more))
    rules, sequence = repair.compress(ids, 400)
    assert (repair.expand(sequence, rules, 400) == ids).all()
    assert looks[0] == len(ids) - 1 and len(looks) > 6
    assert sum(looks) < 3 * len(ids)
    assert sum(looks[5:]) < len(ids) / 4


@pytest.mark.parametrize("seed", range(2))
def test_positions_left_out_hold_no_frequent_pair(seed, monkeypatch):
    """The same grammar as if every round looked at all positions."""
    ids, found = block(seed), repair.frequent
    want = repair.compress(ids, 400)
    monkeypatch.setattr(repair, "frequent", lambda sequence, near, *more: found(sequence, np.arange(len(sequence) - 1), *more))
    for a, b in zip(want, repair.compress(ids, 400), strict=True):
        assert (a == b).all()


def most_frequent(sequence):
    """Occurrences of the most frequent pair, as many as can be replaced together."""
    seen, last = Counter(), {}
    for i, pair in enumerate(zip(sequence, sequence[1:])):
        if last.get(pair) != i - 1:
            seen[pair] += 1
            last[pair] = i
    return max(seen.values())


def test_no_frequent_pair_of_the_table_is_left(spark, small):
    """Pairs of copies that take turns with each other, and runs with more places than occurrences, too few for a rule."""
    own = pieces.codec(WORD_BPE)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    ids, sizes = own.words.encode(pa.array(texts, pa.string()))
    ids = np.insert(ids, np.cumsum(sizes), 1)
    rules, sequence = repair.compress(ids, len(own.bytes_of))
    assert (repair.expand(sequence, rules, len(own.bytes_of)) == ids).all()
    assert most_frequent(sequence.tolist()) < repair.LEAST_COUNT


def test_runs_count_what_can_be_replaced_together():
    ids = np.array([5] * 11 + [6] + [5] * 2 + [7, 8] * 7 + [9] * 10, np.uint32)
    pairs, n, near, which = repair.frequent(ids, np.arange(len(ids) - 1), 400, 6)
    assert list(zip(pairs.tolist(), n.tolist(), strict=True)) == [([5, 5], 6), ([7, 8], 7), ([8, 7], 6)]
    assert (ids[near] == pairs[which, 0]).all() and (ids[near + 1] == pairs[which, 1]).all() and len(near) == 11 + 7 + 6


def test_pairs_too_wide_to_sort_with_their_places():
    """Two ids of 32 bits and a place don't fit into 64 bits."""
    ids = block(3)
    for a, b in zip(*(repair.frequent(ids, np.arange(len(ids) - 1), top, 6) for top in (400, 2**32 - 1)), strict=True):
        assert len(a) and (a == b).all()
    far = 3_000_000_000
    rules, sequence = repair.compress(ids, far)
    assert (repair.expand(sequence, rules, far) == ids).all()


@pytest.mark.parametrize("length", [0, 1, 2, 5])
def test_short_blocks(length):
    rules, sequence = repair.compress(np.full(length, 3, np.uint32), 400)
    assert rules.shape == (0, 2) and sequence.tolist() == [3] * length


@pytest.mark.parametrize("deep", [1, 300])
def test_expansion_puts_each_symbol_once(deep, monkeypatch):
    """Rounds look at what the last one has put, not at all ids again."""
    rules = np.array([(10 + i - 1 if i else 3, i % 10) for i in range(deep)], np.uint32)  # each rule: the one before and an id
    sequence, seen, found = np.array([*range(10)] * 400 + [10 + deep - 1], np.uint32), [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: seen.append(len(x)) or found(x))
    got = repair.expand(sequence, rules, 10)
    assert got.tolist() == [*range(10)] * 400 + [3, *(i % 10 for i in range(deep))]
    assert len(sequence) <= sum(seen) <= len(sequence) + 2 * deep
    assert repair.expand(sequence[:0], rules, 10).tolist() == []
    assert repair.expand(sequence[:7], rules[:0], 10).tolist() == sequence[:7].tolist()


def test_places_taken_are_apart_and_leave_none_free():
    pick = np.random.default_rng(5)
    for _ in range(300):
        at = np.flatnonzero(pick.random(50) < 0.7)
        often = pick.integers(1, 5, len(at))
        taken = at[repair.apart(at, often)]
        assert (np.diff(taken) > 1).all()
        assert all(min(abs(x - taken)) <= 1 for x in at)


class Watched:
    def __init__(self, own):
        self.pattern, self.own, self.seen = own.pattern, own, []

    def findall(self, text):
        self.seen.append(text)
        return self.own.findall(text)


def test_plain_words_are_not_cut_one_by_one(monkeypatch):
    watched = Watched(pieces.WORD_PIECES)
    monkeypatch.setattr(pieces, "WORD_PIECES", watched)
    own, t = pieces.Codec(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    plain = [chr(c) for c in range(0x21, 0x180) if pieces.WORD_PLAIN.fullmatch(chr(c))]
    texts = [" ".join(f"{c} a{c} {c}B {c}{c}1{c}23 x{c}'S'{c}LL. _{c}_" for c in plain), "end.", "", "  ", None, "don't, (it'll) 3.14 --'t--"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    ids, sizes = own.words.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert not watched.seen
    for x in ("", " ", "a", " a", "...", "日本 語", "a 日本 b", "é" * 1100):  # alone, and with nothing plain beside
        ids, sizes = own.words.encode(pa.array([x]))
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]


def test_batches_are_put_together():
    rows = [pa.record_batch({"doc_id": pa.array([i]), "text": pa.array(["x" * n])}) for i, n in enumerate([10, 10, 500, 1, 600, 3])]
    got = list(repair.together(iter(rows), 400))
    assert [x.column("doc_id").to_pylist() for x in got] == [[0, 1, 2], [3, 4], [5]]
    assert list(repair.together(iter([]), 400)) == []
