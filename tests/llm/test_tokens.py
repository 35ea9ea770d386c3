"""Operators 4, 6 and 8 against the tokenizers library, and exact round trips."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markerlake.llm import bpe, pieces, repair, token_counts
from markerlake.llm.queries import BYTE_BPE, WORD_BPE


def library(path, special=True):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = not special
    return t


def sha(x):
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


def bpe_brute(rows):
    t = library(BYTE_BPE)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_bpe_on_odd_texts(spark, odd, empty):
    got = [tuple(r) for r in bpe.digests(odd, BYTE_BPE).collect()]
    assert order(got) == order(bpe_brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert bpe.digests(empty, BYTE_BPE).count() == 0


def test_bpe_on_the_table(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = [tuple(r) for r in bpe.digests(docs, BYTE_BPE).collect()]
    assert order(got) == order(bpe_brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_a_task_of_bpe_has_one_python_worker(odd):
    """Workers wait side by side in one executor: two to a task hold twice the codecs."""
    got = bpe.digests(odd, BYTE_BPE)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = bpe.decode(bpe.encode(odd, BYTE_BPE), BYTE_BPE).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256))
    assert order(map(tuple, got.collect())) == order(map(tuple, apart.collect()))


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 4000, "the" * 2500, "xyzzy" * 900 + "q" * 3001, "".join(chr(97 + (i * i) % 26) for i in range(7000))])
@pytest.mark.parametrize("leaf", [3, 64, 1000])
def test_trees_give_the_tokens_of_the_whole(piece, leaf):
    own = pieces.codec(BYTE_BPE)
    assert own.tree(piece.encode(), leaf) == own.merge(piece.encode())


SCRIPTS = {
    "letters": "abcdefgh" * 130_000,
    "cjk": "".join(chr(0x4E00 + (i * i + 7 * i) % 5000) for i in range(350_000)),
    "emoji": "".join(chr(0x1F600 + (i * 13) % 60) + "\u200d" * (i % 5 == 0) for i in range(60_000)),
    "cyrillic": "".join(chr(0x430 + (i * i) % 32) for i in range(300_000)),
    "special": ("x" * 2040 + "<|endoftext|>") * 40,
    "mixed": ("word don't  \n\n 12345 żółć 日本語。「あ」 " * 7 + "end.<|endoftext|> <|endoftext" + " " * 33 + "\t\t") * 300,
    "spaces": (" " * 3000 + "a") * 20,
}


@pytest.mark.parametrize("name", SCRIPTS)
@pytest.mark.parametrize("shift", [0, 5])
def test_long_texts_of_any_script(name, shift):
    text = "x " * shift + SCRIPTS[name]
    assert np.frombuffer(pieces.codec(BYTE_BPE).encode(text), "<u4").tolist() == library(BYTE_BPE).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 2, 7, 50])
def test_texts_cut_anywhere(spark, middle, monkeypatch, leaf):
    own, t = pieces.Codec(BYTE_BPE), library(BYTE_BPE)
    monkeypatch.setattr(pieces, "TEXT_LEAF", leaf)
    texts = [r["text"] for r in spark.read.parquet(f"{middle}/documents.parquet").limit(40).collect() if r["text"]]
    for text in [*(x[:1500] for x in texts), SCRIPTS["mixed"][:600], "a <|endoftext|> b", "  x  y\u3000z \u00a0 \u2003q"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert own.joins > 100


def test_texts_of_the_table_are_trees(spark, middle):
    own = pieces.Codec(BYTE_BPE)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{middle}/documents.parquet").collect()]
    for x in texts:
        own.encode(x)
    assert own.joins == sum(max(0, -(-len(x) // pieces.TEXT_LEAF) - 1) for x in texts) > 300


def test_words_are_encoded_many_at_once(spark, odd, middle, monkeypatch):
    """Each different word once, in one call for a batch; what differs from plain Latin one by one; none kept when the table is full."""
    own, t = pieces.Codec(WORD_BPE), library(WORD_BPE)
    texts = [r["text"] for r in spark.read.parquet(f"{middle}/documents.parquet").collect()]
    strange = ["", None, " a  b\tC\x0bd\x0c ", "can't I'LL x_y 3.14 ÀÉ \x1c\x1d q\x85r", "İstanbul ŉ", "x<|endoftext|>y <|none|>", "é" * 3000 + " ok", "end.\n"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in [*texts, *strange, *(r["text"] for r in odd.collect())]]
    some = pa.array([*texts, *strange, *(r["text"] for r in odd.collect())], pa.string())
    calls = []
    monkeypatch.setattr(own, "merge", lambda piece, merge=own.merge: calls.append(piece) or merge(piece))
    for kept in (1_000_000, 1_000):
        monkeypatch.setattr(pieces, "KEPT_WORDS", kept)
        for cut in (0, 3, len(texts)):  # slices too
            ids, sizes = own.words.encode(some[cut:])
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want[cut:]
    assert len(calls) < 100 < len(set(" ".join(x or "" for x in texts).split()))
    assert [x.tolist() for x in own.words.encode(some[:0])] == [[], []]


def repair_brute(rows):
    t, start, out = library(WORD_BPE), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_repair_on_odd_texts(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()]
    got = [tuple(r) for r in repair.digests(odd.where("doc_id is not null"), WORD_BPE).collect()]
    assert order(got) == order(repair_brute(rows))
    assert repair.digests(odd, WORD_BPE).count() == odd.count()
    assert repair.digests(empty, WORD_BPE).count() == 0


def test_repair_on_the_table(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = [tuple(r) for r in repair.digests(docs, WORD_BPE).collect()]
    assert order(got) == order(repair_brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_grammar_round_trip_and_random_access():
    ids = np.array([(i * i) % 11 for i in range(5000)] + [3] * 500, np.uint32)
    rules, sequence = repair.compress(ids, 20, least=4)
    assert len(rules) > 0 and len(sequence) < len(ids)
    assert (repair.expand(sequence, rules, 20) == ids).all()
    block = repair.Block({"symbols": 20, "rules": rules.tobytes(), "sequence": sequence.astype("<u4").tobytes(), "expansions": repair.expansion_lengths(rules, 20).tobytes()})
    for start, stop in ((0, 1), (17, 18), (100, 2000), (5400, 5500), (0, 5500)):
        assert (block.ids(start, stop) == ids[start:stop]).all()


def pair_counts(sequence):
    """Occurrences of pairs, as many as can be replaced together: a run of one symbol holds half as many as it has places."""
    seen, last = Counter(), {}
    for i, pair in enumerate(zip(sequence, sequence[1:])):
        if last.get(pair) != i - 1:
            seen[pair] += 1
            last[pair] = i
    return seen


@pytest.mark.parametrize("seed", range(4))
def test_no_frequent_pair_is_left(seed):
    pick = np.random.default_rng(seed)
    passage = pick.integers(0, 50, 300)
    ids = np.concatenate([np.concatenate([passage, pick.integers(0, 50, 40)]) for _ in range(30)] + [np.full(77, 7), np.tile([1, 2, 3], 40)]).astype(np.uint32)
    rules, sequence = repair.compress(ids, 50)
    assert (repair.expand(sequence, rules, 50) == ids).all()
    assert max(pair_counts(sequence.tolist()).values()) < repair.LEAST_COUNT
    assert repair.expansion_lengths(rules, 50).max() > 100  # the passage has become long symbols
    used = Counter([*rules.ravel().tolist(), *sequence.tolist()])
    assert all(used[50 + i] for i in range(len(rules)))


def test_small_blocks_of_repair(spark, middle, tmp_path):
    docs = spark.read.parquet(f"{middle}/documents.parquet").limit(60).cache()
    repair.write(docs, WORD_BPE, str(tmp_path / "r"), block_ids=500)
    got = [tuple(r) for r in repair.read(spark, str(tmp_path / "r")).drop("ids").collect()]
    assert order(got) == order(repair_brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_separator_scan_at_any_block_size(spark, odd, tmp_path, block):
    t = library(BYTE_BPE, special=False)
    some = odd.where("length(text) < 10000 or text is null")
    want = [(r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in some.collect()]
    if block == 1:
        some = some.where("length(text) < 50 or text is null")
        want = [(r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in some.collect()]
    got = [tuple(r) for r in token_counts.document_counts(some, BYTE_BPE, str(tmp_path / "f"), block).collect()]
    assert order(got) == order(want)


def test_token_counts_on_the_table(spark, middle, empty):
    t = library(BYTE_BPE, special=False)
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = [tuple(r) for r in token_counts.document_counts(docs, BYTE_BPE).collect()]
    assert order(got) == order([(r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()])
    assert token_counts.document_counts(empty, BYTE_BPE).count() == 0
