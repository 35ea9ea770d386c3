"""Operator 13 against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from markerlake.llm import spelling

ROWS = "doc_id long, text string, word string, id string, n string"


def words_of(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = words_of(rows)
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: x if x and n[x] >= 2 * n[w] else None for w, x in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r[x] for x in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df).collect())


def test_matches_all_pairs(spark):
    pick = random.Random(3)
    base = ["".join(pick.choice("abé×") for _ in range(pick.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        some = [pick.choice(base) for _ in range(25)]
        for _ in range(5):
            w = pick.choice(base)
            at = pick.randrange(len(w))
            some.append(pick.choice([w[:at] + w[at + 1 :], w[:at] + pick.choice("abé") + w[at:], w[:at] + "ö" + w[at + 1 :]]))
        rows.append((i, " ".join(some).upper() if i % 3 else ", ".join(some)))
    rows.append((500, "alphabet " * 40 + "alphabez " * 12 + "alphabzz " * 4 + "lphabzz " * 4))
    got = found(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS))
    assert got == brute(rows) and any(r[1] for r in got) and any(r[2] != r[1] for r in got if r[1])


def test_odd_rows(spark, odd, empty):
    assert found(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert found(empty) == []


def test_very_long_words(spark):
    """Words of 30,000 letters have 30,000 deletions; what they take grows with their length."""
    long = "".join(random.Random(9).choices("abcdefgh", k=30_000))
    rows = [(i, f"{long} {long[:700]}{long[701:]} {long}x") for i in range(4)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want and max(r[4] for r in want) >= 2


def test_keys_are_those_of_the_deletions():
    power = spelling.powers(64)
    for word in ("a", "aab", "abcab", "ééé", "banana"):
        alone = [spelling.keys_of(x, power)[0] for x in {word[:i] + word[i + 1 :] for i in range(len(word))} if x]
        assert set(alone) <= set(spelling.keys_of(word, power)[1:].tolist()) and len(spelling.keys_of(word, power)) == 1 + len(re.findall(r"(.)\1*", word))
        assert spelling.keys_of(word, power).dtype == np.uint64
