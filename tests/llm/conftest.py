"""Small tables with the odd cases that every operator must take."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, score string, key string"


def rows(texts):
    return [(i, t, "en", "web", len(t or ""), "x", "y", "z") for i, t in texts]


@pytest.fixture(scope="session")
def prose():
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Null ids and texts, empty and blank texts, repeated rows, ties, a very long text, odd characters, clashing columns."""
    long = prose(60_000, 1)
    base = prose(40, 2)
    texts = [
        (None, None), (None, base), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (5, "one"),
        (6, base), (7, base), (8, base + " more"), (9, base.upper()), (10, long), (11, long + " end"),
        (12, "a" * 9000), (13, "żółć 日本語 العربية 🎉🎉 \u0000 ﻿   é"), (14, "<|endoftext|> it's 12345 <|startoftext|>"),
        (15, "mail a.b@c.org or b@c.d_e@f.gh, +49 (30) 1234-5678, 4111 1111 1111 1111, 10.0.0.256, 1.2.3.4.5.6.7.8"),
        (2**62, "big id"), (-3, "negative id"),
    ]
    return spark.createDataFrame(rows(texts), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
