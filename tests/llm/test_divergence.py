"""Operator 11 against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from markerlake.llm import divergence

ROWS = "doc_id long, text string, lang string, source string, term string, value string, salt string"


def brute(rows, ranks=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for (lang, source), mine in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = shares(mine)
        q = shares(sum((c for (x, _), c in groups.items() if x == lang), Counter()))
        pairs = []
        for (x, other), theirs in groups.items():
            if x == lang and other != source:
                o = shares(theirs)
                pairs.append((sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other))
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if mine[t] and p[t] > q[t]]
        for part, some, most in (("pair", pairs, None), ("term", terms, ranks)):
            for r, (value, item) in enumerate(sorted(some, key=lambda x: (-x[0], x[1].encode()))[:most]):
                out.append((lang, source, part, item, value, r + 1))
    return sorted(out)


def found(df):
    return sorted(tuple(r[x] for x in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", "y", "z") for i, (t, lang, s) in enumerate(rows)], ROWS)


@pytest.fixture(scope="module")
def many():
    """Sources with hundreds of terms of equal count, terms with long common beginnings, a hot source."""
    pick = random.Random(4)
    same = ["ab" * 40 + "".join(pick.choice("abcé日") for _ in range(pick.randint(1, 5))) for _ in range(300)]
    rare = ["".join(pick.choice("klmnö") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(240):
        source = "hot" if i % 3 else f"s{i % 4}"
        rows.append((" ".join(pick.choices(same if i % 2 else rare, k=30)) + " The the x" * (i % 5), "en" if i % 7 else "de", source))
    return rows


def test_matches_plain_sums(spark, many):
    assert found(table(spark, many)) == brute(many)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ties_at_the_last_rank(spark, many, monkeypatch, k):
    monkeypatch.setattr(divergence, "RANKS", k)
    assert found(table(spark, many)) == brute(many, k)


def test_salted_joins_and_many_sources(spark, many, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "SOURCES_A_SALT", 2)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    assert found(table(spark, many)) == brute(many)


def test_odd_rows(spark, odd, empty):
    rows = [("a b c", None, None), ("a b", "", None), ("a", None, ""), (None, "en", "s"), ("", "en", None), ("1 2 3", "fr", "s"), ("x", "fr", "t"), ("a a", "", "t")]
    assert found(table(spark, rows)) == brute(rows)
    assert found(odd) == brute([(r["text"], r["lang"], r["source"]) for r in odd.collect()])
    assert found(empty) == []
