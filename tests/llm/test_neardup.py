"""Operator 7 against all pairs, and connected components."""

import re
from collections import Counter

import pytest

from markerlake.llm import neardup
from markerlake.llm.common import Scratch
from markerlake.llm.graph import components


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    often = Counter(s for x in sets.values() for s in x)
    where, near = {}, set()
    for i in ids:  # two sets this alike share one of the rarest quarter of either
        for s in sorted(sets[i], key=lambda s: (often[s], s))[: len(sets[i]) // 4 + 1]:
            near |= {(j, i) for j in where.setdefault(s, [])}
            where[s].append(i)
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def test_on_the_table(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, neardup.near_duplicates(docs, exact=True).collect())) == got


def test_a_repeated_id_joins_what_its_texts_are_like(spark, prose):
    a, b, c = prose(40, 11), prose(40, 12), prose(40, 13)
    rows = [(9, a), (9, b), (9, b), (6, a), (7, b), (5, b + " more"), (1, c), (1, prose(40, 14)), (2, c)]
    for exact in (False, True):
        got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), exact).collect()}
        assert got == {(9, 5), (6, 5), (7, 5), (5, 5), (1, 1), (2, 1)}


@pytest.mark.parametrize(("small", "exact"), [(2, False), (24, False), (2, True)])
def test_large_groups_at_the_line(spark, prose, small, exact, monkeypatch):
    """Chains of texts each near the next, a group of copies, texts just over and under the least similarity."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = prose(300, 3).split()
    rows, at = [], 0
    for k in range(60):
        words = list(base)
        for j in range(k):
            words[(j * 5) % 300] = f"new{j}"
        rows.append((at, " ".join(words)))
        at += 1
    rows += [(at + i, " ".join(base)) for i in range(40)]
    rows += [(at + 50 + i, " ".join([*base[:60], f"tail{i}", *base[60:]])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(df, exact).collect())) == brute(rows)


def test_odd_rows(spark, odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    named = sorted({tuple(r) for r in got if r["doc_id"] is not None})
    assert named == brute([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None])
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.without_copies(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 4, 6, 10, None}
    assert not {r["doc_id"] for r in kept.collect()} & {5, 7, 8, 9, 11}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(df.where("a < 0"), Scratch(spark, "t")).count() == 0
