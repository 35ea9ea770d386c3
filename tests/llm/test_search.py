"""Operator 1 against brute force."""

import math

from markerlake.llm import topk


def brute(rows, queries, k):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in kept:
        if q in queries:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_matches_brute_force_with_ties_and_unusable_rows(spark):
    base = [(i, [((i * 7 + j * 3) % 5 - 2) / 4 for j in range(6)]) for i in range(80)]
    rows = [*base, (100, None), (101, [None] * 6), (102, [float("nan")] + [0.0] * 5), (103, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (104, [0.0] * 6), (105, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rank string, score string")
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0"), k=5).collect()))
    assert got == brute(rows, {0, 50, 100}, 5)


def test_small_blocks_merge(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(i, [((i * 11 + j) % 9 - 4) / 8 for j in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 5 = 0"), k=3).collect()))
    assert got == brute(rows, set(range(0, 60, 5)), 3)


def test_empty_and_fewer_than_k(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df, k=5).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(two, two, k=5).collect())) == [(0, 1, 1, 32768), (1, 1, 0, 32768)]


def test_repeated_query_rows_have_their_own_rows(spark):
    rows = [(i, [((i * 11 + j) % 9 - 4) / 8 for j in range(5)]) for i in range(20)] + [(0, [0.5, 0.25, 0.0, 0.0, 1.0]), (0, [((j) % 9 - 4) / 8 for j in range(5)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 10 = 0"), k=3).collect()))
    want = []
    others = lambda q: [(i, v) for i, v in rows if i != q]
    for q, v in rows:
        if q % 10 == 0:
            best = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), i) for i, w in others(q))[:3]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
