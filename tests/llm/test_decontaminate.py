"""Operator 3 with many more passages than the latent space has dimensions."""

import random
from collections import Counter

import pytest

from markerlake.llm import decontaminate
from markerlake.llm.decontaminate import ALIKE, ANSWER_WORDS, PASSAGE, SAME, STEP


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def brute(docs, items):
    """(doc, item) where some window's region passes the check; only pairs without enough common words are left out."""
    df = Counter(w for _, x in docs for w in set(x))
    place = {}
    for _, words in items:
        for w in words:
            place.setdefault(w, len(place))
    out = set()
    counted = [Counter(words) for _, words in items]
    for d, text in docs:
        whole = Counter(text)
        for (i, words), own in zip(items, counted):
            if sum(min(n, whole[w]) for w, n in own.items()) < ALIKE * len(words):
                continue
            answer = set(sorted(own, key=lambda w: (df[w], place[w]))[:ANSWER_WORDS])
            for begin in range(0, len(text), STEP):
                region = text[max(0, begin - len(words)) : begin + PASSAGE + len(words)]
                share = lcs(words, region) / len(words)
                if share >= SAME or (share >= ALIKE and len(answer & set(region)) >= max(1, len(answer) - 1)):
                    out.add((d, i))
                    break
    return out


def test_many_diverse_items_equal_brute_force(spark):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(6000)]
    weights = [1 / (i + 5) for i in range(6000)]
    say = lambda n: pick.choices(words, weights, k=n)
    items = [(i, say(pick.randint(15, 59))) for i in range(1500)]
    docs = [(1000 + k, say(pick.randint(20, 300))) for k in range(40)]
    for k in range(160):
        item = items[k * 9][1]
        kept = [w if k < 60 or pick.random() > 0.2 + 0.1 * (k % 3) else pick.choice(words) for w in item]
        docs.append((k, say(pick.randint(0, 120)) + kept + say(pick.randint(0, 120))))
    want = brute(docs, items)
    assert {(k, k * 9) for k in range(60)} <= want and len(want) > 90
    got = decontaminate.contaminated(spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in got}
    assert got <= want and len(got) >= 0.98 * len(want) and {(k, k * 9) for k in range(60)} <= got


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_latent_search_against_every_window_and_item(spark, table, monkeypatch):
    """On the tables, and with items of which words are replaced: what a search of all windows for all items would find."""
    folder, pick = f"/root/testdata/{table}", random.Random(6)
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    hosts = [(r["text"] or "x").split() for r in docs.select("text").limit(300).collect()]
    rows = []
    for k, r in enumerate(bench.collect()):
        host, other = hosts[k % len(hosts)], hosts[(k * 7 + 1) % len(hosts)]
        rows += [(len(rows) + j, " ".join(host[:60] + [w if pick.random() >= share else pick.choice(other) for w in r["text"].split()] + host[60:120])) for j, share in enumerate((0, 0.15, 0.25, 0.3))]
    for some in (docs.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string")):
        pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(some, bench).collect()}
        got = pairs()
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "LEAST_COSINE", -2.0)
            model = next(iter(decontaminate.models(some, bench)))
            texts = [(r["doc_id"], decontaminate.plain_words(r["text"] or "")) for r in some.collect()]
            want = {(d, x[0]) for (d, _), found in zip(texts, decontaminate.matches(model, [t for _, t in texts])) for x in found}
        assert got <= want and len(got) >= 0.98 * len(want) and want


def test_several_texts_of_one_item_are_one_item(spark):
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, text), (1, text + " more"), (2, "x y z")], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([(5, text + " more"), (6, "a b")], "doc_id long, text string"), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["lcs_share"]) for r in got] == [(5, 1, 1.0)]


def test_an_exact_copy_has_cosine_1(spark):
    pick = random.Random(4)
    items = [(i, " ".join(f"w{pick.randrange(3000)}" for _ in range(PASSAGE))) for i in range(300)]
    docs = spark.createDataFrame(items[:20], "doc_id long, text string")
    got = {r["doc_id"]: r["cosine"] for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).where("doc_id = item_id").collect()}
    assert len(got) == 20 and min(got.values()) > 0.999
