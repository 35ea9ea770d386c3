"""Operator 5: the bound on the labelled sample must not move what a score means."""

import numpy as np

from markerlake.llm import toxicity


def test_a_sampled_class_keeps_its_weight():
    pick = np.random.default_rng(1)
    x, y = np.concatenate([pick.normal(0, 1, (40_000, 2)), pick.normal(1, 1, (4_000, 2))]), np.repeat([0.0, 1.0], [40_000, 4_000])

    def scores(kept, weight):
        mean, scale, w = toxicity.logistic(x[kept], y[kept], weight[kept])
        return 1 / (1 + np.exp(-(((x - mean) / scale) @ w[1:] + w[0])))

    kept = (y == 1) | (np.arange(len(y)) % 10 == 0)
    whole = scores(np.ones(len(y), bool), np.ones(len(y)))
    assert np.abs(scores(kept, np.where(y == 1, 1.0, 10.0)) - whole).max() < 0.06
    assert scores(kept, np.ones(len(y))).mean() > 3 * whole.mean()  # what it would be without weights


def test_scores_do_not_rise_with_a_smaller_share_of_ordinary_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = docs.join(labels.where("toxic = 0").select("doc_id"), "doc_id")
    mean = lambda **most: toxicity.score(held, toxicity.train(docs, labels, **most)).where("held_out").agg({"score": "avg"}).first()[0]
    assert mean(ordinary_rows=600) < 1.4 * mean()
