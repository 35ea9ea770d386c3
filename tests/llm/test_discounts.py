"""Operator 2: Good-Turing discounts for the counts of counts that texts with many copies give."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerlake.llm.katz import LARGEST, discounts
from test_models import good_turing, tokens


def counts_of_counts(folder, spark):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    one, two, three = Counter(), Counter(), Counter()
    for r in docs.select("text").collect():
        seq = tokens(r["text"])
        one.update(seq)
        two.update(zip(["\n\n", *seq], seq))
        three.update(zip(["\n\n", "\n\n", *seq], ["\n\n", *seq], seq))
    return [[sum(v == r for v in c.values()) for r in range(1, LARGEST + 2)] for c in (one, two, three)]


def test_good_turing_holds_on_the_tables(spark, small, middle):
    for folder in (small, middle):
        for n in counts_of_counts(folder, spark):
            d = discounts(n)
            assert d[1:] == pytest.approx(good_turing(n)), (folder, n)
            assert 0 < d[1] and (np.diff(d[1:]) > 0).all() and d[-1] < 1


@pytest.mark.parametrize("n", [[9, 4, 2, 1, 3, 1], [10, 20, 30, 40, 50, 60], [100, 0, 5, 0, 0, 0], [7, 0, 0, 0, 0, 1], [1, 0, 0, 0, 0, 0], [5, 5, 5, 5, 5, 5]])
def test_discounts_lie_between_0_and_1(n):
    d = discounts(n)[1:]
    assert ((0 < d) & (d < 1)).all() and (np.diff(d) > 0).all()


def test_nothing_is_discounted_without_events_seen_once():
    assert (discounts([0, 3, 2, 1, 1, 1]) == 1).all() and (discounts([0] * 6) == 1).all()
