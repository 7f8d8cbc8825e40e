"""Deep pages by ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.library import page_of


@pytest.mark.parametrize("page", [0, 3, 17, 39, 40, 50])
def test_same_page_at_any_depth(spark, page):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, "a", "b", "c" * rnd.randint(1, 3)])) for i in range(1003)]
    df = spark.createDataFrame(rows, "paper_id long, title string").repartition(5)
    for order, key in (([F.asc_nulls_last("title"), F.asc("paper_id")], lambda r: (r[1] is None, r[1] or "", r[0])),
                       ([F.desc_nulls_first("title"), F.asc("paper_id")], None)):
        plain = [tuple(r) for r in page_of(df, order, page, 25).collect()]
        deep = [tuple(r) for r in page_of(df, order, page, 25, shallow=0).collect()]
        assert plain == deep
        if key:
            assert plain == sorted(rows, key=key)[page * 25 : page * 25 + 25]


def test_an_empty_selection(spark):
    df = spark.range(10).select(F.col("id").alias("paper_id")).filter("paper_id < 0")
    assert page_of(df, [F.asc("paper_id")], 2, 5, shallow=0).collect() == []
