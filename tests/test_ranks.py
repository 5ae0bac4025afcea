"""Rows by place against sorted lists."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators.ranks import rows_in_order
from pagequarry.plans.finder import paginate


def place(v):
    return (v is not None, v if v is not None else 0)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    day = datetime.datetime(2024, 10, 27)
    rows = []
    for i in range(3_000):
        word = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"w{rng.randrange(400)}"
        rows.append((i, word, rng.random(), day + datetime.timedelta(seconds=rng.randrange(90_000))))
    df = spark.createDataFrame(rows, "i int, word string, x double, at timestamp").repartition(5).cache()
    df.count()
    return rows, df


@pytest.mark.parametrize("first,size", [(0, 7), (40, 100), (1_500, 25), (2_990, 50), (3_000, 5), (9_999, 5), (10, 0), (0, 3_000)])
def test_any_column(table, first, size):
    rows, df = table
    for keys, order in ((["x"], lambda r: r[2]), (["word", "i"], lambda r: (place(r[1])[0], r[1] or "", r[0])), (["at", "i"], lambda r: (r[3], r[0]))):
        want = [r[0] for r in sorted(rows, key=order)][first : first + size]
        got = [r.i for r in rows_in_order(df, keys, first, size, enough=60, sample=200, parts=8).collect()]
        assert got == want, keys


def test_equal_keys_stay_whole(table):
    rows, df = table
    words = sorted((r[1] for r in rows), key=lambda w: (w is not None, w or ""))
    for first in (0, 30, 700, 1_000):
        got = [r.word for r in rows_in_order(df, ["word"], first, 20, enough=10, sample=64, parts=4).collect()]
        assert got == words[first : first + 20]


def test_sorts_the_last_range_only(table):
    _, df = table
    page = rows_in_order(df, ["i"], 2_000, 10, enough=100, sample=500, parts=16)
    left = page._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in left and [r.i for r in page.collect()] == list(range(2_000, 2_010))


def test_pages(spark, table):
    _, df = table
    assert [r.i for r in paginate(df, "i", 3, 7).collect()] == list(range(21, 28))
    assert [r.i for r in paginate(df, "i", 10_000, 7).collect()] == list(range(2_996, 3_000))
    empty = spark.createDataFrame([], "i int, word string")
    assert paginate(empty, "i", 2, 7).collect() == [] and rows_in_order(empty, ["word"], 0, 3).collect() == []
    with pytest.raises(ValueError):
        rows_in_order(df, ["i"], -1, 2)
    clash = df.withColumn("part", F.lit(1)).withColumn("n", F.lit(2))
    assert [r.n for r in rows_in_order(clash, ["n", "i"], 100, 2, enough=50).collect()] == [2, 2]
