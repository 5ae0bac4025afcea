"""Addresses of groups of any size against the comparison of all pairs in a row."""

import random
import time

from pyspark.sql import functions as F

from pagequarry.functions.addresses import finalize_addresses
from pagequarry.operators.addresses import distinct_addresses

SCHEMA = "site string, ord int, address string"


def test_as_by_all_pairs(spark):
    rng = random.Random(11)
    streets, cities = ["Main Street", "Elm Road", "Main  Street West", "Old Main Street"], ["", "Springfield", "Springfield, IL", "Springfield, IL 62704", "Leeds | UK"]
    rows = []
    for i in range(1_500):
        text = ", ".join(x for x in (f"{rng.randrange(1, 130)} {rng.choice(streets)}", rng.choice(["", f"Suite {rng.randrange(1, 30)}"]), rng.choice(cities)) if x)
        text = rng.choice([text, text.upper(), "Address: " + text, text.replace(",", ";"), text + "é"])
        rows.append((rng.choice(["a.org", "a.org", "b.org", None]), i, rng.choice([text] * 30 + [None, "", "Pakistan", "x", "no number or comma here"])))
    df = spark.createDataFrame(rows, SCHEMA)
    got = distinct_addresses(df.withColumn("__gram", F.lit("clash")), ["site"], ["ord"])
    assert got.columns == ["site", "address"]
    by_pairs = df.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "address"))).alias("a"))
    by_pairs = by_pairs.select("site", F.explode(finalize_addresses(F.filter(F.transform("a", lambda x: x["address"]), lambda x: x.isNotNull()))).alias("address"))
    want = sorted(map(tuple, by_pairs.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 50 < len(want) < 1_400 and any(w[0] is None for w in want)


def test_empty(spark):
    assert distinct_addresses(spark.createDataFrame([], SCHEMA), ["site"], ["ord"]).collect() == []


def test_one_site_of_50_000(spark):
    n = 50_000
    streets = spark.range(n).select(F.lit("a.org").alias("site"), F.col("id").cast("int").alias("ord"), F.format_string("%d Main Street, Suite 5, Springfield, IL 62704", "id").alias("address"))
    inner = spark.range(200).select(F.lit("a.org").alias("site"), F.lit(-1).alias("ord"), F.format_string("%d Main Street, Suite 5", F.col("id") + 10_000).alias("address"))
    began = time.monotonic()
    got = distinct_addresses(streets.unionByName(inner).unionByName(streets), ["site"], ["ord"]).collect()
    # a house number that ends a longer one lies inside it, so of 0 to 49,999 those of five digits stay
    assert sorted(int(r.address.split()[0]) for r in got) == [*range(10_000, n)]
    assert time.monotonic() - began < 60


def test_runs_are_not_broadcast(spark):
    rows = [("a.org", i, f"{i} Main Street, Springfield") for i in range(200)]
    plan = distinct_addresses(spark.createDataFrame(rows, SCHEMA), ["site"], ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
