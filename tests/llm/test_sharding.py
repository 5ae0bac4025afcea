from collections import Counter

from pyspark.sql import functions as F

from pagequarry.llm import queries, sharding

from .conftest import ODD


def serial(keys_by_cell, shards, vnodes, bits, slack):
    """Serve cells one by one, keys one by one, as a single machine would: each step away from home in turn."""
    owners, n = sharding.ring_owners(shards, vnodes, bits), sum(map(len, keys_by_cell.values()))
    room = [n // shards + (s < n % shards) for s in range(shards)] if not slack else [-int(-n * (1 + slack) // shards)] * shards
    placed, waiting = {}, [(c, k) for c in sorted(keys_by_cell) for k in keys_by_cell[c]]
    route = {}
    for c in keys_by_cell:
        seen = []
        for i in range(len(owners)):
            s = owners[(c + i) % len(owners)]
            if s not in seen:
                seen.append(s)
        route[c] = seen
    for step in range(shards):
        rest = []
        for c, k in waiting:
            s = route[c][step]
            if room[s]:
                room[s] -= 1
                placed[k] = s
            else:
                rest.append((c, k))
        waiting = rest
    return placed


def test_place_is_the_serial_walk():
    for slack in (0.0, 0.1):
        counts = {c: (c * 7919) % 13 for c in range(0, 1024, 3) if (c * 7919) % 13}
        keys = {c: [(c, i) for i in range(n)] for c, n in counts.items()}
        got = {(c, i): s for c, a, b, s, _ in sharding.place(counts, 7, 8, 10, slack) for i in range(a, b)}
        assert got == serial(keys, 7, 8, 10, slack)


def test_full_query(spark, sf):
    rows = queries.op1_bounded_ring(spark, sf).collect()
    per = Counter(r.shard for r in rows)
    assert len(per) == 40 and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))


def test_movement_is_limited_with_slack(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = {r.k: r.shard for r in sharding.assign_shards(df, "k", 20, slack=0.25).collect()}
    b = {r.k: r.shard for r in sharding.assign_shards(df, "k", 21, slack=0.25).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)


def test_a_key_with_half_of_the_rows_is_spread(spark):
    half = F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(6_000).select(half.alias("k"), F.col("id").alias("tie"), F.lit("a").alias("cell"), F.lit("b").alias("row"), F.lit("c").alias("__rank"))
    out = sharding.assign_shards(df, "k", 9, tie_columns=("tie",))
    assert out.columns == ["k", "tie", "cell", "row", "__rank", "shard", "slot"]
    rows = out.collect()
    assert sorted(r.tie for r in rows) == list(range(6_000))
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(per[s])) for s in per)
    # the same rows from other partitions give the same places
    again = sharding.assign_shards(df.repartition(13, "tie"), "k", 9, tie_columns=("tie",)).collect()
    assert {r.tie: (r.shard, r.slot) for r in rows} == {r.tie: (r.shard, r.slot) for r in again}
    parts = Counter(r.p for r in df.where("k = 7").select(F.pmod(F.xxhash64("k", "tie"), F.lit(sharding.PARTS)).alias("p")).collect())
    assert len(parts) == sharding.PARTS and max(parts.values()) < 200


def test_movement_without_slack(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a, b = ({r.k: r.shard for r in sharding.assign_shards(df, "k", n).collect()} for n in (40, 41))
    assert sum(a[k] != b[k] for k in a) < 0.1 * len(a)


def test_odd_rows_and_clashing_columns(docs_of):
    df = docs_of(ODD).withColumnRenamed("source", "shard").withColumnRenamed("lang", "slot")
    out = sharding.assign_shards(df, "doc_id", 4)
    assert out.columns == ["doc_id", "text", "n_chars", "shard", "slot"] and out.count() == len(ODD)
    assert sharding.assign_shards(df.where("1 = 0"), "doc_id", 4).count() == 0
