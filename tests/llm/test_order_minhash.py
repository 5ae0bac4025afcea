import hashlib

from pyspark.sql import functions as F

from pagequarry.llm import order_minhash as om
from pagequarry.llm import queries

from .conftest import ODD


def brute_signature(spark, text, k=3, bins=64, size=2):
    """The definition, with Spark's hash of each numbered k-mer taken one by one."""
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return []
    kmers = [words[i:i + k] for i in range(max(1, len(words) - k + 1))]
    hashed = spark.createDataFrame([(i, *(w + [None] * (k - len(w)))) for i, w in enumerate(kmers)], "i int, a string, b string, c string").select("i", F.xxhash64("a", "b", "c").alias("h")).collect()
    seen, numbered = {}, []
    for r in sorted(hashed, key=lambda r: r.i):
        h = (r.h % (1 << 64)) >> 25
        occurrence = seen.get(h, 0)
        seen[h] = occurrence + 1
        numbered.append((r.i, h, occurrence))
    ranks = spark.createDataFrame(numbered, "i int, h long, o int").select("i", F.xxhash64("h", "o").alias("v")).collect()
    per = {}
    for r in ranks:
        per.setdefault(r.v % bins, []).append(((r.v % (1 << 64)) >> 32, r.i))
    tuples = [(b, [x for x, _ in sorted(sorted(v)[:size], key=lambda y: y[1])]) for b, v in sorted(per.items())]
    out = spark.createDataFrame(tuples, "b int, t array<long>").select("b", F.xxhash64("t").alias("x")).collect()
    return [r.b << 32 | (r.x % (1 << 64)) >> 32 for r in sorted(out, key=lambda r: r.b)]


def test_signature_is_the_definition(spark, docs_of):
    rows = [(1, "a b c d e f a b c a b c " * 6), (2, "one"), (3, "one two"), (4, " ".join(f"w{i}" for i in range(300))), (5, "x " * 50)]
    got = {r.doc_id: r.s for r in docs_of(rows).select("doc_id", om.order_minhash(F.col("text")).alias("s")).collect()}
    for i, text in rows:
        assert got[i] == brute_signature(spark, text)


def test_query(spark, sf, texts):
    out = {r.doc_id: r for r in queries.op8_order_minhash(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    by_text = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        assert out[d].n_chars == len(t)
        assert out[d].edited_sha256 == hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()
        assert by_text.setdefault(t, out[d].fingerprint) == out[d].fingerprint
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
    long = [r for r in out.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) > 3 * sum(r.near_next for r in long)


def test_likeness_falls_with_order_and_edits(docs_of):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    one = words[:50] + ["new"] + words[51:]
    df = docs_of([(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(one)), (4, " ".join(words))])
    s = {r.doc_id: r.s for r in df.select("doc_id", om.order_minhash(F.col("text")).alias("s")).collect()}

    def alike(a, b):
        return len(set(s[a]) & set(s[b])) / len({x >> 32 for x in s[a] + s[b]})

    assert alike(1, 4) == 1 and 0.8 < alike(1, 3) < 1 and alike(1, 2) < alike(1, 3)


def test_next_rows_over_many_buckets(spark):
    for ids in ([*range(0, 3000, 7)], [1], [], [5, 5, 5, 9], [*range(50), *range(10**12, 10**12 + 50)], [None, 3, None]):
        df = spark.createDataFrame([(i, f"t{i}-{n}") for n, i in enumerate(ids)], "i long, t string").withColumn("tie", F.xxhash64("t"))
        got = [(r.i, r.next_i) for r in om.with_next(df, "i", "tie", ["i"], rows=1).collect()]
        order = sorted((i for i in ids if i is not None), reverse=True) + [i for i in ids if i is None]
        assert sorted(got, key=str) == sorted(zip(order, order[1:] + order[:1]), key=str)


def test_odd_rows(docs_of, spark):
    df = docs_of(ODD).withColumn("tie", F.xxhash64("text"))
    s = df.withColumn("print", om.order_minhash(F.col("text")))
    rows = om.with_next(s, "doc_id", "tie", ["text", "print"]).select("text", om.likeness(F.col("print"), F.col("next_print")).alias("x"), F.size("print").alias("n")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.x <= 1 for r in rows)
    assert all((r.n == 0) == (not (r.text or "").strip()) for r in rows)
