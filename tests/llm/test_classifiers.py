import tracemalloc
import zlib

import numpy as np

from pagequarry.llm import quality, queries, toxicity

from .conftest import ODD


def accuracy(spark, sf, df, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in df.collect() if r.held_out and r.doc_id in labels]
    return sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows), rows


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    share, rows = accuracy(spark, sf, queries.op3_toxicity(spark, sf), "toxic")
    assert share > 0.85 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    share, rows = accuracy(spark, sf, queries.op4_quality(spark, sf), "quality")
    assert share > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_misspellings_share_subwords():
    toxic = [(f"a plain text with {w} in it number {i}".encode(), 1) for i in range(60) for w in ("horrible", "nasty")]
    clean = [(f"a plain text with {w} in it number {i}".encode(), 0) for i in range(60) for w in ("lovely", "decent")]
    model = toxicity.train(toxic + clean, epochs=10)
    margin, _ = model.margins()

    def add(word):
        return margin[toxicity.subwords([word], len(margin), 3, 5)[0]].mean()

    assert add("horrrible") > add("plain") and add("horible") > add("lovely")


def test_odd_rows(docs_of):
    tox = toxicity.train([(b"bad text", 1), (b"good text", 0)] * 5)
    qual = quality.train([(b"bad text " * 40, 0), (b"a good other text " * 30, 1)] * 20, 0.5)
    for module, model in ((toxicity, tox), (quality, qual)):
        df = docs_of([*ODD, (77, "long " * 200_000)]).withColumnRenamed("lang", "score")
        out = module.score_texts(df, model)
        assert sorted(out.columns) == sorted(df.columns)
        rows = out.collect()
        assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not r.text}) == 1
        assert module.score_texts(docs_of([]), model).count() == 0


def test_no_labels():
    assert toxicity.train([]).margins()[1] == 0
    assert abs(quality.train([(b"x", 1)], 0.5).weights[2]) > 0


def test_memory_of_new_words_is_that_of_a_part():
    words = [f"w{i * 7919 % 1_000_003}x" for i in range(60_000)]
    margin = np.random.default_rng(3).normal(size=1 << 12).astype(np.float32)
    tracemalloc.start()
    try:
        got = np.fromiter((m for _, m in toxicity.word_margins(words, margin, 3, 5)), float, len(words))
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()
    flat, sizes = toxicity.subwords(words, len(margin), 3, 5)  # all at once
    assert (got == np.add.reduceat(margin[flat], np.cumsum(sizes) - sizes) / sizes).all()
    assert [w for w, _ in toxicity.word_margins(words, margin, 3, 5)] == words


def test_training_keeps_words_instead_of_their_buckets():
    rng = np.random.default_rng(3)
    words = np.array([f"{x:x}{x * 7:x}" for x in rng.integers(1 << 20, 1 << 30, 3_000).tolist()])
    rows = [(" ".join(words[rng.integers(0, len(words), 300)]).encode(), i % 2) for i in range(1_000)]
    tracemalloc.start()
    try:
        toxicity.train(rows, buckets=1 << 14, epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()
