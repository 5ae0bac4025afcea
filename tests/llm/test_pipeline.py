import hashlib
import re

import corpus_pipeline
from pagequarry.llm import queries

from .conftest import ODD
from .test_decontaminate import brute


def test_stages_keep_columns_and_take_effect(spark, sf, docs_of, texts):
    rng_words = [f"word{i}" for i in range(400)]
    own = " ".join(rng_words)
    near = " ".join(rng_words[:200] + ["other"] + rng_words[201:])
    item = next(r for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) >= 10)
    rows = [*texts, *ODD, (10_001, own), (10_002, near), (10_003, own), (10_004, f"before {item.text} after"), (10_005, "write to someone@mail.example.com " + " ".join(rng_words[::-1]))]
    docs = docs_of(rows).cache()
    docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in docs.collect()}
        if name == "near duplicates":
            assert 10_001 in ids and not ids & {10_002, 10_003}
        if name == "decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = [r[0] for r in brute([(r.doc_id, r.text) for r in before.collect()], items) if not r[5]]
            assert sorted(ids, key=str) == sorted(set(clean), key=str) and 10_004 not in ids
        if name == "personal data":
            assert not any(re.search("someone@", r.text or "") for r in docs.collect())
    assert 10_005 in ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and all(r.round_trip for r in last.collect())


def test_empty_table(spark, sf, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic, clean = [d for d in labels if labels[d]], [d for d in labels if not labels[d]]
    assert sum(d in kept for d in toxic) / len(toxic) < 0.3 and sum(d in kept for d in clean) / len(clean) > 0.9


def test_rows_are_told_apart_by_id_and_text(spark, sf, docs_of):
    def text(name, changed=None):
        return " ".join("changed" if i == changed else f"{name}{i}" for i in range(100))

    rows = [
        (1, text("a")), (1, text("b")), (1, text("c")), (1, text("c")),  # three texts under one id, one of them twice
        (2, text("a", 50)), (3, text("d")), (None, text("d", 3)), (None, text("d")),  # copies of documents that have an id
        (None, text("e")), (None, text("e", 9)), (None, text("f")), (4, text("b")),
    ]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), sf).collect()
    least = min(text("e"), text("e", 9), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = [(1, text("a")), (1, text("b")), (1, text("c")), (3, text("d")), (None, least), (None, text("f"))]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, want))
