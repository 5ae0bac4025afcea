import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagequarry.llm import queries, token_files
from pagequarry.session import shared_folder

from .conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.bpe_path())


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_query_against_whole_texts(spark, sf, texts, tokenizer):
    want, start = [], 0
    for doc_id, text in texts:
        ids = plain(tokenizer, text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op13_token_files(spark, sf).collect()) == want


def encoded(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    assert ids.dtype == encoder.dtype
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else ids.tolist()


@pytest.fixture(scope="module")
def encoder():
    return token_files.CachedTokenizer(queries.bpe_path(), 2, cached=50)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'’ 1.\t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000é日\u0301<|>"), max_size=40), max_size=5))
def test_pieces_give_the_ids_of_the_text(encoder, tokenizer, texts):
    assert encoded(encoder, texts) == [plain(tokenizer, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from("abc.1'"), min_size=1, max_size=4), max_size=20).map(" ".join), max_size=9))
def test_texts_of_plain_words(encoder, tokenizer, texts):
    assert encoded(encoder, texts) == [plain(tokenizer, t) for t in texts]


def test_special_strings_and_long_pieces(tokenizer):
    encoder = token_files.CachedTokenizer(queries.bpe_path(), 2)
    for text in ("a <|endoftext|> b", "we'll  see   it's \n\n x", "z" * 5000 + " y " + "日本" * 900, "it 's ' t", " lead and trail ", " ", ""):
        for _ in range(2):  # once computed, once looked up
            assert encoded(encoder, [text, "x", text]) == [plain(tokenizer, t) for t in (text, "x", text)]


def test_words_are_kept_in_arrow_and_replaced(tokenizer):
    encoder = token_files.CachedTokenizer(queries.bpe_path(), 2, cached=6)
    for text, kept in (("x ab cd ab", {"ab", "cd", "x"}), ("x ef  gh cd ij", {"ab", "cd", "x", "ef  gh", "ij"}), ("x kl mn", {"kl", "mn", "x"}), ("x ab kl", {"kl", "mn", "x", "ab"})):
        assert encoded(encoder, [text]) == [plain(tokenizer, text)]
        assert set(encoder.words.to_pylist()) <= kept | {"x"} and len(encoder.words) <= 6
    assert {"kl", "ab"} <= set(encoder.words.to_pylist())


def write(spark, docs, **options):
    folder = shared_folder(spark, "test-tokens")
    token_files.write_token_files(docs, folder, queries.bpe_path(), 2, **options)
    return folder


def test_parts_sequences_and_masks(spark, docs_of, texts, tokenizer):
    """Several small parts: order, padding, random access, views of the file."""
    folder = write(spark, docs_of(texts[:80]), length=32, per_batch=4, file_bytes=40_000)
    parts = sorted(r.part for r in spark.read.parquet(f"{folder}/manifest").collect())
    assert len(parts) > 2
    stream = []
    for part in parts:
        file = token_files.SequenceFile(folder, part)
        rows = [file[i] for i in range(len(file))]
        assert all(len(ids) == len(mask) == 32 for ids, mask in rows)
        assert all(not ids.flags.owndata for ids, _ in rows)
        stream += [int(i) for ids, mask in rows for i, on in zip(ids, mask.to_pylist()) if on]
        assert all(all(mask.to_pylist()) for _, mask in rows[:-1])
        with pytest.raises(IndexError):
            file[len(file)]
    assert stream == [i for _, text in texts[:80] for i in plain(tokenizer, text)]


def test_odd_rows_and_ties(spark, docs_of, tokenizer):
    rows = [*ODD, (70, "long " * 40_000), (70, "other"), (-5, "minus")]
    docs = docs_of(rows).withColumnRenamed("lang", "tie").withColumnRenamed("source", "place").withColumnRenamed("n_chars", "id")
    folder = write(spark, docs, file_bytes=100)
    got = token_files.read_documents(spark, folder, docs.schema["doc_id"].dataType).orderBy("start").collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), plain(tokenizer, t)) for i, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    empty = write(spark, docs.where("1 = 0"))
    assert token_files.read_documents(spark, empty, docs.schema["doc_id"].dataType).count() == 0


def test_frequent_id_is_spread_over_parts(spark, docs_of):
    """A third of all rows under one id, most of them equal, do not share a part."""
    rows = [(7 if i % 3 == 0 else i, "same words here" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    folder = write(spark, docs_of(rows), file_bytes=8_000)
    sizes = [r.n_docs for r in spark.read.parquet(f"{folder}/manifest").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 900


def test_files_of_lost_attempts_are_not_read(spark, docs_of):
    folder = write(spark, docs_of([(1, "a b"), (2, "c")]))
    local = token_files._open(folder)[1]
    with open(os.path.join(local, "part-000099.arrow"), "wb") as f:
        f.write(b"left behind")
    assert token_files.read_documents(spark, folder, docs_of([]).schema["doc_id"].dataType).count() == 2
