import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pagequarry.llm import queries, sentencepieces

from .conftest import ODD


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.Vocabulary(queries.tokenizer_path())


def all_paths(v, text):
    """Every segmentation of a short text with its probability."""
    out, marked = [], (" " + text).replace(" ", "▁")

    def go(i, ids, weight):
        if i == len(marked):
            out.append((tuple(ids), weight))
            return
        for j in range(i + 1, min(len(marked), i + v.longest) + 1):
            if marked[i:j] in v.weight:
                token, w = v.weight[marked[i:j]]
                go(j, [*ids, token], weight + w)

    go(0, [], 0.0)
    total = sum(math.exp(w) for _, w in out)
    return {p: math.exp(w) / total for p, w in out}


def test_samples_follow_the_lattice(vocabulary):
    lat, text = sentencepieces.Lattices(vocabulary), "the cat sat"
    want = all_paths(vocabulary, text)
    n = 6000
    got = sentencepieces.sample_batch(lat, [text] * n, np.arange(n, dtype=np.uint64), 3)
    first, second = Counter(), Counter()
    for samples in got:
        paths = [tuple(s[0].tolist()) for s in samples]
        assert len(set(paths)) == 3 and all(p in want for p in paths)
        assert all(abs(s[1] - math.log(want[p])) < 1e-9 and 0 < s[2] <= 1 for s, p in zip(samples, paths))
        first[paths[0]] += 1
        second[paths[1]] += 1
    # without replacement: the second is drawn from what the first has left
    expected = {p: sum(want[q] * want[p] / (1 - want[q]) for q in want if q != p) for p in want}
    for seen, probability in ((first, want), (second, expected)):
        for p in sorted(probability, key=probability.get)[-12:]:
            assert abs(seen[p] / n - probability[p]) < 5 * math.sqrt(probability[p] / n)
    # inclusion scores are honest: weighting by them counts every segmentation's probability once
    top = max(want, key=want.get)
    estimate = np.mean([sum(want[top] / s[2] for s in samples if tuple(s[0].tolist()) == top) for samples in got])
    assert abs(estimate - want[top]) < 0.05


def test_small_texts_are_exhausted(vocabulary):
    lat = sentencepieces.Lattices(vocabulary)
    for text in ("", "a", "of"):
        want = all_paths(vocabulary, text)
        (samples,) = sentencepieces.sample_batch(lat, [text], np.array([3], np.uint64), 50)
        assert {tuple(s[0].tolist()) for s in samples} == set(want)
        assert len(samples) == len(want) and all(s[2] == 1.0 for s in samples)


def test_seeds_belong_to_rows(vocabulary):
    texts = [f"some words number {i}\nand  more\tof them" for i in range(30)]
    seeds = np.arange(30, dtype=np.uint64) * np.uint64(77)
    lat = sentencepieces.Lattices(vocabulary)
    one = sentencepieces.sample_batch(lat, texts, seeds, 3)
    for i in (0, 7, 29):
        (alone,) = sentencepieces.sample_batch(sentencepieces.Lattices(vocabulary), texts[i:i + 1], seeds[i:i + 1], 3)
        assert [(a[0].tolist(), round(a[1], 9)) for a in alone] == [(a[0].tolist(), round(a[1], 9)) for a in one[i]]


def test_round_trip(spark, sf, texts):
    rows = queries.op10_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all(r.n_samples == 2 and r.ids_hash[0] != r.ids_hash[1] for r in rows if r.n_chars > 3)


def test_odd_rows(spark, docs_of, vocabulary):
    extra = [(50, "tab\tnew\n\nline\r\n  spaces   "), (51, "emoji 😀 ▁▁ <0x41> <s>"), (52, "y" * 30_000), (53, "\x00nul")]
    df = docs_of([*ODD, *extra]).withColumnRenamed("source", "samples")
    out = sentencepieces.sample_encodings(df, vocabulary, k=2)
    decode = sentencepieces.decode_column(vocabulary)
    rows = out.withColumn("back", decode(out["samples"][0]["ids"])).collect()
    assert len(rows) == len(ODD) + len(extra) and all(r.back == (r.text or "") for r in rows)
    assert sentencepieces.sample_encodings(docs_of([]), vocabulary).count() == 0


def test_long_words_without_spaces(vocabulary):
    lat, raw = sentencepieces.Lattices(vocabulary), vocabulary.piece_bytes()
    letters = "".join(np.random.default_rng(6).choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000))
    texts = [letters, "thequickbrownfoxjumpsoverthelazydogandthen" * 480, "的一是日本語" * 3_000 + "the", "😀" * 5_000 + "the"]
    for n, (text, samples) in enumerate(zip(texts, sentencepieces.sample_batch(lat, texts, np.arange(4, dtype=np.uint64), 3))):
        assert len({tuple(s[0].tolist()) for s in samples}) == 3
        assert all(sentencepieces.decode_ids(s[0], raw) == text for s in samples)
        if n < 2:  # a segmentation of thousands of pieces is about as probable as any other that is drawn
            logs = [s[1] for s in samples]
            assert max(logs) - min(logs) < -0.1 * np.mean(logs)


def test_query_returns_the_token_ids(spark, sf, texts, vocabulary):
    raw, text_of = vocabulary.piece_bytes(), dict(texts)
    for r in queries.op10_sentencepiece(spark, sf).collect():
        assert [len(ids) for ids in r.ids] == r.n_pieces
        assert all(sentencepieces.decode_ids(np.array(ids), raw) == (text_of[r.doc_id] or "") for ids in r.ids)


def test_inclusion_of_long_texts_keeps_its_logarithm(vocabulary):
    lat = sentencepieces.Lattices(vocabulary)
    text = " ".join(f"{w}ing{i}" for i in range(4000) for w in ("walk",))
    (samples,) = sentencepieces.sample_batch(lat, [text], np.array([5], np.uint64), 2)
    assert all(np.isfinite(s[3]) and s[3] < -100 and s[2] == math.exp(s[3]) for s in samples)
    (short,) = sentencepieces.sample_batch(lat, ["the cat"], np.array([5], np.uint64), 2)
    assert all(abs(math.log(s[2]) - s[3]) < 1e-9 for s in short)


def test_bytes_of_pieces_side_by_side(vocabulary):
    raw = vocabulary.piece_bytes()
    pieces = sentencepieces.PieceBytes(raw)
    ids = [np.array(x, np.int64) for x in ([5, 300, 17_000], [], [31_999, 40, 3, 900])]
    assert pieces.spelled(np.concatenate(ids), np.cumsum([len(i) for i in ids])) == [b"".join(raw[j] for j in i) for i in ids]


def test_lattices_of_ever_new_words_take_bounded_memory(vocabulary):
    lat, rng, done = sentencepieces.Lattices(vocabulary), np.random.default_rng(5), 0
    tracemalloc.start()
    try:
        while done < 2_200_000:  # places of words that never come again
            letters = rng.integers(97, 123, sentencepieces.BATCH_CHARS, dtype=np.uint8).tobytes().decode()
            sentencepieces.sample_batch(lat, [" ".join(letters[i:i + 9] for i in range(0, len(letters), 9))], np.ones(1, np.uint64), 2)
            done += len(letters)
        assert tracemalloc.get_traced_memory()[1] < 180e6
    finally:
        tracemalloc.stop()


def test_samples_do_not_depend_on_what_the_cache_holds(vocabulary, monkeypatch):
    texts, seeds = [f"word{i} naïve ☃ {i * i}  end" for i in range(40)], np.arange(40, dtype=np.uint64)
    want = sentencepieces.sample_batch(sentencepieces.Lattices(vocabulary), texts, seeds, 2)
    monkeypatch.setattr(sentencepieces, "CACHE_NODES", 50)  # cleared again and again
    lat = sentencepieces.Lattices(vocabulary)
    for i, samples in enumerate(want):
        got = sentencepieces.sample_batch(lat, texts[i:i + 1], seeds[i:i + 1], 2)[0]
        assert [s[0].tolist() for s in got] == [s[0].tolist() for s in samples]
        assert np.allclose([s[1:] for s in got], [s[1:] for s in samples], rtol=1e-9)


def test_words_of_one_batch_leave_room_for_those_that_come_again(vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_NODES", 200)
    lat, built = sentencepieces.Lattices(vocabulary), Counter()
    add = lat.add
    monkeypatch.setattr(lat, "add", lambda words: built.update(words) or add(words))
    for i in range(60):
        sentencepieces.sample_batch(lat, [f"walking home {i * 7919 + 100_003} {i * 104_729 + 100_003}"], np.array([i], np.uint64), 2)
        assert lat.nodes < 200
    assert built[" home"] == 2  # once for its first batch, once to stay
