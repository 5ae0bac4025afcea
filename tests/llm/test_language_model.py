import math
import zlib
from collections import Counter

import numpy as np

from pagequarry.llm import language_model as lm
from pagequarry.llm.elias_fano import EliasFano, Trie, dequantise, quantise

from .conftest import ODD


def brute(rows, mu):
    docs = [(i, ["<s>", *(t or "").encode().lower().split(), "</s>"], zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2) for i, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, d, train in docs:
        if train:
            uni.update(d[1:])
            bi.update(zip(d, d[1:]))
            ctx.update(d[:-1])
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, d, _ in docs:
        p = {w: (uni[w] + 1) / (n + v + 1) for w in d}
        base = sum(math.log10(p[w]) for w in d[1:])
        score = sum(math.log10((bi[a, b] + mu * p[b]) / (ctx[a] + mu)) for a, b in zip(d, d[1:]))
        out.append((i, len(d) - 1, sum(uni[w] > 0 for w in d[1:]), n, base, score))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4])) for x in (got, want))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want])
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=2e-4, atol=1e-3)


def test_against_brute_force(docs_of, texts, monkeypatch):
    rows = [*texts, *ODD, (777, "x y " * 30_000)]
    df = docs_of(rows).repartition(3, "doc_id").cache()
    for kw in ({}, {"rows_per_shard": 10, "mu": 50.0}, {"rows_per_shard": 20, "hot_share": 1 / 50}):
        out = lm.score_documents(df, **kw).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        same([tuple(r) for r in out.collect()], brute(rows, kw.get("mu", 2000.0)))
    df.unpersist()


def test_empty_and_untrained(docs_of):
    assert lm.score_documents(docs_of([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(docs_of([(held, "a b")])).first()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (3000, 10), (20_000, 1 << 40)):
        values = np.sort(rng.integers(0, top, n))
        got = EliasFano.encode(values)
        index = rng.integers(0, n, 500) if n else np.zeros(0, int)
        assert got.get(index).tolist() == values[index].tolist()


def test_trie_lookup(tmp_path):
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 400, (5000, 2)), axis=0)
    logs = -rng.random(len(pairs)) * 5
    ids = np.unique(pairs[:, 0])
    Trie.build(str(tmp_path), pairs[:, 0], pairs[:, 1], logs, ids, -ids / 100.0)
    trie, want = Trie(str(tmp_path)), {tuple(p): x for p, x in zip(pairs.tolist(), logs)}
    ask = rng.integers(0, 410, (3000, 2))
    p, b = trie.lookup(ask[:, 0], ask[:, 1])
    assert [bool(x) for x in p] == [tuple(a) in want for a in ask.tolist()]
    assert np.allclose([x for x in dequantise(p) if np.isfinite(x)], [want[tuple(a)] for a in ask.tolist() if tuple(a) in want], atol=2e-4)
    assert all((x > 0) == (c in set(ids.tolist())) for x, c in zip(b, ask[:, 0].tolist()))
    assert quantise(np.array([-20.0, 0.0])).tolist() == [1, 65_535]


def test_nul_is_a_letter(docs_of):
    rows = [(i, f"a\0b c{i % 3} \0 x{i % 2} \0\0 a\0b y z\0 end\0") for i in range(40)] + [(50 + i, "\0 end") for i in range(5)]
    df = docs_of(rows).repartition(2, "doc_id").cache()
    for kw in ({"mu": 5.0}, {"mu": 5.0, "hot_share": 1 / 5, "rows_per_shard": 4}):
        out = lm.score_documents(df, **kw).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        same([tuple(r) for r in out.collect()], brute(rows, 5.0))
    df.unpersist()


def test_tokens_are_split_by_arrow_as_by_bytes():
    texts = [b"", None, b" \t\n\x0b\x0c\r", b"A b\x00C  \xc3\x89\xff A\x1c\x85\xa0z ", b"one", b"\xe3\x80\x80 X\r\nx", b" a" * 50]
    words, sizes = lm._tokens(texts)
    want = [[*(t or b"").lower().split(), lm.END] for t in texts]
    assert words.to_pylist() == [w for d in want for w in d] and sizes.tolist() == [len(d) for d in want]
    batch = lm._Batch(list(range(len(texts))), [True] * len(texts), texts)
    assert batch.words == sorted({w for d in want for w in d})
    assert [batch.words[i] for i in batch.tokens] == [w for d in want for w in d]
