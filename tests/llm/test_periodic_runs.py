import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import periodic_runs, queries

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


def brute(codes, least=24, powers=3):
    """Every lag over every word."""
    x, out = np.asarray(codes), []
    for q in range(1, len(x) // powers + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in edges.reshape(-1, 2).tolist():
            n = b - a + q
            if n >= max(least, powers * q) and smallest_period(x[a:a + n].tolist()) == q:
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    seen = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def expected(doc_id, text):
    """One row of the query by its contract, word by word."""
    words = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(numbered(words))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = [None] * 4
    if runs:
        from fractions import Fraction

        s, m, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = [s, m, q, 1000 * m // q]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)))


def test_query_against_brute_force(spark, sf, texts):
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect())
    assert got == [expected(*t) for t in texts]
    assert sum(r[1] > 0 for r in got) >= 10


def found_in(lists, least, powers):
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([c + 1000 * i for i, x in enumerate(lists) for c in x], np.int64)
    return periodic_runs.runs_of_texts(flat, sizes, least, powers)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), st.integers(1, 12), st.integers(3, 5))
def test_small_alphabets(lists, least, powers):
    assert found_in(lists, least, powers) == [brute(x, least, powers) for x in lists]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9)), max_size=6))
def test_nested_repeats(parts):
    text = [c for block, times in parts for c in block * times]
    assert found_in([text], 8, 3) == [brute(text, 8, 3)]


def test_fibonacci_and_thue_morse_words():
    fibonacci, thue = [0], [0]
    previous = [1]
    while len(fibonacci) < 1500:
        fibonacci, previous = fibonacci + previous, fibonacci
    while len(thue) < 2048:
        thue += [1 - c for c in thue]
    for word in (fibonacci, thue, [0] * 3000, [0, 1] * 900 + [2] + [0, 1] * 900):
        assert found_in([word], 24, 3) == [brute(word)]


def test_classes_cover_every_lag_once():
    for least in (1, 5, 24, 100):
        for powers in (3, 4):
            lags = [q for low, high, _ in periodic_runs.lag_classes(least, powers, 5000) for q in range(low, high + 1)]
            assert lags == list(range(1, len(lags) + 1)) and len(lags) >= 5000 // powers
            for low, high, k in periodic_runs.lag_classes(least, powers, 5000):
                assert k >= high and all(max(least, powers * q) - q >= k for q in range(low, high + 1))
    with pytest.raises(ValueError):
        list(periodic_runs.lag_classes(24, 2, 100))


def test_odd_rows(spark, docs_of):
    long = " ".join(["alpha beta"] * 60_000)
    rows = [*ODD, (50, long), (51, "tick " * 24), (52, "tick " * 23), (52, "tick " * 23)]
    docs = docs_of(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "__bytes")
    got = periodic_runs.collapse_runs(docs.select("doc_id", "text", "runs"))
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    out = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    want = []
    for d, t in rows:
        runs = {50: [(0, 120_000, 2)], 51: [(0, 24, 1)]}.get(d, [])
        want.append((str(d), runs, {50: "alpha beta", 51: "tick"}.get(d) or " ".join(WORD.findall(t or ""))))
    assert out == sorted(want)
    assert periodic_runs.collapse_runs(docs_of([])).count() == 0
