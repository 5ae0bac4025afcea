import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import queries, spelling_variants

from .conftest import ODD

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    """One code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def brute_words(rows, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def brute_groups(counts, ratio=5):
    near = {w: [] for w in counts}
    for a in counts:
        for b in counts:
            if abs(len(a) - len(b)) <= 1 and len(a) >= 4 and len(b) >= 4 and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * max(1, counts[w]) else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def grouped(df):
    return sorted(tuple(r) for r in spelling_variants.group_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_query_against_brute_force(spark, sf, texts):
    got = queries.op12_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect())
    assert got == brute_groups(brute_words(texts))
    assert any(r[3] for r in got) and any(r[2] == 0 for r in got)


def found_pairs(words, frequency):
    """The pairs that the index meets, before they are verified."""
    entries = [(w, *e) for w in words for e in spelling_variants.index_entries(w, frequency)]
    return {
        tuple(sorted((a, b)))
        for a, pivot, key, last in entries if pivot
        for b, other_pivot, other_key, other_last in entries if not other_pivot and key == other_key and last <= other_last and a != b
    }


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abÿ", min_size=4, max_size=9), min_size=2, max_size=14, unique=True), st.integers(0, 5))
def test_no_pair_is_lost(words, seed):
    frequency = np.random.default_rng(seed).integers(0, 4, spelling_variants.BUCKETS)  # any order is exact
    near = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert near <= found_pairs(words, frequency)


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 12)), min_size=3, max_size=8, unique_by=lambda g: g[1]))
def test_pivots_are_the_cheapest_disjoint_bigrams(grams):
    grams = [(f, "xx", at) for f, at in grams]
    pairs = [(a, b) for a in grams for b in grams if b[2] - a[2] >= 2]
    got = spelling_variants.pivots_of(grams)
    if pairs:
        assert len(got) == 2 and abs(got[0][2] - got[1][2]) >= 2
        assert got[0][0] + got[1][0] == min(a[0] + b[0] for a, b in pairs)
    else:
        assert got == []


def test_chains_ties_and_odd_rows(spark, docs_of):
    long = "x" * 3000
    counts = {
        "letter": 3000, "leter": 600, "leterr": 100, "leterrs": 20, "leterrsz": 4, "banana": 50, "banane": 50, "bananes": 10, "naïve": 9, "naive": 45,
        "abc": 9, "abd": 90, "": 5, long: 100, long + "y": 20,
    }
    rows = [*counts.items(), (None, 7), ("zero", None)]
    split = [(w, n // 2 if n else n) for w, n in rows] + [(w, n - n // 2 if n else n) for w, n in rows]
    df = spark.createDataFrame([(w, n, 1, 2) for w, n in split], "word string, n long, form int, key int")
    got = grouped(df)
    assert got == brute_groups({**counts, "zero": 0})
    assert {r[0]: r[5] for r in got}["leterrsz"] == "letter"
    assert {r[0]: r[3] for r in got}["bananes"] == "banane"
    assert grouped(df.where("1 = 0")) == []
    assert queries.spelled_words(docs_of([]), 6, 5).count() == 0
    words = {r.word: r.n for r in queries.spelled_words(docs_of([*ODD, (31, "Étranger ÉTRANGER " * 3 + "short a1b2")]), 6, 2).collect()}
    assert words == brute_words([*ODD, (31, "Étranger ÉTRANGER " * 3 + "short a1b2")], 2)
