"""Groups of spelling variants: words one edit apart, found by pivotal bigrams.

Bigrams are ordered from rare to frequent.  A word's *prefix* holds its three rarest bigrams (with all that tie with the
third by value), its *pivots* are the two disjoint bigrams of the prefix with the least total frequency, chosen by dynamic
programming.  One edit spoils at most one of two disjoint bigrams, so of two words one edit apart, the one whose prefix ends
earlier in the order has a pivot that survives in the other's prefix.  Position limits: the edit lies on one side of the
surviving bigram, so the bigram moves by the difference of the lengths or not at all, and the part of the word on its other
side is equal.  Pivots and prefix entries are therefore joined on bigram, position, length and the equal side; every pair is
then verified by edit distance.

The order needs frequencies only to be fast, never to be right; they are counted in ``BUCKETS`` hash classes, so the driver
sees at most that many numbers whatever the alphabet or the vocabulary.

A word's *form* is its most frequent near word (ties: the smallest in code-point order) if that is at least ``ratio`` times
as frequent; forms grow by that factor, so chains are logarithmic and roots are found by a few pointer doublings.

Edge cases: null words are left out, repeated rows of a word add up (null counts are zero), words of fewer than four code
points have no two disjoint bigrams and therefore no near words; very long words are compared like others; an empty table
gives an empty result; columns other than word and count are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import ascii_lower

BUCKETS = 1 << 16

Gram = tuple[int, str, int]  # frequency, bigram, position


def prefix_of(word: str, frequency: np.ndarray) -> list[Gram]:
    """The three first bigrams in the order, and all others that equal the third."""
    grams = sorted((int(frequency[zlib.crc32(word[i:i + 2].encode()) % BUCKETS]), word[i:i + 2], i) for i in range(len(word) - 1))
    return [g for g in grams if g[:2] <= grams[min(2, len(grams) - 1)][:2]]


def pivots_of(prefix: list[Gram], count: int = 2) -> list[Gram]:
    """``count`` pairwise disjoint bigrams of least total frequency."""
    grams = sorted(prefix, key=lambda g: g[2])
    # best[k][j]: cost and choice of k disjoint bigrams among the first j
    best: list[list[tuple[float, tuple[Gram, ...]]]] = [[(0, ())] * (len(grams) + 1)]
    for _ in range(count):
        row: list[tuple[float, tuple[Gram, ...]]] = [(math.inf, ())]
        for j, gram in enumerate(grams):
            free = j
            while free and grams[free - 1][2] > gram[2] - 2:
                free -= 1
            cost, chosen = best[-1][free]
            row.append(min(row[-1], (cost + gram[0], (*chosen, gram)), key=lambda c: c[0]))
        best.append(row)
    return list(best[-1][-1][1])


def _key(gram: str, place: int, length: int, side: str, rest: str) -> int:
    return xxhash.xxh64_intdigest(f"{gram}\0{place}\0{length}\0{side}\0{rest}".encode()) - (1 << 63)


def index_entries(word: str, frequency: np.ndarray) -> Iterator[tuple[bool, int, str]]:
    """``(is a pivot, key, last bigram of the prefix)``: what is looked up for a word, and under what it is found."""
    if len(word) < 4:
        return
    prefix, n = prefix_of(word, frequency), len(word)
    last = f"{prefix[-1][0]:020d}{prefix[-1][1]}"
    for _, gram, at in prefix:
        yield False, _key(gram, at, n, "l", word[:at]), last
        yield False, _key(gram, at, n, "r", word[at + 2:]), last
    for _, gram, at in pivots_of(prefix):
        for other in (n - 1, n, n + 1):
            yield True, _key(gram, at, other, "l", word[:at]), last  # the edit is on the right
            yield True, _key(gram, at + other - n, other, "r", word[at + 2:]), last


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (``a < b``) of values of ``word`` that are one inserted, deleted or replaced code point apart."""
    bigrams = words.select(F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), p -> substring(word, p, 2))")).alias("g"))
    counted = bigrams.groupBy((F.crc32(F.col("g").cast("binary")) % BUCKETS).cast("int").alias("b")).count().collect()
    frequency = np.zeros(BUCKETS, np.int64)
    for row in counted:
        frequency[row["b"]] = row["count"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, *entry) for w in batch["word"] for entry in index_entries(w, frequency)]
            yield pd.DataFrame(rows, columns=["word", "pivot", "key", "last"])

    entries = materialize(words.select("word").mapInPandas(run, "word string, pivot boolean, key long, last string"), "bigrams")
    pivots = entries.where("pivot").select("key", F.col("word").alias("a"), F.col("last").alias("a_last")).distinct()
    found = entries.where("not pivot").select("key", F.col("word").alias("b"), F.col("last").alias("b_last")).distinct()
    pairs = pivots.join(found, "key").where("a_last <= b_last and a <> b and levenshtein(a, b, 1) = 1")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_variants(words: DataFrame, word: str = "word", n: str = "n", ratio: int = 5) -> DataFrame:
    """One row per distinct word: ``word, n, n_near, form, form_n, root``."""
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent as its variant")
    counted = words.select(F.col(f"`{word}`").alias("word"), F.coalesce(F.col(f"`{n}`").cast("long"), F.lit(0)).alias("n")).dropna(subset=["word"])
    counted = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_words(counted)
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    of_other = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = near.join(of_other, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"),
    )
    fits = -F.col("best.minus") >= ratio * F.greatest("n", F.lit(1))
    formed = materialize(
        counted.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"),
        ), "forms",
    )
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1, math.log(max(most, ratio), ratio)) + 1))):  # chains are no longer than the logarithm of the counts
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        steps = materialize(steps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return formed.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def letter_runs(text: Column, least: int) -> Column:
    """The maximal runs of at least ``least`` letters A-Z, a-z, U+00C0 to U+00FF, with A-Z lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}+"), F.lit(0)), ascii_lower)
