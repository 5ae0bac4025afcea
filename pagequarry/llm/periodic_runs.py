"""Runs of repeating words, found by seeds and extension along diagonals.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal), at least ``least`` words
and ``powers`` periods long, which no neighbouring word extends.  Shifted by ``q``, a run overlaps itself in at least
``max(least - q, (powers - 1) * q)`` words.  Lags are taken in classes ``[low, high]``; the k-grams that are indexed for a
class have the least overlap that any of its lags guarantees, and ``high`` is chosen not to exceed ``k``.

Seeds are pairs of occurrences of one k-gram in one document.  Since ``k >= q`` and the shortest period of a run is
primitive, a k-gram inside a run occurs next exactly ``q`` words on: only neighbouring occurrences need to be paired, so
seeds grow with the text and not with the square of a repeat.  A seed is extended along its diagonal by direct comparison;
a table holds how far each lag is covered, and seeds inside what is covered are passed over.  K-grams are numbered exactly
by doubling (ranks of pairs of ranks).  A hash of the shortest k-grams first drops documents in which none recurs; equal
k-grams have equal hashes, so none with a run goes.

Edge cases: a null or empty text has no words, no runs and an empty collapsed text; white space is U+0009 to U+000D and
U+0020 only; words are told apart by their bytes; a very long text is one part of its own, with memory in proportion to its
words; repeated rows give repeated results; an empty table gives an empty result; input columns called like an output are
replaced, all others are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are worked on in parts of about so many bytes.
PART_BYTES = 4 << 20

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def lag_classes(least: int, powers: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """``(low, high, k)`` of the lags that a run in ``longest`` words can have."""
    if powers < 3 or least < 1:
        raise ValueError("runs need three periods and one word at least")
    low = 1
    while low * powers <= longest:
        k = min(max(least - q, (powers - 1) * q) for q in range(low, max(low, least) + 1))
        yield low, k, k
        low = k + 1


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Equal for equal k-grams; position ``i`` is that of the k-gram's first word."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out, filled, base = None, 0, np.uint64(0xBF58476D1CE4E5B9)
        size, power = 1, base
        while size <= k:  # the binary digits of k, each a block of words
            if k & size:
                block = h[filled:]
                out = block.copy() if out is None else out[:len(block)] * power + block
                filled += size
            h = h[:-size] * power + h[size:] if len(h) > size else h[:0]
            size, power = size * 2, power * power
    return out[:max(0, len(codes) - k + 1)]


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


class GramIndex:
    """Exact numbers of the k-grams of several texts, whose words lie one text after another."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes, self.length = words, sizes, 1
        self.ranks = _numbered(words)

    @property
    def left(self) -> np.ndarray:
        """Words from each position to the end of its text."""
        return np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.words))

    def _pairs(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.left >= self.length + shift)
        return at, _numbered(self.ranks[at] * (len(self.words) + 1) + self.ranks[at + shift])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that have a k-gram, and its number; ``k`` may only grow."""
        while self.length * 2 <= k:
            at, rank = self._pairs(self.length)
            self.ranks = np.full(len(self.words), -1, np.int64)
            self.ranks[at] = rank
            self.length *= 2
        return self._pairs(k - self.length)

    def keep(self, texts: np.ndarray) -> None:
        """Go on with the marked texts only."""
        rows = np.repeat(texts, self.sizes)
        self.words, self.ranks, self.sizes = self.words[rows], self.ranks[rows], self.sizes[texts]


def _matching(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """The first position from ``at`` on whose word differs from the word ``lag`` on (words end at ``end``)."""
    step, last = 32, end - lag
    while at < last:
        stop = min(at + step, last)
        differs = np.flatnonzero(words[at:stop] != words[at + lag:stop + lag])
        if len(differs):
            return at + int(differs[0])
        at, step = stop, step * 4
    return last


def runs_of_texts(words: np.ndarray, sizes: np.ndarray, least: int = 24, powers: int = 3) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text, by start, then period.

    ``words`` are numbers, equal only for equal words of one text; ``sizes`` are the texts' word counts.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    owner, texts, index = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(sizes)), None
    for low, high, k in lag_classes(least, powers, int(sizes.max(initial=0))):
        if index is None:
            hashes = _gram_hashes(words, k)
            ordered = np.sort(hashes)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            marked = np.zeros(len(sizes), bool)
            if len(twice):
                near = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
                marked[owner[:len(hashes)][twice[near] == hashes]] = True
            texts, rows = texts[marked], np.repeat(marked, sizes)
            index = GramIndex(words[rows], sizes[marked])
        if not len(texts):
            break
        at, gram = index.grams(k)
        order = np.argsort(gram, kind="stable")
        again = gram[order][1:] == gram[order][:-1]
        first, lag = at[order][:-1][again], (at[order][1:] - at[order][:-1])[again]
        where = np.repeat(np.arange(len(texts)), index.sizes)
        ends = np.cumsum(index.sizes)
        seeds = (lag >= low) & (lag <= high)
        by_place = np.argsort(first[seeds], kind="stable")
        place, step = first[seeds][by_place], lag[seeds][by_place]
        # a seed straight after one of the same lag is covered by that one's extension
        head = np.ones(len(place), bool)
        head[1:] = (place[1:] != place[:-1] + 1) | (step[1:] != step[:-1])
        covered: dict[int, int] = {}
        for i, q in zip(place[head].tolist(), step[head].tolist()):
            if i < covered.get(q, 0):
                continue
            text = int(where[i])
            end = _matching(index.words, i + k, q, int(ends[text]))
            covered[q] = end
            length = end - i + q
            if length >= max(least, powers * q):  # nothing to extend on the left: the k-gram before would be a seed as well
                found[int(texts[text])].append((i - int(ends[text] - index.sizes[text]), length, q))
        alive = np.zeros(len(texts), bool)
        alive[where[first]] = True
        texts = texts[alive]
        index.keep(alive)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks of the words that stay if each run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def collapse_runs(df: DataFrame, text: str = "text", least: int = 24, powers: int = 3, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``df`` with ``runs array<struct<start, length, period>>`` (word numbers from 0; by start, then period) and
    ``collapsed string``, the words outside of repeats joined by one space: of each run its first period stays."""
    next(lag_classes(least, powers, powers))
    kept = [c for c in df.columns if c not in (runs, collapsed)]
    fed = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("binary").alias("__bytes"))
    schema = T.StructType([*fed.schema.fields[:-1], T.StructField(runs, T.ArrayType(RUN, False)), T.StructField(collapsed, T.StringType())])
    run_type = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]))

    def part(texts: list[bytes]) -> tuple[list, list]:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((numbers[w] for words in split for w in words), np.int64, int(sizes.sum()))
        found = runs_of_texts(codes + np.repeat(np.arange(len(split)), sizes) * max(1, len(numbers)), sizes, least, powers)
        joined = [
            b" ".join(w for w, stays in zip(words, kept_words(len(words), r).tolist()) if stays) if r else b" ".join(words)
            for words, r in zip(split, found)
        ]
        return [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], [j.decode() for j in joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(len(kept))
            filled = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
            at = 0
            while at < len(column):
                stop = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + PART_BYTES)))
                found, joined = part([v.as_py() or b"" for v in column[at:stop]])
                yield pa.RecordBatch.from_arrays(
                    [*(c[at:stop] for c in rows.columns[:-1]), pa.array(found, run_type), pa.array(joined, pa.string())], schema.names,
                )
                at = stop

    return fed.mapInArrow(run, schema)
