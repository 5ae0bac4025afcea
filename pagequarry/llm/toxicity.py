"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams (hashed into ``buckets``; word boundaries are
marked), a text's vector is the mean of its word vectors, and a linear layer with softmax gives the probabilities.
Embeddings and layer are trained together on a bounded sample of labelled rows; a misspelt word shares most of its
n-grams with the word it comes from.

Scoring reads whole texts.  Since both means and the layer are linear, a word adds a fixed amount to the logit, which is
computed once per distinct word and kept in a bounded cache.

Edge cases: null and empty texts score the bias alone; texts of any length are scored whole; with no labelled rows every
score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose logit a task remembers.
CACHE_WORDS = 200_000
#: Bytes of text whose words a task holds at once (a longer text is a part of its own).
PART_BYTES = 2_000_000
#: Words whose n-grams are laid out at once.
PART_WORDS = 10_000
#: Punctuation that does not belong to a word.
_EDGE = ".,;:!?\"'()[]{}<>|*$%&#"


def words_of(text: bytes | None) -> list[str]:
    """Lower-cased words without punctuation at the ends."""
    return [w for w in (x.strip(_EDGE) for x in (text or b"").decode("utf-8", "replace").lower().split()) if w]


def subwords(words: list[str], buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams and of the whole words, all with boundary marks, word after word, and the
    number of buckets of each word."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word_of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters up to the word's end
    owners, found = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(chars), np.uint64)
        for n in range(1, longest + 1):
            rolling[: len(chars) - n + 1] = (rolling[: len(chars) - n + 1] + chars[n - 1:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rolling ^= rolling >> np.uint64(29)
            if n >= shortest:
                inside = left >= n
                owners.append(word_of[inside])
                found.append(rolling[inside] % np.uint64(buckets))
    owners.append(np.arange(len(words)))
    found.append(np.array([xxhash.xxh32_intdigest(m.encode("utf-8", "surrogatepass")) % buckets for m in marked], np.uint64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


@dataclass
class SubwordSoftmax:
    """Embeddings ``(buckets, dim)``, layer ``(dim, 2)`` and bias ``(2,)``."""

    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    shortest: int
    longest: int

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the logit of label 1 over label 0, and the bias of that logit."""
        return self.embeddings @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


class _Bags:
    """The training texts as numbers of their words, and each distinct word's buckets once: what a text has of each bucket is
    worked out for a batch at a time."""

    def __init__(self, texts: list[bytes], buckets: int, shortest: int, longest: int):
        numbers: dict[str, int] = {}
        self.buckets, self.total = buckets, np.zeros(len(texts))
        words, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, text in enumerate(texts):
            found = Counter(words_of(text))
            words.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
            counts.append(np.fromiter(found.values(), np.int32, len(found)))
            self.total[i] = max(1, found.total())
        ends = np.cumsum([len(w) for w in words])
        self.begin, self.end = ends[:-1], ends[1:]
        self.words, self.counts = np.concatenate(words), np.concatenate(counts)
        del words, counts
        names, parts = list(numbers), [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        del numbers
        for at in range(0, len(names), PART_WORDS):
            flat, sizes = subwords(names[at:at + PART_WORDS], buckets, shortest, longest)
            parts.append((flat.astype(np.int32), sizes))
        del names
        self.flat, self.sizes = (np.concatenate(x) for x in zip(*parts))
        self.kept, self.first = self.sizes, np.cumsum(self.sizes) - self.sizes

    def keep(self, wanted: np.ndarray) -> None:
        """Leave out the buckets not ``wanted``, once; a word's mean is still over all it had."""
        stays = wanted[self.flat]
        self.kept = np.add.reduceat(stays, self.first, dtype=np.int64)  # every word has a bucket of its own
        self.first = np.cumsum(self.kept) - self.kept
        if not stays.all():
            self.flat = self.flat[stays]

    def _entries(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text, word after word, and what each entry adds to its bucket's weight."""
        words, counts = self.words[self.begin[i]:self.end[i]], self.counts[self.begin[i]:self.end[i]]
        n = self.kept[words]
        ids = self.flat[np.arange(n.sum()) + np.repeat(self.first[words] - (np.cumsum(n) - n), n)]
        return ids, np.repeat(counts.astype(float) / self.sizes[words] / self.total[i], n)

    def bag(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text, ascending, and their weights in its average."""
        ids, weight = self._entries(i)
        filled = np.bincount(ids, weight, minlength=self.buckets)
        own = np.nonzero(filled > 0)[0]
        return own, filled[own].astype(np.float32)

    def batch(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the texts ``index``, ascending, and the matrix of their weights in each text's average."""
        entries = [self._entries(i) for i in index]
        occurs = np.zeros(self.buckets, bool)
        for ids, _ in entries:
            occurs[ids] = True
        used, local = np.nonzero(occurs)[0], np.cumsum(occurs) - 1
        spread = np.empty((len(index), len(used)), np.float32)
        for row, (ids, weight) in zip(spread, entries):
            row[:] = np.bincount(local[ids], weight, minlength=len(used))
        return used, spread


def train(
    rows: list[tuple[bytes, int]], dim: int = 8, buckets: int = 1 << 17, shortest: int = 3, longest: int = 5, epochs: int = 6, rate: float = 0.3,
    least_share: float = 0.03, least_texts: int = 3, batch: int = 64, seed: int = 13,
) -> SubwordSoftmax:
    """Minibatch gradient steps over embeddings and layer together; the classes weigh the same.

    A bucket's step is divided by its mean squared weight, so that frequent and rare n-grams learn equally fast, but by no
    less than that of a bucket in ``least_share`` of the texts: what only a few texts have moves slowly.  Buckets of fewer
    than ``least_texts`` training texts keep a zero vector.
    """
    rng = np.random.default_rng(seed)
    model = SubwordSoftmax(
        rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32), shortest, longest,
    )
    bags = _Bags([t for t, _ in rows], buckets, shortest, longest)
    labels = np.array([y for _, y in rows], np.int64)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    if len(labels) == 0 or (share == 0).any():
        model.layer[:] = 0  # nothing to tell apart
        return model
    texts_with, power, reaches = np.zeros(buckets, np.int64), np.zeros(buckets), np.zeros(len(rows), np.float32)
    for i in range(len(rows)):
        ids, weight = bags.bag(i)
        texts_with[ids] += 1
        power[ids] += weight.astype(float) ** 2 / len(rows)
    rare = texts_with < least_texts
    model.embeddings[rare], power[rare] = 0, 0
    bags.keep(~rare)
    entries = texts_with[texts_with >= least_texts].sum()
    scale = (1 / (power + least_share * power.sum() * len(rows) / max(1, entries))).astype(np.float32)
    for i in range(len(rows)):
        ids, weight = bags.bag(i)
        reaches[i] = (weight ** 2 * scale[ids]).sum()
    reach = np.mean(reaches)  # how far one unit step moves a text's logit
    scale *= 4 / max(reach, 1e-12)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            index = order[at:at + batch]
            used, spread = bags.batch(index)
            texts = spread @ model.embeddings[used]
            logits = texts @ model.layer + model.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(index)), labels[index]] -= 1
            p *= (0.5 / share[labels[index]] / len(index))[:, None].astype(np.float32)
            grad = spread.T @ (p @ model.layer.T)
            model.layer -= 0.02 * (texts.T @ p)
            model.bias -= 0.5 * p.sum(axis=0)
            model.embeddings[used] -= step * len(index) * scale[used, None] * grad
    return model


def word_margins(words: list[str], margin: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[str, float]]:
    """What each word adds to the logit: the mean of its buckets' margins."""
    buckets = len(margin)
    for at in range(0, len(words), PART_WORDS):
        part = words[at:at + PART_WORDS]
        flat, sizes = subwords(part, buckets, shortest, longest)
        yield from zip(part, (np.add.reduceat(margin[flat], np.cumsum(sizes) - sizes) / sizes).tolist())


def score_texts(df: DataFrame, model: SubwordSoftmax, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with ``output double``: the probability of label 1 for the whole text, a string or binary column (an input
    column called like the output is replaced)."""
    margin, bias = model.margins()
    shortest, longest = model.shortest, model.longest
    kept = [c for c in df.columns if c != output]
    fed = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*fed.schema, T.StructField(output, T.DoubleType())])
    number = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for rows in batches:
            column = rows.column(number)
            if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
                column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            filled = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
            scores, at = np.zeros(len(column)), 0
            while at < len(column):  # words of a bounded part of the batch at a time
                stop = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + PART_BYTES)))
                counts = [Counter(words_of(value.as_py())) for value in column[at:stop]]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                if new := sorted({w for c in counts for w in c if w not in cache}):
                    cache.update(word_margins(new, margin, shortest, longest))
                logits = np.array([bias + sum(cache[w] * n for w, n in c.items()) / max(1, c.total()) for c in counts])
                scores[at:stop] = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
                at = stop
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], [*kept, output])

    return fed.mapInArrow(run, schema)
