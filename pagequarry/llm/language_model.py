"""Scoring with a bigram model in Elias-Fano tries.

Training counts cover all training documents.  The model is ``p(w | v) = (c(v w) + mu * p(w)) / (c(v) + mu)`` with the
add-one unigram ``p`` (one more word stands for all unseen ones); every text starts after a start mark and ends with an end
token.  The first term is stored, quantised, in tries; ``mu / (c(v) + mu)`` is the context's back-off weight.

Neither counts nor tries are held whole anywhere.  Documents are read in batches of some megabytes; a batch's distinct
words, and then its distinct word pairs, are dealt over shards by hash.  A shard counts what the training documents of all
batches have, builds the trie of its n-grams on memory-mapped files, looks up every batch's n-grams in it and answers the
batch.  Successors of frequent contexts are spread over shards: there are at most ``1 / hot_share`` contexts with that share
of the tokens, so their counts are a list of fixed bound, known to all shards.  A batch's answers meet its tokens again to
be added up by document.  How many shards there are grows with the input.

Edge cases: null and empty texts have one token, the end; texts of any length are whole; rows with a null id count as the
empty id; repeated rows are documents of their own; without training documents every token is unseen; an empty table gives
an empty result.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import fold_of
from .elias_fano import Trie, dequantise

#: The end token and the start mark: white space is in no word.
END, START = b"\n", b" "
#: Between the contexts and the words of a blob: white space too, and not the end token.
BETWEEN = b"\r"
#: Bytes of text in a batch.
BATCH_BYTES = 4_000_000
_ROWS = "batch binary, shard int, words binary, counts binary"


def _tokens(texts: list[bytes | None]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts, each with the end token, one after another, and how many each text has."""
    # Arrow lowers and splits by ASCII alone, so any bytes will do for a string; the end token is white space, so it is put in after
    raw = pa.array([t or b"" for t in texts], pa.large_binary())
    split = pc.ascii_split_whitespace(pc.ascii_lower(raw.view(pa.large_string())))
    cuts = np.asarray(split.offsets, dtype=np.int64)
    flat = split.flatten().view(pa.large_binary())
    full = np.asarray(pc.binary_length(flat)) > 0  # white space at the ends of a text leaves empty words
    sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[cuts]) + 1
    index = np.full(int(sizes.sum()), len(flat), np.int64)
    last = np.zeros(len(index), bool)
    last[np.cumsum(sizes) - 1] = True
    index[~last] = np.nonzero(full)[0]
    return pa.concat_arrays([flat, pa.array([END], pa.large_binary())]).take(pa.array(index)), sizes


class _Batch:
    """The tokens of some documents by local word number (words in byte order)."""

    def __init__(self, ids: list, train: list[bool], texts: list[bytes | None]):
        words, self.sizes = _tokens(texts)
        coded = words.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        self.words = coded.dictionary.take(order).to_pylist()
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        self.tokens = place[np.asarray(coded.indices)]
        self.ids, self.train = ids, np.array(train, bool)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        self.key = xxhash.xxh128_digest(repr((ids, [len(t or b"") for t in texts], xxhash.xxh64_intdigest(b"\0".join(t or b"" for t in texts)))))

    @property
    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[_Batch]:
    """Batches of whole documents; which rows share one depends on their order in the partition alone."""
    ids, train, texts, size = [], [], [], 0
    for part in rows:
        for i, fold, text in zip(part["__id"], part["__train"], part["__text"]):
            ids.append(i)
            train.append(bool(fold))
            texts.append(text)
            size += len(text or b"") + 16
            if size >= BATCH_BYTES:
                yield _Batch(ids, train, texts)
                ids, train, texts, size = [], [], [], 0
    if ids:
        yield _Batch(ids, train, texts)


def _cuts(shard_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices by shard, each in ascending order."""
    order = np.argsort(shard_of, kind="stable")
    shards, first = np.unique(shard_of[order], return_index=True)
    for shard, index in zip(shards, np.split(order, first[1:])):
        yield int(shard), index


def _ask_words(shards: int):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _batches(rows):
            counts = np.bincount(b.tokens[b.trained], minlength=len(b.words))
            yield pd.DataFrame([
                (b.key, shard, _packed(b" ".join(b.words[i] for i in index)), counts[index].astype(np.int32).tobytes())
                for shard, index in _cuts((b.hashes % np.uint64(shards)).astype(np.int64))
            ], columns=["batch", "shard", "words", "counts"])

    return run


def _packed(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def _split(words: bytes) -> list[bytes]:
    return words.split(b" ")


def _count_words(group: pd.DataFrame, listed: int) -> pd.DataFrame:
    """The corpus counts of each batch's words; one more row (no batch) has the shard's totals and its most frequent words."""
    numbers: dict[bytes, int] = {}
    index = [np.array([numbers.setdefault(w, len(numbers)) for w in _split(zstandard.decompress(x))], np.int64) for x in group["words"]]
    totals = np.zeros(len(numbers), np.int64)
    for i, c in zip(index, group["counts"]):
        totals[i] += np.frombuffer(c, np.int32)
    most = np.argsort(-totals, kind="stable")[:listed]
    names = list(numbers)
    own = (b"", group["shard"].iloc[0], b" ".join(names[i] for i in most), np.concatenate([[totals.sum(), (totals > 0).sum()], totals[most]]).astype(np.int64).tobytes())
    return pd.DataFrame([own, *((b, s, b"", totals[i].tobytes()) for b, s, i in zip(group["batch"], group["shard"], index))], columns=["batch", "shard", "words", "counts"])


def _totals(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in rows:
        yield pd.DataFrame([np.frombuffer(c, np.int64)[:2] for c in part["counts"]], columns=["tokens", "known"])


def _frequent(least: float):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            for words, counts in zip(part["words"], part["counts"]):
                found = [(w, n) for w, n in zip(_split(words), np.frombuffer(counts, np.int64)[2:].tolist()) if n >= least]
                yield pd.DataFrame(found, columns=["word", "n"])

    return run


def _pairs(tokens: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(context, word)`` of a batch in order (context number ``words``: the start), and the pair of each token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = words
    pair, of_token = np.unique(before * (words + 1) + tokens, return_inverse=True)
    return pair // (words + 1), pair % (words + 1), of_token


def _pair_shards(word_hashes: np.ndarray, frequent: np.ndarray, context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """A frequent context's pairs go by both words, all others by the context."""
    hashes, spread = np.append(word_hashes, np.uint64(xxhash.xxh64_intdigest(START))), np.append(frequent, True)
    with np.errstate(over="ignore"):
        mixed = hashes[context] + np.where(spread[context], hashes[word] * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(shards)).astype(np.int64)


def _ask_pairs(shards: int, hot: dict[bytes, int]):
    """A pair blob has the contexts, their numbers of pairs, and the words, in the batch's order."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _batches(rows):
            context, word, of_token = _pairs(b.tokens, b.sizes, len(b.words))
            counts = np.bincount(of_token[b.trained], minlength=len(context))
            names = [*b.words, START]
            out = []
            for shard, index in _cuts(_pair_shards(b.hashes, np.array([w in hot for w in b.words], bool), context, word, shards)):
                c, first = np.unique(context[index], return_index=True)
                sizes = np.diff(np.append(first, len(index)))
                # the start mark cannot be joined by spaces: it is an empty name
                heads = b" ".join(b"" if i == len(b.words) else names[i] for i in c)
                tails = b" ".join(names[i] for i in word[index])
                out.append((b.key, shard, _packed(heads + BETWEEN + tails), _packed(np.concatenate([[len(c)], sizes, counts[index]]).astype(np.int32).tobytes())))
            yield pd.DataFrame(out, columns=["batch", "shard", "words", "counts"])

    return run


def _answer_pairs(mu: float, hot: dict[bytes, int], start_count: int):
    """Build the shard's trie and look up each batch's pairs: codes of probability and back-off, in the batch's order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        asked, pieces = [], []
        for words, counts in zip(group["words"], group["counts"]):
            counts = np.frombuffer(zstandard.decompress(counts), np.int32).astype(np.int64)
            heads, _, tails = zstandard.decompress(words).partition(BETWEEN)
            sizes, counts = counts[1:1 + counts[0]], counts[1 + counts[0]:]
            head = np.array([numbers.setdefault(w or START, len(numbers)) for w in _split(heads)], np.int64)
            tail = np.array([numbers.setdefault(w, len(numbers)) for w in _split(tails)], np.int64)
            asked.append((np.repeat(head, sizes), tail))
            seen = counts > 0
            pieces.append((asked[-1][0][seen] << 32 | tail[seen], counts[seen]))
        pair, inverse = np.unique(np.concatenate([p for p, _ in pieces]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([c for _, c in pieces]), minlength=len(pair))
        context, word = pair >> 32, pair & 0xFFFFFFFF
        ids, of_pair = np.unique(context, return_inverse=True)
        names = list(numbers)
        # a light context has all its pairs here; a frequent one's count comes with the list
        totals = np.bincount(of_pair, count, minlength=len(ids))
        totals = np.array([start_count if names[i] == START else hot.get(names[i], t) for i, t in zip(ids, totals)], float)
        folder = tempfile.mkdtemp(prefix="trie-")  # one task's scratch: built, mapped, read and removed here
        try:
            Trie.build(folder, context, word, np.log10(count / (totals[of_pair] + mu)), ids, np.log10(mu / (totals + mu)))
            trie = Trie(folder)
            probability, backoff = trie.lookup(*(np.concatenate(x) for x in zip(*asked)))
            ends = np.cumsum([len(c) for c, _ in asked])
            out = [
                (batch, shard, probability[e - len(c):e].tobytes(), backoff[e - len(c):e].tobytes())
                for batch, shard, (c, _), e in zip(group["batch"], group["shard"], asked, ends)
            ]
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        return pd.DataFrame(out, columns=["batch", "shard", "words", "counts"])

    return run


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", train: str | None = None, mu: float = 2000.0, hot_share: float = 1 / 2000, rows_per_shard: int = 2_500,
) -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` of every row; ``train`` names a boolean column of ``df``
    (default: id CRC-32 modulo 7 is not 2).

    ``df`` is read several times and must give the same rows in the same order, as stored files do.
    """
    flag = F.coalesce(F.col(f"`{train}`"), F.lit(False)) if train else fold_of(F.col(f"`{id_col}`"), 7) != 2
    fed = df.select(F.col(f"`{id_col}`").alias("__id"), flag.alias("__train"), F.col(f"`{text}`").cast("binary").alias("__text"))
    shards = max(8, -(-fed.select("__train").count() // rows_per_shard))

    listed = int(1 / hot_share)  # no more words can have that share of all tokens
    words = materialize(fed.mapInPandas(_ask_words(shards), _ROWS).groupBy("shard").applyInPandas(lambda g: _count_words(g, listed), _ROWS), "word-counts")
    own = words.where(F.length("batch") == 0)
    sums = own.mapInPandas(_totals, "tokens long, known long").agg(F.sum("tokens"), F.sum("known")).first()
    tokens, known = sums[0] or 0, sums[1] or 0
    frequent = own.mapInPandas(_frequent(max(1, hot_share * tokens)), "word binary, n long").collect()
    hot = {bytes(r["word"]): r["n"] for r in frequent}
    ends = hot[END] if END in hot else fed.where("__train").count()

    answers = fed.mapInPandas(_ask_pairs(shards, hot), _ROWS).groupBy("shard").applyInPandas(_answer_pairs(mu, hot, ends), _ROWS)
    kind = fed.schema["__id"].dataType.simpleString()

    # a batch's tokens (kind 0) meet the counts of its words (1) and the codes of its pairs (2)
    def skeletons(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _batches(rows):
            yield pd.DataFrame([{
                "batch": b.key, "kind": 0, "shard": 0, "a": _packed(b.tokens.astype(np.int32).tobytes()), "b": b.hashes.tobytes(), "c": b.sizes.astype(np.int32).tobytes(),
                "ids": list(b.ids), "hot": np.array([w in hot for w in b.words], bool).tobytes(),
            }])

    schema = f"batch binary, kind int, shard int, a binary, b binary, c binary, ids array<{kind}>, hot binary"
    nothing = [F.lit(None).cast("binary").alias("c"), F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("binary").alias("hot")]
    parts = (
        fed.mapInPandas(skeletons, schema)
        .unionByName(words.where(F.length("batch") > 0).select("batch", F.lit(1).alias("kind"), "shard", F.col("counts").alias("a"), F.lit(None).cast("binary").alias("b"), *nothing))
        .unionByName(answers.select("batch", F.lit(2).alias("kind"), "shard", F.col("words").alias("a"), F.col("counts").alias("b"), *nothing))
    )

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        heads = group[group["kind"] == 0]
        if not len(heads):
            raise ValueError("the documents changed between two reads")
        head = heads.iloc[0]
        tokens_here, hashes = np.frombuffer(zstandard.decompress(head["a"]), np.int32).astype(np.int64), np.frombuffer(head["b"], np.uint64)
        sizes = np.frombuffer(head["c"], np.int32).astype(np.int64)
        counts = np.zeros(len(hashes), np.int64)
        by_shard = {s: x for s, x in zip(*(group.loc[group["kind"] == 1, c] for c in ("shard", "a")))}
        for shard, index in _cuts((hashes % np.uint64(shards)).astype(np.int64)):
            counts[index] = np.frombuffer(by_shard[shard], np.int64)
        uni = np.log10((counts + 1.0) / (tokens + known + 1.0))
        context, word, of_token = _pairs(tokens_here, sizes, len(hashes))
        frequent = np.frombuffer(head["hot"], bool)
        shard_of = _pair_shards(hashes, frequent, context, word, shards)
        probability, backoff = np.zeros(len(context), np.uint16), np.zeros(len(context), np.uint16)
        answered = {s: (p, q) for s, p, q in zip(*(group.loc[group["kind"] == 2, c] for c in ("shard", "a", "b")))}
        for shard, index in _cuts(shard_of):
            probability[index], backoff[index] = (np.frombuffer(x, np.uint16) for x in answered[shard])
        weight = np.where(backoff == 0, _unseen_backoff(context, counts, np.append(frequent, True), ends, mu), 10.0 ** dequantise(backoff))
        logs = np.log10(10.0 ** dequantise(probability) + weight * 10.0 ** uni[word])
        # rows that are equal to a whole batch share its key
        begin = np.cumsum(sizes) - sizes
        one = pd.DataFrame({
            "id": list(head["ids"]), "n_tokens": sizes, "n_known": np.add.reduceat((counts[tokens_here] > 0).astype(np.int64), begin), "train_tokens": tokens,
            "base_score": np.add.reduceat(uni[tokens_here], begin), "score": np.add.reduceat(logs[of_token], begin),
        })
        return pd.concat([one] * len(heads), ignore_index=True)

    out = parts.groupBy("batch").applyInPandas(add_up, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _unseen_backoff(context: np.ndarray, counts: np.ndarray, hot: np.ndarray, ends: int, mu: float) -> np.ndarray:
    """The back-off weight where the shard has no n-gram of the context: 1 for a context without count, else by its count
    (a frequent context need not have successors in every shard)."""
    total = np.append(counts, ends)[context]
    return mu / (np.where(hot[context], total, 0) + mu)
