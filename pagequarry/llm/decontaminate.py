"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (a shorter item is one window).  For each
pattern length there is one table: the last two words at a text position are looked up in the *shift table*, which says
how far the search may jump without missing an occurrence; where the jump is zero, the block's bucket gives the windows
that end in it, and a direct comparison of all their words confirms an occurrence.

Windows come in blocks of at most ``block_windows`` distinct windows, so what a task holds has a fixed bound whatever the
size of the benchmark; each block is one pass over the documents, and the passes are merged per document.

Edge cases: null texts and texts without words have no hits; items without words have no window; a null item id is written
as the empty string; equal windows of several items count for each of them; repeated item rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: ASCII letters (lower-cased) and digits stay, other ASCII is a separator, bytes of non-ASCII characters stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split() if text else []


class PatternTable:
    """Shift table and buckets for windows of one length (in words)."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key, left = words[end - self.block:end], self.length - end
                if left < self.shift.get(key, self.jump):
                    self.shift[key] = left
            self.buckets.setdefault(words[-self.block:], {})[words] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """``(start, items)`` of every occurrence."""
        length, block, jump, shift, n = self.length, self.block, self.jump, self.shift.get, len(words)
        end = length
        while end <= n:
            key = tuple(words[end - block:end])
            skip = shift(key, jump)
            if skip:
                end += skip
                continue
            items = self.buckets[key].get(tuple(words[end - length:end]))
            if items is not None:
                yield end - length, items
            end += 1


def item_windows(items: Iterator[tuple[str | None, bytes | None]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    """Distinct windows with the items that have them."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i:i + window]), set()).add("" if item is None else item)
    return {k: sorted(v) for k, v in found.items()}


def tables_of(patterns: dict[tuple[bytes, ...], list[str]]) -> list[PatternTable]:
    by_length: dict[int, dict] = {}
    for words, items in patterns.items():
        by_length.setdefault(len(words), {})[words] = items
    return [PatternTable(by_length[n]) for n in sorted(by_length)]


def _matcher(tables: list[PatternTable], last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, hit, items = [], [], []
            for text, hit_before, items_before in zip(batch["__text"], batch["hit_words"], batch["item_ids"]):
                words = words_of(text)
                covered, matched = set(hit_before), set(items_before)
                for table in tables:
                    for start, ids in table.search(words):
                        covered.update(range(start, start + table.length))
                        matched.update(ids)
                n_words.append(len(words))
                hit.append(sorted(covered))
                items.append(sorted(matched))
            out = batch.assign(n_words=n_words, hit_words=hit, item_ids=items)
            yield out.drop(columns="__text") if last else out

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10,
    block_windows: int = 200_000, carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, ``n_words long``, ``hit_words array<int>`` (word positions inside
    any occurrence) and ``item_ids array<string>`` (items with an occurring window, sorted).

    ``carry`` may name any columns but ``n_words``, ``hit_words`` and ``item_ids``.
    """
    state = docs.select(
        *(F.col(f"`{c}`") for c in carry),
        F.col(f"`{text}`").cast("binary").alias("__text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("item_ids"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    # the benchmark streams through the driver, one bounded block of windows after another
    block: dict[tuple[bytes, ...], list[str]] = {}
    for row in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{item_text}`").cast("binary")).toLocalIterator():
        for words, ids in item_windows(iter([(row[0], row[1])]), window).items():
            block[words] = sorted({*block.get(words, ()), *ids})
        if len(block) >= block_windows:
            state = materialize(state.mapInPandas(_matcher(tables_of(block), False), schema), "decontaminate")
            block = {}
    last = T.StructType([f for f in schema if f.name != "__text"])
    return state.mapInPandas(_matcher(tables_of(block), True), last)


def digest(found: DataFrame) -> DataFrame:
    """``n_words, n_hit, n_items, items_sha256, contaminated`` of found contamination."""
    return found.select(
        *(c for c in found.columns if c not in ("n_words", "hit_words", "item_ids")),
        F.col("n_words").cast("long"),
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
