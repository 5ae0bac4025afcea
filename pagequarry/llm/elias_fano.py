"""Elias-Fano coding of monotone sequences and a two-level n-gram trie on memory-mapped files.

The trie of a shard has a level of contexts and a level of successors.  Pointers from the first to the second are a
monotone sequence; successor ids are made monotone by adding the sum of the ids before their context, so that both are
Elias-Fano coded.  A successor is looked up relative to its context: in the context's range, over ids that count from the
context's start.  Many n-grams are looked up together, over blocks of contexts that are decoded one after another.  Probabilities are quantised to 16 bits.
"""

from __future__ import annotations

import os

import numpy as np

#: Quantised log10 values: 1 to 65,535 stand for ``-LOWEST`` to 0; code 0 means none.
LOWEST = 16.0
#: Contexts whose part of the trie is decoded at once.
CONTEXT_BLOCK = 1 << 16


def quantise(log10: np.ndarray) -> np.ndarray:
    return (np.clip(1 + np.rint((log10 + LOWEST) * 65_534 / LOWEST), 1, 65_535)).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, -np.inf, (codes.astype(np.float64) - 1) * LOWEST / 65_534 - LOWEST)


class EliasFano:
    """A monotone sequence of unsigned integers: low bits in an array, high bits as a unary bit vector."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, size: int):
        self.low_bits, self.low, self.high, self.ranks, self.size = low_bits, low, high, ranks, size

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, int(np.log2(max(1, top) / n))) if n else 0
        width = np.uint8 if low_bits <= 8 else np.uint16 if low_bits <= 16 else np.uint32 if low_bits <= 32 else np.uint64
        low = (values & ((1 << low_bits) - 1)).astype(width) if low_bits else np.zeros(0, np.uint8)
        bits = np.zeros((((top >> low_bits) + n + 8) // 8 + 8) // 8 * 64, np.uint8)
        bits[(values >> low_bits) + np.arange(n)] = 1
        high = np.packbits(bits)
        # set bits before every 512-bit block, for select
        counts = np.bitwise_count(np.pad(high, (0, -len(high) % 64))).reshape(-1, 64).sum(axis=1, dtype=np.int64)
        return cls(low_bits, low, high, np.concatenate([[0], np.cumsum(counts)]), n)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``: select on the high bits, one 512-bit block each."""
        index = np.asarray(index, np.int64)
        out = np.empty(len(index), np.int64)
        for at in range(0, len(index), 1 << 14):
            i = index[at:at + (1 << 14)]
            block = np.searchsorted(self.ranks, i, "right") - 1
            place = np.minimum(block[:, None] * 64 + np.arange(64), len(self.high) - 1)
            ones = np.cumsum(np.bitwise_count(self.high[place]), axis=1, dtype=np.int64)
            within = i - self.ranks[block]
            byte = (ones <= within[:, None]).sum(axis=1)
            left = within - np.where(byte > 0, ones[np.arange(len(i)), np.maximum(byte - 1, 0)], 0)
            bits = np.unpackbits(self.high[np.minimum(block * 64 + byte, len(self.high) - 1)][:, None], axis=1)
            bit = ((np.cumsum(bits, axis=1) == (left + 1)[:, None]) & (bits == 1)).argmax(axis=1)
            high = (block * 64 + byte) * 8 + bit - i
            out[at:at + (1 << 14)] = (high << self.low_bits) | (self.low[i].astype(np.int64) if self.low_bits else 0)
        return out

    def slice(self, low: int, high: int) -> np.ndarray:
        """The values from ``low`` up to ``high``, decoded from their part of the files."""
        if low >= high:
            return np.zeros(0, np.int64)
        first, last = np.searchsorted(self.ranks, [low, high - 1], "right") - 1
        ones = np.flatnonzero(np.unpackbits(self.high[first * 64:(last + 1) * 64]))
        ones = ones[low - self.ranks[first]:high - self.ranks[first]]
        values = (first * 512 + ones - np.arange(low, high)) << self.low_bits
        return values | self.low[low:high].astype(np.int64) if self.low_bits else values

    def save(self, folder: str, name: str) -> None:
        for part in ("low", "high", "ranks"):
            np.save(os.path.join(folder, f"{name}.{part}.npy"), getattr(self, part))
        np.save(os.path.join(folder, f"{name}.head.npy"), np.array([self.low_bits, self.size]))

    @classmethod
    def load(cls, folder: str, name: str) -> EliasFano:
        """The sequence on memory-mapped files."""
        low_bits, size = np.load(os.path.join(folder, f"{name}.head.npy"))
        parts = [np.load(os.path.join(folder, f"{name}.{part}.npy"), mmap_mode="r") for part in ("low", "high", "ranks")]
        return cls(int(low_bits), *parts, int(size))


class Trie:
    """Contexts and their successors with quantised probabilities and back-off weights."""

    def __init__(self, folder: str):
        self.contexts = EliasFano.load(folder, "contexts")
        self.pointers = EliasFano.load(folder, "pointers")
        self.successors = EliasFano.load(folder, "successors")
        self.probability = np.load(os.path.join(folder, "probability.npy"), mmap_mode="r")
        self.backoff = np.load(os.path.join(folder, "backoff.npy"), mmap_mode="r")

    @staticmethod
    def build(folder: str, context: np.ndarray, successor: np.ndarray, log10: np.ndarray, backoff_context: np.ndarray, backoff_log10: np.ndarray) -> None:
        """Write the levels of n-grams ``(context, successor)`` sorted by both, with their log10 probability; ``backoff``
        has the log10 back-off weight of each distinct context, in order."""
        ids, first = np.unique(context, return_index=True)
        assert np.array_equal(ids, backoff_context)
        ends = np.append(first, len(context))[1:]
        # monotone over contexts: every range starts where the one before has ended
        last = successor[ends - 1] + 1 if len(ids) else np.zeros(0, np.int64)
        base = np.cumsum(last) - last
        EliasFano.encode(ids).save(folder, "contexts")
        EliasFano.encode(np.append(first, len(context))).save(folder, "pointers")
        EliasFano.encode(successor + np.repeat(base, ends - first)).save(folder, "successors")
        np.save(os.path.join(folder, "probability.npy"), quantise(log10))
        np.save(os.path.join(folder, "backoff.npy"), quantise(backoff_log10))

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams' probability and of their contexts' back-off weight (0: not in the trie)."""
        n, found = self.contexts.size, np.zeros(len(context), np.uint16)
        back = np.zeros(len(context), np.uint16)
        order = np.argsort(context, kind="stable")
        ordered = context[order]
        for at in range(0, n, CONTEXT_BLOCK):
            ids = self.contexts.slice(at, min(n, at + CONTEXT_BLOCK))
            mine = order[np.searchsorted(ordered, ids[0]):np.searchsorted(ordered, ids[-1], "right")]
            if not len(mine):
                continue
            place = np.searchsorted(ids, context[mine])
            known = ids[place] == context[mine]
            mine, place = mine[known], place[known]
            back[mine] = self.backoff[at + place]
            pointers = self.pointers.slice(at, at + len(ids) + 1)
            successors = self.successors.slice(int(pointers[0]), int(pointers[-1]))
            before = int(self.successors.get(pointers[:1] - 1)[0]) + 1 if pointers[0] else 0
            ranges = pointers - pointers[0]
            # successor ids count on from where the context before has ended
            start = np.where(ranges[:-1] > 0, successors[np.maximum(ranges[:-1] - 1, 0)] + 1, before)
            wanted = successor[mine] + start[place]
            at_successor = np.searchsorted(successors, wanted)
            hit = (at_successor < ranges[place + 1]) & (successors[np.minimum(at_successor, len(successors) - 1)] == wanted)
            found[mine[hit]] = self.probability[pointers[0] + at_successor[hit]]
        return found, back
