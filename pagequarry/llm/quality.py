"""Quality classifier: zstandard dictionaries of good and bad labelled text.

Two dictionaries are trained on blocks of good and of bad texts.  Every block of a text is compressed with each of them;
the difference of the summed sizes over the text's size says which kind it resembles, and a logistic curve fitted on other
labelled rows turns differences into probabilities.  Texts are compressed whole, in blocks, because a dictionary helps
most at the start of a frame.

Edge cases: null and empty texts have no difference and score the curve at zero; with only one label in the training rows
every score is that label's share; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    block: int
    level: int


def blocks_of(text: bytes, block: int) -> list[bytes]:
    return [text[i:i + block] for i in range(0, len(text), block)]


class _Sizes:
    """Compressed sizes under each dictionary and under none."""

    def __init__(self, good: bytes, bad: bytes, block: int, level: int):
        def make(d):
            return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False)

        self.block, self.kinds = block, [make(good), make(bad), make(b"")]

    def features(self, text: bytes | None) -> tuple[float, float, float]:
        """The normalised size difference (positive: nearer to good), the plain compressed share, and 1."""
        if not text:
            return 0.0, 0.0, 1.0
        parts = blocks_of(text, self.block)
        good, bad, plain = (sum(len(c.compress(p)) for p in parts) for c in self.kinds)
        return (bad - good) / len(text), plain / (len(text) + 64), 1.0


def _dictionary(texts: list[bytes], block: int, size: int, seed: int) -> bytes:
    parts = [p for t in texts for p in blocks_of(t, block)]
    order = np.random.default_rng(seed).permutation(len(parts))
    # about a hundred times the dictionary's size is what the trainer can use
    kept, total = [], 0
    for i in order:
        if total > 100 * size:
            break
        kept.append(parts[i])
        total += len(parts[i])
    try:
        return zstandard.train_dictionary(size, kept).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself is the dictionary
        return b"".join(kept)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[bytes, int]], prior: float, block: int = 2048, size: int = 65_536, level: int = 3) -> CompressionModel:
    """Half of the rows give the dictionaries, the others the calibration; ``prior`` is the share of label 1 in all labels."""
    halves = rows[::2], rows[1::2]
    good, bad = ([t for t, y in halves[0] if y == label and t] for label in (1, 0))
    labels = np.array([y for _, y in halves[1]], float)
    if not good or not bad or labels.min(initial=1) == labels.max(initial=0):
        share = float(np.clip(np.mean([y for _, y in rows]) if rows else 0.5, 1e-3, 1 - 1e-3))
        return CompressionModel(b"", b"", np.array([0.0, 0.0, np.log(share / (1 - share))]), block, level)
    dictionaries = _dictionary(good, block, size, 1), _dictionary(bad, block, size, 2)
    sizes = _Sizes(*dictionaries, block, level)
    weights = _logistic(np.array([sizes.features(t) for t, _ in halves[1]]), labels)
    # the sample is stratified: move the curve from the sample's share to the labels' share
    share = labels.mean()
    weights[2] += np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0
    return CompressionModel(*dictionaries, weights, block, level)


def score_texts(df: DataFrame, model: CompressionModel, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with ``output double``: the probability of label 1 for the whole text (an input column of that name is replaced)."""
    kept = [c for c in df.columns if c != output]
    fed = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = T.StructType([*(f for f in fed.schema if f.name != "__text"), T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(model.good, model.bad, model.block, model.level)
        for rows in batches:
            x = np.array([sizes.features(t) for t in rows.pop("__text")]).reshape(-1, 3) @ model.weights
            yield rows.assign(**{output: 1 / (1 + np.exp(-np.clip(x, -60, 60)))})

    return fed.mapInPandas(run, schema)
