"""Bounded, stratified samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], id_col: str = "doc_id", text: str = "text") -> list[tuple[bytes, int]]:
    """``(text, label)`` of at most ``per_class`` labelled documents of label 0 and of label 1.

    The documents are those with the smallest id hashes: the choice is even over the table and the same on every run.
    The bound holds before texts are read: only so many ids are joined with the documents.
    """
    chosen = None
    for value in (0, 1):
        part = (
            labels.where(F.col(label) == value).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
            .dropna().distinct().orderBy(F.xxhash64("__id"), "__id").limit(per_class[value])
        )
        chosen = part if chosen is None else chosen.union(part)
    rows = (
        docs.join(F.broadcast(chosen), F.col(f"`{id_col}`") == F.col("__id"))
        .groupBy("__id", "__label").agg(F.first(F.col(f"`{text}`").cast("binary"), ignorenulls=True).alias("t")).collect()
    )
    return [(bytes(r["t"] or b""), r["__label"]) for r in sorted(rows, key=lambda r: (r["__id"], r["__label"]))]
