"""Order MinHash fingerprints, in DataFrame functions only.

A text's words give ``k``-word k-mers, each numbered by its occurrence.  The hash of a numbered k-mer chooses one of
``bins`` and its rank there; of every bin the ``tuple_size`` smallest are taken, put back into text order, and hashed
together.  Two texts agree in a bin only if the same k-mers come in the same order there, so the share of equal bins falls
with the edit distance and not only with the set of words.

Everything happens in the row: hashes are packed with positions into longs, so that sorting is on primitive arrays, and no
k-mer leaves its row.  A fingerprint is the list of ``bin, hash`` pairs of its non-empty bins.

Edge cases: null texts count as empty; texts without words have an empty fingerprint, alike 1.0 to each other and 0.0 to
all others; texts of fewer than ``k`` words are one k-mer; equal texts have equal fingerprints; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let

_POSITION_BITS = 24
_POSITION = (1 << _POSITION_BITS) - 1


def _run_starts(sorted_longs: Column, n: Column, shift: int) -> Column:
    """Indices at which the part above ``shift`` bits changes."""
    return F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.shiftright(F.get(sorted_longs, i), shift) != F.shiftright(F.get(sorted_longs, i - 1), shift)),
    )


def order_minhash(text: Column, k: int = 3, bins: int = 64, tuple_size: int = 2) -> Column:
    """The fingerprint ``array<bigint>`` of a text: ``bin << 32 | hash`` of each non-empty bin, by bin."""

    def ranked(packed: Column, occurrence: Column) -> Column:
        """``bin, rank, position`` of a numbered k-mer in one long."""
        return let(
            F.xxhash64(F.shiftright(packed, _POSITION_BITS), occurrence),
            lambda h: F.shiftleft(F.pmod(h, F.lit(bins)), 56)
            .bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 32), _POSITION_BITS))
            .bitwiseOR(packed.bitwiseAND(F.lit(_POSITION))),
        )

    def numbered(kmers: Column, n: Column) -> Column:
        """All k-mers as ``bin, rank, position``; runs of equal k-mers are counted through."""
        return let(
            _run_starts(kmers, n, _POSITION_BITS),
            lambda starts: F.when(F.size(starts) == n, F.transform(kmers, lambda x: ranked(x, F.lit(0)))).otherwise(
                F.flatten(F.transform(starts, lambda s, r: F.transform(
                    F.sequence(s, F.coalesce(F.get(starts, r + 1), n) - 1), lambda i: ranked(F.get(kmers, i), i - s),
                ))),
            ),
        )

    def bin_entry(ranks: Column, start: Column, end: Column) -> Column:
        smallest = F.slice(ranks, start + 1, F.least(F.lit(tuple_size), end - start))
        in_order = F.sort_array(F.transform(
            smallest, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POSITION)), 32).bitwiseOR(F.shiftright(x, _POSITION_BITS).bitwiseAND(F.lit((1 << 32) - 1))),
        ))
        hashed = F.xxhash64(F.transform(in_order, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))))
        return F.shiftleft(F.shiftright(F.get(ranks, start), 56), 32).bitwiseOR(F.shiftrightunsigned(hashed, 32))

    def of_words(words: Column) -> Column:
        n = F.greatest(F.size(words) - (k - 1), F.lit(1))
        kmers = F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + j) for j in range(k))), 25), _POSITION_BITS)
            .bitwiseOR(i.cast("long").bitwiseAND(F.lit(_POSITION))),
        ))
        binned = let(kmers, lambda sorted_kmers: F.sort_array(numbered(sorted_kmers, F.size(sorted_kmers))))
        return let(binned, lambda ranks: let(
            _run_starts(ranks, F.size(ranks), 56),
            lambda starts: F.transform(starts, lambda s, r: bin_entry(ranks, s, F.coalesce(F.get(starts, r + 1), F.size(ranks)))),
        ))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(of_words(w)))


def fingerprint_text(signature: Column) -> Column:
    """A fingerprint in hex, ten digits a bin."""
    return F.array_join(F.transform(signature, lambda e: F.lpad(F.lower(F.hex(e)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal bins over bins that either fingerprint fills."""
    equal = F.size(F.array_intersect(a, b))
    filled = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda e: F.shiftright(e, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / filled)


def order_buckets(df: DataFrame, order: str, rows: int, most: int = 16_384) -> tuple[DataFrame, int]:
    """``df`` with ``__bucket int``, non-decreasing in the integer column ``order`` (nulls: -1), of about ``rows`` rows each.

    Sixty-four quantiles are cut evenly; there are at most ``most`` buckets, so lists of buckets have a fixed bound.
    """
    total = df.count()
    edges = sorted(set(df.where(F.col(order).isNotNull()).select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / 64 for i in range(65)], 0.002))) if total else []
    cuts = max(1, min(most // 64, -(-total // (64 * rows))))
    if not edges:
        return df.withColumn("__bucket", F.lit(-1)), cuts
    bounds = F.array(*map(F.lit, edges))
    value = F.col(order).cast("double")
    at = F.size(F.filter(bounds, lambda e: e <= value))
    low, high = F.get(bounds, at - 1), F.get(bounds, at)
    within = F.when((at == 0) | high.isNull(), F.lit(0)).otherwise(F.least(F.floor((value - low) / (high - low) * cuts), F.lit(cuts - 1)))
    return df.withColumn("__bucket", F.coalesce((at * cuts + within).cast("int"), F.lit(-1))), cuts


def with_next(df: DataFrame, order: str, tie: str, columns: list[str], rows: int = 500) -> DataFrame:
    """Add ``next_<column>`` of the next row by descending ``order`` (ties by ``tie``, nulls last; after the last the first).

    Rows are dealt by ranges of ``order``; the first row of every range is copied to the end of the range before it, so the
    rows move once and no task sees more than its range.
    """
    dealt, _ = order_buckets(df, order, rows)
    first_of = dealt.groupBy("__bucket").agg(F.max(F.struct(order, F.negative(tie).alias("t"))).alias("m")).collect()  # bounded by the buckets
    buckets = sorted((r["__bucket"], r["m"][order], None if r["m"]["t"] is None else -r["m"]["t"]) for r in first_of) if first_of else []
    before = [(value, t, buckets[(i + 1) % len(buckets)][0]) for i, (_, value, t) in enumerate(buckets)]
    kind = df.schema[order].dataType.simpleString()
    copies = dealt.join(
        F.broadcast(df.sparkSession.createDataFrame(before, f"__order {kind}, __tie long, __to int")),
        F.col(order).eqNullSafe(F.col("__order")) & F.col(tie).eqNullSafe(F.col("__tie")),
    )
    both = dealt.withColumn("__copy", F.lit(False)).unionByName(
        copies.select(*df.columns, F.col("__to").alias("__bucket"), F.lit(True).alias("__copy")),
    )
    w = Window.partitionBy("__bucket").orderBy("__copy", F.col(order).desc_nulls_last(), tie)
    led = both.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return led.where(~F.col("__copy")).drop("__bucket", "__copy")
