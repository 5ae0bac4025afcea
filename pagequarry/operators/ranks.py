"""Rows by their place in an order, without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

__all__ = ["rows_in_order"]


def _ordered(df: DataFrame, key: str) -> Column:
    """A key in a type whose values come back from the driver unchanged (local times can be ambiguous)."""
    return F.unix_micros(key) if isinstance(df.schema[key].dataType, TimestampType) else F.col(key)


def _bound(df: DataFrame, keys: list[str], values) -> Column:
    types = df.select(*[_ordered(df, k).alias(k) for k in keys]).schema
    return F.struct(*[F.lit(v).cast(types[k].dataType).alias(k) for k, v in zip(keys, values)])


def rows_in_order(df: DataFrame, keys: list[str], first: int, size: int, enough: int = 10_000, sample: int = 4_096, parts: int = 64) -> DataFrame:
    """Rows number ``first`` to ``first + size - 1`` (from 0) in ascending order of ``keys``, nulls first.

    A range of keys that holds the rows is narrowed until it has at most ``enough`` rows: ``parts - 1`` quantiles of ``sample``
    random keys cut it into parts, one aggregate counts them, and the parts that hold the rows become the next range.  Only the
    last range is sorted; a round reads the key columns, and its shuffle is one row per task and part.  The driver sees
    ``sample`` keys and ``parts`` counts a round.  Results do not depend on the sample.

    Rows that are equal in all keys cannot be told apart: they stay in one range however many they are, and which of them are
    returned is open.  Keys that make rows distinct avoid both.  Rows past the end are none.  The input is read several
    times and must read the same each time.
    """
    if first < 0 or size < 0:
        raise ValueError("first and size must not be negative")
    key = F.struct(*[_ordered(df, k).alias(k) for k in keys])
    inside, before, rows = df, 0, df.count()
    while rows > enough:
        ranked = [_ordered(df, k).alias(k) for k in keys]
        drawn = inside.select(*ranked).orderBy(F.rand(7)).limit(sample).orderBy(*keys).collect()
        cuts = list(dict.fromkeys(tuple(drawn[len(drawn) * i // parts]) for i in range(1, parts)))
        bounds = F.array(*[_bound(df, keys, c) for c in cuts])
        part = F.size(F.filter(bounds, lambda b: b < key))
        counted = {r.part: r.n for r in inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        held, at = [], before
        for p in sorted(counted):
            if at < first + size and at + counted[p] > first:
                held.append((p, at))
            at += counted[p]
        if not held:  # past the end, or no rows wanted
            return inside.limit(0)
        low, high = held[0][0], held[-1][0]
        kept = sum(n for p, n in counted.items() if low <= p <= high)
        if kept == rows:  # one key, or a page as long as the range
            break
        if low > 0:
            inside = inside.where(_bound(df, keys, cuts[low - 1]) < key)
            # the first key alone reaches the scan
            if cuts[low - 1][0] is not None:
                inside = inside.where(_ordered(df, keys[0]) >= F.lit(cuts[low - 1][0]))
        if high < len(cuts):
            inside = inside.where(key <= _bound(df, keys, cuts[high]))
        before, rows = held[0][1], kept
    return inside.orderBy(*keys).offset(max(0, first - before)).limit(size)
