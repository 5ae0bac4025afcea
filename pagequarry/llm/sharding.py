"""Consistent-hash sharding with bounded loads.

The ring has ``2**ring_bits`` cells; every shard owns ``vnodes`` of them, and a key belongs to the first owned cell
clockwise of its own cell.  A shard takes keys up to its capacity; the keys of a cell that do not fit go on to the next
shards clockwise, so no shard can be over its capacity and only overflow moves.  Within a cell, rows are served by part and
then in hash order, which makes the result independent of partitioning.

The driver sees one number per cell (at most ``2**ring_bits`` rows, whatever the input).  A cell has ``PARTS`` parts by the hash
of key and ``tie_columns``; ranks are taken within a part and added to the rows of the parts before it.  So the rows of one key,
or of no key, are spread over parts as long as they differ in a tie column; rows equal in key and all tie columns share one.

Edge cases: a null key is placed by the hash of the empty string; rows with equal keys share a cell and get different
slots (ties are broken by ``tie_columns``, then arbitrarily between rows that are equal in all of them); an empty table
gives an empty result; very long texts are carried as they are; input columns called ``shard`` or ``slot`` are replaced, all
others are kept whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Parts of a ring cell that are ranked apart.
PARTS = 32


def ring_cell(key: Column, ring_bits: int) -> Column:
    """The ring cell of a key: the leading bits of its MD5."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.shiftright(head, 32 - ring_bits).cast("int")


def ring_owners(shards: int, vnodes: int, ring_bits: int) -> list[int]:
    """The shard that owns each cell of the ring, after walking clockwise to the next virtual node."""
    cells = 1 << ring_bits
    if shards * vnodes > cells // 2:
        raise ValueError("use a larger ring_bits for so many virtual nodes")
    placed: dict[int, int] = {}
    for node in range(vnodes):
        for shard in range(shards):
            cell = int(hashlib.md5(f"node {shard}/{node}".encode()).hexdigest()[:8], 16) >> (32 - ring_bits)
            while cell in placed:  # two virtual nodes never share a cell
                cell = (cell + 1) % cells
            placed[cell] = shard
    owners, shard = [0] * cells, placed[min(placed)]
    for cell in range(cells - 1, -1, -1):
        shard = placed.get(cell, shard)
        owners[cell] = shard
    return owners


def clockwise(owners: list[int]) -> list[list[int]]:
    """For each cell, all shards in the order in which a key of that cell meets them."""
    order: list[int] = []
    seen_from = [order] * len(owners)
    for cell in [*range(len(owners) - 1, -1, -1)] * 2:
        if not order or order[0] != owners[cell]:
            order = [owners[cell], *(s for s in order if s != owners[cell])]
        seen_from[cell] = order
    return seen_from


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold.  Without slack the capacities add up to the rows, so counts differ by one at most."""
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def place(counts: dict[int, int], shards: int, vnodes: int, ring_bits: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(cell, from rank, to rank, shard, first slot)``; ranks of a cell count from 0."""
    routes = clockwise(ring_owners(shards, vnodes, ring_bits))
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    pieces, waiting = [], [(cell, 0, n) for cell, n in sorted(counts.items())]
    for step in range(shards):  # every shard first serves its own keys, then those that come from one shard away, ...
        left = []
        for cell, start, n in waiting:
            shard = routes[cell][step]
            if taken := min(n, room[shard] - used[shard]):
                pieces.append((cell, start, start + taken, shard, used[shard]))
                used[shard] += taken
            if taken < n:
                left.append((cell, start + taken, n - taken))
        waiting = left
    return pieces


def assign_shards(
    df: DataFrame, key: str, shards: int, vnodes: int = 64, ring_bits: int = 14, slack: float = 0.0, tie_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``shard int`` and ``slot long`` (gapless from 0 within a shard) to every row of ``df``."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    ties = [F.col(f"`{c}`") for c in (key, *tie_columns)]
    celled = df.select(
        ring_cell(ties[0], ring_bits).alias("cell"), F.pmod(F.xxhash64(*ties), F.lit(PARTS)).cast("int").alias("part"),
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
    )
    # bounded by the ring and the parts, not by the table
    sizes = materialize(celled.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    counts = {r["cell"]: r["n"] for r in sizes.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    pieces = spark.createDataFrame(
        place(counts, shards, vnodes, ring_bits, slack), "cell int, start long, end long, shard int, first long",
    )
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = [F.col("row").getField(c) for c in (key, *tie_columns)]
    in_part = F.row_number().over(Window.partitionBy("cell", "part").orderBy(F.xxhash64(own[0]), *own)) - 1
    ranked = celled.select("cell", "part", "row", in_part.alias("rank")).join(offsets, ["cell", "part"])
    ranked = ranked.select("cell", "row", (F.col("rank") + F.col("offset")).alias("rank"))
    # the pieces are bounded by the ring and the shards, not by the table
    return (
        ranked.join(F.broadcast(pieces), "cell")
        .where("rank >= start and rank < end")
        .select("row.*", "shard", (F.col("first") + F.col("rank") - F.col("start")).alias("slot"))
    )
