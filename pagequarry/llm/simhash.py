"""SimHash near-duplicates through vantage-point trees.

1. Every text gets a fingerprint of ``64 * words64`` bits over its word shingles (with ``ratio``: its distinct ones).
2. Distinct fingerprints are dealt over shards by a vantage-point tree: a node sends fingerprints within its radius of
   its vantage point inside, the others outside.  By the triangle inequality a fingerprint outside can only have a partner
   inside if its distance is at most the node's radius plus the link radius: such boundary fingerprints also visit the
   inside shard, so every linked pair meets in the home shard of one of the two.
3. A shard's home points and visitors are dealt into parts of bounded size, whatever the tree prunes; a group of two parts
   goes on with a tree of its own down to small blocks, compares them, and returns for each set of linked fingerprints the
   links to the smallest one: as many rows as fingerprints, never all pairs.
4. Connected components of these links are found by alternating star contractions on written tables.
5. With ``ratio``, linked fingerprints are candidates only.  The nodes are the distinct sets of shingles; a candidate
   component's sets meet in groups of bounded size, pairs alike by ``ratio`` or more (Jaccard) stay linked, and components
   are taken of those links.

``ratio`` (optional) is the least likeness of partners, so also of their sizes (distinct shingles of the smaller over those
of the larger): sizes fall into classes of one ratio step, and a fingerprint also visits the next class.  The driver holds a bounded sample of
``sample`` fingerprints to lay out the tree, never more.

Edge cases: null and empty texts (no words) have fingerprint zero and link like any other; equal texts share one
node and cost one row after pre-aggregation; rows with a null id get the component of their fingerprint; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A block is compared with itself and its visitors at once.
BLOCK = 512
#: Shingles and nodes of one part of a candidate component (a group that confirms has two parts).
PART_SHINGLES, PART_NODES = 1_000_000, 4_096
#: Fingerprints of fewer shingles than this carry too few votes to compare by distance: they must be equal.
FEW_SHINGLES = 4


def shingles_of(text: bytes | None, size: int) -> list[bytes]:
    """Word shingles (repeats included) of a UTF-8 text with A-Z lower-cased; a short text is one shingle."""
    words = text.lower().split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))]


def fingerprint(shingles: list[bytes], words64: int = 1) -> np.ndarray:
    """``words64`` unsigned 64-bit words; a bit is set if over half the shingle hashes have it.

    The first word votes with XXH64 (seed 42), the others with SplitMix64 of it.
    """
    out = np.zeros(words64, np.uint64)
    if not shingles:
        return out
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    for w in range(words64):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            x = hashes[at:at + (1 << 14)]
            if w:
                with np.errstate(over="ignore"):
                    x = x + np.uint64(w) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    x = x ^ (x >> np.uint64(31))
            votes += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(votes * 2 > len(hashes)).view(">u8")[0]
    return out


def shingle_set(shingles: list[bytes]) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles)))


def _fingerprints(size: int, words64: int, sets: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hexes, sizes, nodes = [], [], []
            for text in batch["__text"]:
                shingles = shingles_of(text, size)
                if sets:  # likeness is that of sets: a repeated shingle votes once
                    shingles = list(dict.fromkeys(shingles))
                hexes.append("".join(f"{int(w):016x}" for w in fingerprint(shingles, words64)))
                sizes.append(len(shingles) if sets else 0)
                nodes.append(xxhash.xxh128_hexdigest(shingle_set(shingles).tobytes()) if sets else hexes[-1])
            yield pd.DataFrame({"__id": batch["__id"], "__md5": batch["__md5"], "fingerprint": hexes, "size": sizes, "node": nodes})

    return run


def text_md5(text: str):
    """What stands for a text in the identity of its row; null has its own."""
    return F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit(""))


def fingerprints(df: DataFrame, id_col: str, text: str, size: int, words64: int = 1, sets: bool = False) -> DataFrame:
    """``__id, __md5 (of the text), fingerprint (hex), size (distinct shingles), node`` of every row.

    With ``sets`` a node is the digest of a set of shingles; without, it is the fingerprint, and md5 and size are left out
    ("" and 0).
    """
    kept = df.select(F.col(f"`{id_col}`").alias("__id"), (text_md5(text) if sets else F.lit("")).alias("__md5"), F.col(f"`{text}`").cast("binary").alias("__text"))
    kind = kept.schema["__id"].dataType.simpleString()
    return kept.mapInPandas(_fingerprints(size, words64, sets), f"__id {kind}, __md5 string, fingerprint string, size long, node string")


def unpack(hexes: pd.Series | list[str], words64: int) -> np.ndarray:
    """Fingerprints in hex as an array ``(n, words64)`` of unsigned words."""
    return np.frombuffer(bytes.fromhex("".join(hexes)), ">u8").astype(np.uint64).reshape(-1, words64)


def distances(a: np.ndarray, b: np.ndarray, words: int | None = None) -> np.ndarray:
    """Hamming distances of broadcastable fingerprint arrays (of their first ``words``)."""
    total = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, words or a.shape[-1]):
        total += np.bitwise_count(a[..., w] ^ b[..., w])
    return total


def split_point(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """A vantage point and the median distance to it, or None where that splits nothing."""
    vantage = points[rng.integers(len(points))]
    d = distances(points, vantage)
    radius = int(np.median(d))
    if (d <= radius).all():
        radius = int(d.max()) - 1
    return (vantage, radius) if (d <= radius).any() and (d > radius).any() else None


def plan_tree(sample: np.ndarray, depth: int, seed: int = 7):
    """Nested ``(vantage, radius, inside, outside)`` with shard numbers as leaves."""
    rng, shards = np.random.default_rng(seed), iter(range(1 << 30))

    def node(points: np.ndarray, depth: int):
        cut = split_point(points, rng) if depth and len(points) > 1 else None
        if cut is None:
            return next(shards)
        d = distances(points, cut[0])
        return *cut, node(points[d <= cut[1]], depth - 1), node(points[d > cut[1]], depth - 1)

    return node(sample, depth)


def route(tree, points: np.ndarray, radius: int, live: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, indices, home)``: where points live, and where boundary points visit.  With ``live=False`` all are
    visitors, which meet every point within the radius in its home shard."""

    def go(node, index: np.ndarray, home: np.ndarray):
        if not len(index):
            return
        if isinstance(node, int):
            yield node, index, home
            return
        vantage, cut, inside, outside = node
        d = distances(points[index], vantage)
        # what lives outside can have partners inside only within the triangle bound
        yield from go(inside, index[d <= cut + radius], home[d <= cut + radius] & (d[d <= cut + radius] <= cut))
        # a visitor was sent for the sake of points on this side too; a point that lives inside meets those from outside there
        far = (d > cut) | (~home & (d > cut - radius))
        yield from go(outside, index[far], home[far])

    yield from go(tree, np.arange(len(points)), np.full(len(points), live))


def _level(sizes: np.ndarray, ratio: float | None) -> np.ndarray:
    """The size class: partners within the ratio are in the same class or in neighbouring ones."""
    return (np.log(np.maximum(sizes, 1)) / -math.log(ratio) if ratio else np.zeros(len(sizes))).astype(np.int32)


def _routed(batches: Iterator[pd.DataFrame], tree, words64: int, radius: int, ratio: float | None):
    """``points, sizes, shard, indices, home, level`` of every shard that points of a batch go to."""
    for batch in batches:
        if not len(batch):
            continue
        points, sizes = unpack(batch["fingerprint"], words64), batch["size"].to_numpy()
        level = _level(sizes, ratio)
        for shard, index, home in route(tree, points, radius):
            yield points, sizes, shard, index, home, level[index]
        if ratio:  # the next class may have larger partners
            for shard, index, home in route(tree, points, radius, live=False):
                yield points, sizes, shard, index, home, level[index] + 1


def _counter(tree, words64: int, radius: int, ratio: float | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, shard, _, home, level in _routed(batches, tree, words64, radius, ratio):
            yield pd.DataFrame({"shard": shard, "level": level, "home": home}).value_counts(["shard", "level", "home"]).rename("n").reset_index()

    return run


def _part_hash(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for w in range(points.shape[1]):
            out = (out ^ points[:, w]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(32)


def _dealer(tree, words64: int, radius: int, ratio: float | None, parts: dict[tuple[int, int], tuple[int, int]]):
    """Points with ``shard, level, part, other, home``: the home points of a part meet each other and the first part of the
    visitors where the two numbers are equal, and another part of home points or visitors where they are not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for points, sizes, shard, index, home, levels in _routed(batches, tree, words64, radius, ratio):
            signed, hashes = points.view(np.int64), _part_hash(points[index], sizes[index])
            for level in np.unique(levels).tolist():
                homes, visits = parts.get((shard, level), (0, 0))
                own, guest = np.nonzero((levels == level) & home)[0], np.nonzero((levels == level) & ~home)[0]

                def rows(chosen, part, other, is_home):
                    return pd.DataFrame({
                        **{f"f{w}": signed[index[chosen], w] for w in range(words64)},
                        "size": sizes[index[chosen]], "shard": shard, "level": level, "part": part, "other": other, "home": is_home,
                    })

                p = (hashes[own] % np.uint64(max(1, homes))).astype(np.int64)
                v = (hashes[guest] % np.uint64(max(1, visits))).astype(np.int64)
                for q in range(homes):  # nothing lives in a group without home points: nothing to visit
                    if len(own):
                        yield rows(own, np.minimum(p, q), np.maximum(p, q), p <= q)
                    if len(guest):
                        yield rows(guest, q, np.where(v == 0, q, homes + v), False)
                for q in range(1, visits if len(own) else 0):
                    yield rows(own, p, homes + q, True)

    return run


def _link_block(points, sizes, mine, other, radius, ratio, parent):
    """Join linked indices of ``mine`` and ``other`` in ``parent``."""
    step = max(1, (1 << 19) // max(1, len(other)))
    for at in range(0, len(mine), step):
        a = mine[at:at + step]
        # three quarters of the bits already exclude nearly all pairs: a part of the distance is no more than the whole
        near = distances(points[a][:, None, :], points[other][None, :, :], -(-3 * points.shape[1] // 4)) <= radius
        if ratio:
            sa, so = sizes[a][:, None], sizes[other][None, :]
            near &= np.minimum(sa, so) >= ratio * np.maximum(sa, so) - 1e-9
        i, j = np.nonzero(near)
        d = distances(points[a[i]], points[other[j]])
        linked = d <= radius
        if ratio:
            linked &= (np.minimum(sizes[a[i]], sizes[other[j]]) >= FEW_SHINGLES) | ((d == 0) & (sizes[a[i]] == sizes[other[j]]))
        # a large group of near copies is soon of one root: its other pairs are not gone through one by one
        x, y = _roots(parent, a[i[linked]]), _roots(parent, other[j[linked]])
        for pair in np.unique((np.minimum(x, y) * len(parent) + np.maximum(x, y))[x != y]).tolist():
            x, y = _root(parent, pair // len(parent)), _root(parent, pair % len(parent))
            if x != y:
                parent[max(x, y)] = min(x, y)


def _root(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _roots(parent: np.ndarray, index: np.ndarray) -> np.ndarray:
    found = parent[index]
    while (parent[found] != found).any():
        found = parent[found]
    parent[index] = found
    return found


def link_points(
    points: np.ndarray, sizes: np.ndarray, home: np.ndarray, radius: int, ratio: float | None = None, within: bool = True,
) -> np.ndarray:
    """For each point, the smallest index it is linked to, through home points, in this shard; without ``within`` home points
    are compared with visitors only."""
    parent, rng = np.arange(len(points)), np.random.default_rng(11)

    def go(mine: np.ndarray, visitors: np.ndarray):
        cut = split_point(points[mine], rng) if len(mine) > BLOCK else None
        if cut is not None:
            dm, dv = distances(points[mine], cut[0]), distances(points[visitors], cut[0])
            inside = visitors[dv <= cut[1] + radius]
            if within:
                inside = np.concatenate([mine[(dm > cut[1]) & (dm <= cut[1] + radius)], inside])
            outside = visitors[dv > cut[1] - radius]
            # a cut that sends nearly all across prunes nothing: then compare directly
            if len(inside) + len(outside) + len(mine) < 1.8 * (len(mine) + len(visitors)):
                go(mine[dm <= cut[1]], inside)
                go(mine[dm > cut[1]], outside)
                return
        by_size = ratio and len(mine) > BLOCK  # no pruning by distance: go along the sizes
        if by_size:
            mine = mine[np.argsort(sizes[mine], kind="stable")]
        for at in range(0, len(mine), BLOCK):
            a, own = mine[at:at + BLOCK], mine[at if within else len(mine):]
            other = np.concatenate([own, visitors])
            if by_size:
                other = other[(sizes[other] >= sizes[a[0]] * ratio - 1e-9) & (sizes[other] <= sizes[a[-1]] / ratio + 1e-9)]
            _link_block(points, sizes, a, other, radius, ratio, parent)

    go(np.nonzero(home)[0], np.nonzero(~home)[0])
    return _roots(parent, np.arange(len(points)))


def _linker(words64: int, radius: int, ratio: float | None):
    names = [f"f{w}" for w in range(words64)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*names, "size"], kind="stable")
        points, sizes = group[names].to_numpy(np.int64).view(np.uint64), group["size"].to_numpy()
        within = bool(group["part"].iloc[0] == group["other"].iloc[0])
        roots = link_points(np.ascontiguousarray(points), sizes, group["home"].to_numpy(), radius, ratio, within)
        linked = np.nonzero(roots != np.arange(len(roots)))[0]

        def node(i):
            return "".join(f"{int(w):016x}" for w in points[i]) + f":{sizes[i]}"

        return pd.DataFrame({"a": [node(i) for i in roots[linked]], "b": [node(i) for i in linked]}, dtype=object)

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``links (a, b)``: alternating large and small star contractions, each written to the
    shared folder, until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select("u", "v", "m")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        edges = materialize(new.where("u <> v").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def dealt_points(prints: DataFrame, words64: int, radius: int, ratio: float | None, sample: int, shard_points: int) -> DataFrame:
    """``prints (fingerprint, size)``, distinct ones, as points of groups ``shard, level, part, other``.

    A group has one part of a shard's home points and one part of its visitors or other home points.  Parts are dealt by a
    hash of distinct points into as many as hold ``shard_points`` each on average, whatever the tree prunes.
    """
    level = F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(ratio)) if ratio else F.lit(0)
    largest = prints.groupBy(level.alias("level")).count().agg(F.max("count")).first()[0] or 0
    laid = prints.select("fingerprint").orderBy(F.xxhash64("fingerprint")).limit(sample).collect()  # bounded by the parameter
    depth = min(12, max(0, math.ceil(math.log2(max(1, largest) / shard_points))))
    tree = plan_tree(unpack([r[0] for r in laid], words64), depth) if laid else 0
    # one row for each shard, level and kind: the driver sees counts alone
    points = prints.select("fingerprint", "size")
    counts = points.mapInPandas(_counter(tree, words64, radius, ratio), "shard int, level int, home boolean, n long").groupBy("shard", "level", "home").agg(F.sum("n").alias("n"))
    parts: dict[tuple[int, int], tuple[int, int]] = {}
    for r in counts.collect():
        homes, visits = parts.get((r["shard"], r["level"]), (0, 0))
        n = -(-r["n"] // shard_points)
        parts[r["shard"], r["level"]] = (n, visits) if r["home"] else (homes, n)
    fields = "".join(f"f{w} long, " for w in range(words64))
    return points.mapInPandas(
        _dealer(tree, words64, radius, ratio, parts), fields + "size long, shard int, level int, part int, other int, home boolean",
    )


def candidate_links(prints: DataFrame, words64: int, radius: int, ratio: float | None, sample: int, shard_points: int) -> DataFrame:
    """Links ``a, b`` between ``prints`` whose distance is within the radius: as many as hold linked ones of a group together."""
    dealt = dealt_points(prints, words64, radius, ratio, sample, shard_points)
    return dealt.groupBy("shard", "level", "part", "other").applyInPandas(_linker(words64, radius, ratio), "a string, b string")


def _confirm_sets(sets: list[np.ndarray], points: np.ndarray, part: np.ndarray, radius: int, ratio: float) -> list[tuple[int, int]]:
    """Pairs of sets alike by ``ratio`` or more, as many as hold the linked ones together.  With two parts only pairs across
    them are looked at."""
    sizes, label, links = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    left = np.nonzero(part == part.min())[0]
    right = np.arange(len(sets)) if part.min() == part.max() else np.nonzero(part != part.min())[0]
    for i in left:
        # what is linked already needs no second link
        j = right[(label[right] != label[i]) & (np.minimum(sizes[right], sizes[i]) >= ratio * np.maximum(sizes[right], sizes[i]) - 1e-9)]
        for j in j[distances(points[j], points[i]) <= radius]:
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= ratio * (sizes[i] + sizes[j] - both) - 1e-9:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _confirmer(words64: int, radius: int, ratio: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        names = group["node"].tolist()
        found = _confirm_sets([np.frombuffer(x, np.uint64) for x in group["set"]], unpack(group["fingerprint"], words64), group["part"].to_numpy(), radius, ratio)
        return pd.DataFrame({"a": [names[i] for i, _ in found], "b": [names[j] for _, j in found]}, dtype=object)

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch[at:at + 256]
                yield pd.DataFrame({"node": part["node"], "set": [shingle_set(shingles_of(t, size)).tobytes() for t in part["__text"]]})

    return run


def confirmed_links(
    df: DataFrame, text: str, nodes: DataFrame, links: DataFrame, shingle: int, words64: int, radius: int, ratio: float,
) -> DataFrame:
    """Of the candidates, links ``a, b`` between nodes whose sets of shingles are alike by ``ratio`` or more.

    The nodes of a candidate component meet in groups of two parts of bounded size, so that every pair meets; a group returns
    fewer links than it has nodes.
    """
    roots = components(links).withColumnRenamed("node", "print")
    held = nodes.join(roots, "print", "left").select("node", "fingerprint", "size", "md5", F.coalesce("root", "print").alias("root"))
    parts = held.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / PART_SHINGLES), F.ceil(F.count(F.lit(1)) / PART_NODES)).alias("parts"), F.count(F.lit(1)).alias("n"))
    members = materialize(held.join(parts.where("n > 1").drop("n"), "root"), "candidates")
    # the sets of candidates alone; one text stands for each node
    texts = df.select(text_md5(text).alias("md5"), F.col(f"`{text}`").cast("binary").alias("__text"))
    sets = texts.join(members.select("md5", "node"), "md5").mapInPandas(_sets(shingle), "node string, set binary").dropDuplicates(["node"])
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    paired = members.join(sets, "node").select("root", "node", "fingerprint", "set", part.alias("part"), F.explode(others).alias("other"))
    paired = paired.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")
    return paired.groupBy("root", "low", "high").applyInPandas(_confirmer(words64, radius, ratio), "a string, b string")


def _classes(
    df: DataFrame, id_col: str, text: str, shingle: int, words64: int, radius: int, ratio: float | None, sample: int, shard_points: int,
) -> tuple[DataFrame, DataFrame]:
    """The prints of all rows, and ``node, fingerprint, first, root`` of all nodes; ``first`` is the least identity
    ``(nameless, id, md5, n)`` among a node's rows, and ``n`` rows have it."""
    prints = materialize(fingerprints(df, id_col, text, shingle, words64, ratio is not None), "fingerprints")
    rows = prints.groupBy("node", "fingerprint", "size", "__id", "__md5").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("__id").isNull().alias("nameless"), F.col("__id").alias("id"), F.col("__md5").alias("md5"), "n"))
    nodes = materialize(
        rows.groupBy("node", "fingerprint", "size").agg(first.alias("first")).select("*", "first.md5", F.concat_ws(":", "fingerprint", "size").alias("print")), "nodes",
    )
    links = candidate_links(nodes.select("fingerprint", "size").distinct(), words64, radius, ratio, sample, shard_points)
    key = "print"
    if ratio:
        links, key = confirmed_links(df, text, nodes, links, shingle, words64, radius, ratio), "node"
    roots = components(links).withColumnRenamed("node", "key")
    return prints, nodes.withColumn("key", F.col(key)).join(roots, "key", "left").select("node", "fingerprint", "first", F.coalesce("root", "key").alias("root"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, words64: int = 8, radius: int = 120, ratio: float | None = 0.8,
    sample: int = 65_536, shard_points: int = 50_000,
) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row; a component is named by the smallest id in it.

    The defaults link texts whose five-word shingles are alike by 0.8 or more: fingerprints within the radius are candidates,
    the sets of shingles decide.  At that likeness two 512-bit fingerprints differ in 77 bits on average (8 more or less; 96
    for sets of four and five shingles), unrelated ones in 256.
    """
    prints, named = _classes(df, id_col, text, shingle, words64, radius, ratio, sample, shard_points)
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    classes = named.join(least, "root").select("node", F.col("least.id").alias("component_id"))
    return prints.join(classes, "node", "left").select(F.col("__id").alias(id_col), "fingerprint", "component_id")


def representatives(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, words64: int = 8, radius: int = 120, ratio: float = 0.8,
    sample: int = 65_536, shard_points: int = 50_000,
) -> DataFrame:
    """``id, md5, n`` of the least row of every component: by id, nulls last, then by the MD5 of the text; ``n`` rows are
    equal in both."""
    _, named = _classes(df, id_col, text, shingle, words64, radius, ratio, sample, shard_points)
    return named.groupBy("root").agg(F.min("first").alias("least")).select("least.id", "least.md5", "least.n")
