import re

import numpy as np
import xxhash

from pagequarry.llm import queries, simhash

from .conftest import ODD


def brute_print(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_against_brute_force(spark, sf, texts):
    prints = [brute_print(t, 3) for _, t in texts]
    comp = brute_components(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == {d: (f"{prints[i]:016x}", texts[comp[i]][0]) for i, (d, _) in enumerate(texts)}


def test_deep_trees_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    near = base[rng.integers(0, 700, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    near2 = near[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, near2]))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    links = simhash.link_points(points[:, None], np.zeros(len(points)), np.ones(len(points), bool), 2)
    assert links.tolist() == brute_components([int(p) for p in points], 2)
    # the distributed tree: every linked pair meets in a home shard
    tree = simhash.plan_tree(points[::3, None], 5)
    homes, shards = {}, {}
    for shard, index, home in simhash.route(tree, points[:, None], 2):
        for i, h in zip(index.tolist(), home.tolist()):
            shards.setdefault(shard, []).append((i, h))
            if h:
                assert i not in homes
                homes[i] = shard
    assert len(homes) == len(points)
    met = {(i, j) for members in shards.values() for i, h in members if h for j, _ in members}
    d = simhash.distances(points[:, None, None], points[None, :, None])
    for i, j in zip(*np.nonzero(d <= 2)):
        assert (i, j) in met or (j, i) in met


def test_near_copies_by_ratio(docs_of):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(40):
        own = rng.choice(words, 200)
        for c in range(3):
            copy = own.copy()
            copy[rng.integers(0, 200, c)] = "changed"
            rows.append((g * 10 + c, " ".join(copy)))
            group[g * 10 + c] = g * 10
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert out == group


def test_odd_rows(docs_of):
    out = simhash.near_duplicates(docs_of(ODD), shingle=3, words64=1, radius=2, ratio=None).collect()
    assert len(out) == len(ODD)
    empty = [r for r in out if r.fingerprint == "0" * 16]
    assert len(empty) == 4 and {r.component_id for r in empty} == {1}
    assert {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(docs_of([])).count() == 0


def exact_components(rows, size=5, least=0.8):
    """Component ids by the sets of shingles alone."""
    sets = [set(simhash.shingles_of((t or "").encode(), size)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def test_links_are_alike_by_their_sets(docs_of, texts, monkeypatch):
    rng = np.random.default_rng(8)
    rows = list(texts)
    for g in range(30):  # chains: each step changes some words, likeness from 0.6 to 0.95
        words = [f"g{g}w{i}" for i in range(150)]
        for c in range(8):
            rows.append((100_000 + g * 10 + c, " ".join(words)))
            for at in rng.choice(150, 1 + g % 6, replace=False):
                words[at] = f"c{c}x{at}"
    rows += [(200_000 + n, " ".join(f"few{i}" for i in range(n))) for n in range(1, 12)]
    want = exact_components(rows)
    df = docs_of(rows).cache()
    for parts in (4_096, 3):
        monkeypatch.setattr(simhash, "PART_NODES", parts, raising=False)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
        assert got == want
    df.unpersist()


def test_groups_are_bounded(docs_of, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(300):  # of about one size: no class and no cut by distance makes the groups smaller
        words = [f"g{g}w{i}" for i in range(rng.integers(58, 64))]
        rows.append((2 * g, " ".join(words)))
        if g % 3 == 0:
            rows.append((2 * g + 1, " ".join([*words[:-1], "other"])))
    make, points = simhash._linker, 40

    def bounded(words64, radius, ratio):
        link = make(words64, radius, ratio)

        def run(group):
            assert len(group) <= 2 * points * 1.5, len(group)
            return link(group)

        return run

    monkeypatch.setattr(simhash, "_linker", bounded)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows), shard_points=points).collect()}
    assert got == exact_components(rows)
