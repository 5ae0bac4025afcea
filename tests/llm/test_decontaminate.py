import hashlib
import re

from pagequarry.llm import decontaminate, queries

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[i:i + window]), set()).add(item or "")
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[tuple(w[i:i + n])]
        ids = sorted(found)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in decontaminate.digest(df).collect()), key=str)


def test_query_against_brute_force(spark, sf, texts):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op7_decontaminate(spark, sf).collect()), key=str)
    assert got == brute(texts, items)
    assert any(r[5] for r in got)


def test_short_items_blocks_and_odd_rows(spark, docs_of):
    items = [("b", "alpha Beta"), ("a", "alpha beta"), ("c", "x"), ("d", None), ("e", "..."), (None, "one two three four five six seven eight nine ten eleven"), ("a", "alpha beta")]
    docs = [*ODD, (20, "Alpha, BETA! alpha-beta gamma"), (20, "Alpha, BETA! alpha-beta gamma"), (21, "x x x"), (22, "zero one two three four five six seven eight nine ten eleven twelve")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs, items)
    for limit in (200_000, 2):
        assert rows(decontaminate.find_contamination(docs_of(docs), bench, block_windows=limit)) == want
    assert decontaminate.find_contamination(docs_of([]), bench).count() == 0
    assert not any(r[5] for r in rows(decontaminate.find_contamination(docs_of(docs), bench.where("1 = 0"))))


def test_shifts_never_skip_an_occurrence():
    import itertools

    patterns = {p: ["i"] for p in itertools.islice(itertools.product((b"a", b"b"), repeat=5), 0, 32, 5)}
    table = decontaminate.PatternTable(patterns)
    for text in itertools.product((b"a", b"b", b"c"), repeat=8):
        assert [s for s, _ in table.search(list(text))] == [i for i in range(4) if text[i:i + 5] in patterns]
