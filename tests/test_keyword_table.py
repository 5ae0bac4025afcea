"""Keywords by the table: the automaton against one replacement per keyword."""

import pandas as pd
from pyspark.sql import functions as F

from pagequarry.operators import page_facts
from pagequarry.operators.page_facts import match_keyword_table, match_keywords

WORDS = ["aa", "Aa", "a", "ab", "bab", "straße", "ñandú", "one two", "x" * 30, "  padded ", "missing"]
TEXTS = [
    "aaaa abab bababab", "", None, "Straße STRASSE ñANDÚ", "one  two\n one\ttwo", "x" * 75, "word " * 40 + "padded" + " tail" * 40, "😀 aa 😀", "b" * 50 + "ab",
]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_same_hits_as_one_by_one(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")
    words = spark.createDataFrame([(w,) for w in [*WORDS, *WORDS, "", "   ", None]], "keyword string")
    want = rows(match_keywords(texts, WORDS, "text"))
    assert len(want) > 15
    assert rows(match_keyword_table(texts, words, "text")) == want
    assert rows(match_keyword_table(texts, words, "text", block=20)) == want  # many blocks


def test_pages_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>Alpha beta</p>"), (2, "http://b.example/", "")], "page_id int, url string, html string")
    words = spark.createDataFrame([("beta",), ("alpha beta",)], "keyword string")
    assert rows(match_keyword_table(pages, words)) == rows(match_keywords(pages, ["beta", "alpha beta"]))
    assert match_keyword_table(pages, words.where("1 = 0")).count() == 0
    assert match_keyword_table(pages.where("1 = 0"), words).count() == 0


def test_ten_thousand_keywords_are_one_pass(spark):
    texts = spark.range(20).select(F.col("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("k"), F.col("id") * 500 + i, F.lit("e")))).alias("text"))
    words = spark.range(10_000).select(F.concat(F.lit("k"), "id", F.lit("e")).alias("keyword"))
    found = match_keyword_table(texts, words, "text")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert found.count() == 2_000 and found.agg(F.max("count")).first()[0] == 1


def test_hits_leave_a_batch_in_bounded_parts():
    texts = pd.DataFrame({"id": range(3_000), "t": [f"Aa b{i} cc aa" for i in range(3_000)], "lo": [f"aa b{i} cc aa" for i in range(3_000)]})
    words = {w: [w] for w in ("aa", "b", "cc", "a", "c", " ", " c", "aa b", "c a", "zz")}
    parts = list(page_facts._scanner(words)(iter([texts, texts[:0]])))
    assert sum(map(len, parts)) == 9 * 3_000 and max(map(len, parts)) < page_facts.KEYWORD_HITS + len(words)
    got = pd.concat(parts)
    assert got.groupby("id").size().eq(9).all() and set(got.loc[got["keyword"] == "a", "count"]) == {4}
