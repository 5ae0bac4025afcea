"""Anchors of pages against a plain pattern, and their time on long pages."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import links

PARTS = [
    '<a href="/x">', "<a class=c href='/y' id=\"i\">", '<A data-href="/w" HREF="/v">', '<a name="n">', '<a href="">', "<a ", "<abbr>", "</a>", "</A>", "</a >",
    "</a>", "text ", "a longer text ", "<b>", "</b>", "<", ">", "<!-- c -->", "\n", "é€",
]


def by_pattern(html, limit):
    text = r"[\s\S]*?" if limit is None else r"[\s\S]{0,%d}?" % limit
    return re.findall(r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>(" + text + ")</a>", html)


@pytest.mark.parametrize("limit", [None, 0, 12])
def test_as_by_pattern(spark, limit):
    rng = random.Random(5)
    pages = ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, h string")
    got = {r.i: [tuple(x) for x in r.a] for r in df.select("i", links.closed_anchors(F.col("h"), limit).alias("a")).collect()}
    assert got == {i: by_pattern(h, limit) for i, h in enumerate(pages)}
    assert any(len(v) > 2 for v in got.values())


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("<a href='x'>open",)], "h string")
    assert [r.a for r in df.select(links.closed_anchors(F.col("h")).alias("a")).collect()] == [None, [], []]


def test_first_text_counts_at_any_length(spark):
    long = "<b>" + "many words " * 400 + "Tariffs</b>"
    html = f'<a href="/p/q">{long}</a><a href="/p/q#again">contact</a><a href="/s">Tariffs</a><a href="/tariffs">x</a>'
    pages = spark.createDataFrame([(1, "https://a.org/", html)], "page_id long, url string, html string")

    def scored(**more):
        return [(r.url, r.score) for r in links.score_links(pages, ["TARIFFS "], **more).orderBy("rank").collect()]

    assert scored() == [("https://a.org/tariffs", 9.5), ("https://a.org/s", 3.5), ("https://a.org/p/q", 3.0)]
    # with a limit the long anchor is none, and the short one is the first
    assert scored(max_anchor=120) == [("https://a.org/tariffs", 9.5), ("https://a.org/p/q", 5.0), ("https://a.org/s", 3.5)]


@pytest.mark.parametrize("html", ["<a " * 300_000, "<a href='/x'" * 80_000, "<a>" * 300_000 + "</a>", "<" * 900_000 + "</a>", "".join(f'<a href="/n/{i}">n</a>' for i in range(40_000))])
def test_long_pages_in_linear_time(spark, html):
    pages = spark.createDataFrame([(1, "https://a.org/", html)], "page_id long, url string, html string")
    began = time.monotonic()
    rows = links.score_links(pages).count()
    assert rows == (40_000 if "/n/" in html else 0)
    assert time.monotonic() - began < 20
