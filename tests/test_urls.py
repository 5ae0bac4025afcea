from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.functions.html import attr, body_text, html_to_text, markup, start_tags, visible_text
from pagequarry.functions.text import decode_entities
from pagequarry.operators import links


def test_normalize_and_key(spark):
    cases = {
        "HTTP://Ex.COM:80/a/../b//?q=1#x": ("http://ex.com/b?q=1#x", "ex.com"),
        " example.com/für/ ": ("https://example.com/f%C3%BCr", "example.com"),
        "https://a.org:8443/": ("https://a.org:8443", "a.org:8443"),
        "not a url": ("https://not a url", ""),
        "http://a.org/x/./y/..": ("http://a.org/x", "a.org"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    for r in links.normalize_urls(df).collect():
        assert (r.normalized, r.domain) == cases[r.url]


def test_normalize_is_idempotent(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").select("url")
    once = df.select(urls.normalize_url(F.col("url")).alias("a"))
    assert once.filter(urls.normalize_url(F.col("a")) != F.col("a")).count() == 0


def test_resolve(spark):
    cases = {
        "e": "http://a.b/c/e", "../f": "http://a.b/f", "/g/./h/": "http://a.b/g/h", "?y": "http://a.b/c/d", "//k.l/m": "http://k.l/m",
        "https://Q.r": "https://q.r", "/für ß": "http://a.b/f%C3%BCr%20%C3%9F", "#z": "http://a.b/c/d",
    }
    df = spark.createDataFrame([("http://a.b/c/d?x", h) for h in cases], "b string, h string")
    s = F.get(urls.resolve_links(urls.url_struct(F.col("b")), F.array("h")), F.lit(0))
    for r in df.select("h", urls.strip_query_fragment(s).alias("u")).collect():
        assert r.u == cases[r.h]


def test_same_site(spark):
    df = spark.createDataFrame([("a.b", True), ("x.a.b", True), ("xa.b", False), (None, False)], "h string, want boolean")
    assert df.filter(urls.is_same_site(F.col("h"), F.lit("a.b")) != F.col("want")).count() == 0


def test_entities(spark):
    df = spark.createDataFrame([("a&amp;b &#169; &#xe9; &copy &nope; &#x1F600;x & y",)], "t string")
    assert df.select(decode_entities(F.col("t"))).first()[0] == "a&b © é &copy &nope; \U0001f600x & y"


def test_markup_helpers(spark):
    html = (
        "<html><head><title>T</title></head><body class='x'><!-- <a href=no> --><p>Hi<br>yo</p><a data-href=\"q\" href='x&amp;y'>t</a>"
        "<script>var t=\"</p><a href=1>\"; if (a<b) {}</script><select><option>one<option>two</select> end"
    )
    df = spark.createDataFrame([(html,)], "h string")
    m = markup(F.col("h"))
    hrefs = F.transform(start_tags(m, "a"), lambda t: attr(t, "href"))
    row = df.select(hrefs, visible_text(F.col("h")), body_text(F.col("h"))).first()
    assert row[0] == ["x&y"]
    assert row[1] == "Hi\nyo\nt\nend"
    # script text counts as body text
    assert 'var t="</p><a href=1>"; if (a<b) {}' in row[2]


def test_mail_text(spark):
    df = spark.createDataFrame([("<style>x</style><p>A&nbsp;b</p><ul><li>c</li></ul><br>d &amp; e",)], "h string")
    assert df.select(html_to_text(F.col("h"))).first()[0] == "A b\n• c\n\nd & e"


def test_priority_links_and_scores(spark):
    html = '<a href="/z">z</a><a href="/team/x">t</a><a href="/file.pdf">f</a><a href="mailto:a@b.c">m</a><a href="/z#q">again</a><a href="https://other.org/">o</a><a href="/p">Contact</a>'
    pages = spark.createDataFrame([(1, "https://a.org/", html)], "page_id long, url string, html string")
    ranked = [r.url for r in links.rank_links(pages).orderBy("rank").collect()]
    assert ranked == ["https://a.org/team/x", "https://a.org/z", "https://a.org/file.pdf", "https://a.org/p"]
    scored = [(r.url, r.score) for r in links.score_links(pages).orderBy("rank").collect()]
    assert scored == [("https://a.org/team/x", 9.0), ("https://a.org/p", 5.5), ("https://a.org/z", -0.5)]
