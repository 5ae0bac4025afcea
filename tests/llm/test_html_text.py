import re

from pagequarry.llm import html_text, queries


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def texts(df):
    return [r.text for r in sorted(df.collect(), key=lambda r: r.page_id)]


def test_query_on_articles(spark, sf):
    """The pages' articles hold plain paragraphs: their text is what is left without tags."""
    import html

    given = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op6_html_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", given[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "")).split())
        assert r.text == want and r.n_chars == len(want)


def test_elements(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a>Menu</a></nav>
    <main><h1>Head &amp; more</h1><p>One <b>bo</b>ld&nbsp;<i>word</i><p>Two<br>lines<!-- no --><script>var a = "<p>x</p>";</script>
    <aside>Side</aside><div class="ad-box banner">Buy</div><form><input>Send</form><ul><li>a<li>b</ul>
    <div id="comments"><p>Reader says</p></div><p>End &lt;tag&gt; &#233;</p></main><div class="cookie-notice">Accept</div><footer>Foot</footer></body></html>"""
    assert texts(html_text.extract_text(pages(spark, [("http://a/1", page)]))) == ["Head & more One bold word Two lines a b End <tag> é"]


def test_host_suffix_array(spark):
    """Without an article, runs that distinct pages of a host share go and unique runs stay."""
    shared = "please accept all of our terms and conditions before reading on"
    own = ["first page has quite its own story about mountains", "second page tells something else about the sea", "third one is short"]
    rows = [(f"http://h.example/{i}", f"<body><div>{shared}</div><div>{t}</div><div>{shared}</div></body>") for i, t in enumerate(own)]
    rows += [("http://other.example/1", f"<body><p>{shared}</p></body>"), ("http://h.example/0", rows[0][1])]
    out = texts(html_text.extract_text(pages(spark, rows)))
    assert out[:3] == own and out[3] == shared
    assert out[4] == own[0]
    # one page stored twice is no repetition of itself
    twice = spark.createDataFrame([(1, "http://x/1", f"<body>{shared}</body>")] * 2, "page_id long, url string, html string")
    assert texts(html_text.extract_text(twice)) == [shared] * 2


def test_repeated_is_brute_force():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    rows = [(int(k), *rng.integers(0, 2, 4).tolist()) for k in rng.integers(0, 6, 300)]
    group = pd.DataFrame(rows, columns=["key", "t0", "t1", "t2", "t3"])
    want = [any(r[1:] == q[1:] and r[0] != q[0] for q in rows) for r in rows]
    assert html_text.repeated(group, 4).tolist() == want


def test_odd_rows(spark):
    rows = [(None, None), ("no url", ""), (None, "plain text only"), ("http://a/1", "<p>unclosed <div>deep"), ("http://a/2", "<<>> &bogus; <p"), ("http://a/3", "<p>" * 5000 + "x" + "y" * 300_000)]
    df = pages(spark, rows).withColumn("text", html_col())
    out = html_text.extract_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert texts(out)[:4] == ["", "", "plain text only", "unclosed deep"] and len(texts(out)[5]) == 300_001
    assert html_text.extract_text(pages(spark, rows).where("1 = 0")).count() == 0


def html_col():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_broken_markup():
    art = lambda page: " ".join(t for k, t in html_text.blocks_of(page) if k != html_text.CHROME)
    cases = {
        "<html><head><title>T</title><meta charset=x><p>body text</p>": "body text",
        "<head><title>T</title></head><body>hello": "hello",
        "<article>a<video src=x>b<p>c</article>": "a b c",
        "<article>a<iframe src=q>b</article>": "a b",
        "<article>a<iframe src=q>x</iframe >b</article>": "a b",
        "<article>a<svg><path/>zz</svg>b</article>": "a b",
        "<svg><p>x</p>": "x",
        "<article><p title=don't>A</p><p>it's B</p></article>": "A it's B",
        "<article><a href='x>y' title = \"p > q\">z</a></article>": "z",
        "<article>main<article class='comment'>reader</article> text</article>": "main text",
        "<article><p class='share'>market share rose</p>x</article>": "market share rose x",
        "<article><div class='share'>tell others</div>x</article>": "x",
        "<article>a</article><script>var b": "a",
        "<p>1 < 2 and a=\"b\"</p>": "1 < 2 and a=\"b\"",
        "<article>a</article><a href=": "a",
    }
    for page, want in cases.items():
        assert art(page) == want, page


def test_labelled_paragraphs_go_where_they_are_repeated(spark):
    own = ["market share rose in spring", "nobody expected these numbers", "one more quarter went by"]
    rows = [(f"http://h/{i}", f"<article><p class='share'>tell all of your friends about us</p><p class='share'>{t}</p></article>") for i, t in enumerate(own)]
    assert texts(html_text.extract_text(pages(spark, rows))) == own


def test_hostile_pages_take_linear_time():
    import time

    units = ["<a ", "<div>", "<p title=", '<a x="', "<a x='", "<video>", "<iframe>", "<!--", "<script>", "<title>x</title>", "&", "<", "<a = ", "</p>", "<p class='", "<head>"]
    for unit in units:
        begun = time.process_time()
        html_text.blocks_of(unit * (1_000_000 // len(unit)))
        assert time.process_time() - begun < 8, unit
    begun = time.process_time()
    html_text.blocks_of("<div>" * 100_000 + "</p></b>" * 100_000)
    assert time.process_time() - begun < 12
