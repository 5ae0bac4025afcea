"""Nothing is cut: depth of structured data, items of a page, rows that decide on a list's layout, lines of a page."""

import json

from pagequarry.operators import addresses, campaigns, structured


def pages(spark, *bodies):
    rows = [(i, f"https://q{i}.test/", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def script(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def test_any_depth(spark):
    deep = {"@type": "Product", "name": 'in "[[" twenty \\ lists'}
    for i in range(20):
        deep = [deep] if i % 3 else {"@type": "Thing", "@graph": [deep]}
    got = structured.extract_products(pages(spark, script(deep), script([[{"@type": "Product", "name": "two"}]]), script("{broken [[["), "none"))
    assert sorted((r.page_id, r.name) for r in got.collect()) == [(0, 'in "[[" twenty \\ lists'), (1, "two")]


def test_all_items_of_a_page(spark):
    many = [{"@type": "Product", "name": f"p{i}"} for i in range(250)]
    p = pages(spark, script(many))
    assert structured.extract_products(p).count() == 250
    assert structured.extract_products(p, per_page=7).count() == 7


def test_layout_from_all_rows(spark):
    rows = [["Who", "Where"], *([f"n{i}", "nowhere"] for i in range(80)), ["Ann", "ann@one.test"], ["Bo", "bo@two.test"]]
    got = campaigns.parse_recipients(spark.createDataFrame([("l", rows)], "list_id string, rows array<array<string>>"))[0]
    assert sorted(r.email for r in got.collect()) == ["ann@one.test", "bo@two.test"]


def test_address_after_many_lines(spark):
    lines = "".join(f"<p>line {i} of the page</p>" for i in range(4500))
    got = addresses.extract_addresses(pages(spark, lines + "<p>12 Main Street, Suite 5, Springfield, IL 62704</p>"))
    assert [r.address for r in got.collect()] == ["12 Main Street, Suite 5, Springfield, IL 62704"]


def test_url_lists_have_a_limit_only_if_asked(spark):
    from pagequarry.sources.readers import url_list

    text = "\n".join("no url" if i % 10 == 0 else f"site{i}.org/p" for i in range(300))
    lists = spark.createDataFrame([("l", text)], "list_id string, text string")
    assert url_list(lists).filter("taken").count() == 270
    limited = url_list(lists, limit=100).filter("taken").orderBy("ord").collect()
    assert len(limited) == 100 and limited[-1].ord == 111
