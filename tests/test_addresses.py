from pyspark.sql import functions as F

from pagequarry.functions.addresses import clean_address, country_name, finalize_addresses, is_country_only
from pagequarry.operators.addresses import extract_addresses, page_containers
from pagequarry.operators.structured import extract_company, structured_addresses

#: Own pages, one thing each.
TWO_OFFICES = """<body><footer><footer class="inner"><address>14 Mill Lane, Suite 3<br>Dover, DE 19901<br>United States</address></footer>
<address>250 Quarry Street, Floor 2<br>Salem, OR 97301<br>United States</address></footer><p>Open 9 to 5</p></body>"""
ONE_LINE = "<body><h2>Find us</h2><p>Call before you come, we are often away.</p><p>Unit 6, 81 Castle Road, Cardiff, United Kingdom</p></body>"
PLAIN = "<body><p>We deliver to Norway, Sweden and Denmark.</p><p>France</p><p>News, Prices, Team, Join</p></body>"
JSON_LD = """<body><script type='application/LD+JSON'>[{"@type":"LocalBusiness","name":"Quarry Bakery","telephone":"+46 8 508 290",
"address":{"@type":"PostalAddress","streetAddress":"Storgatan 12","addressLocality":"Umeå","postalCode":"903 26","addressCountry":{"name":"Sweden"}}}]</script></body>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://s{i}.org/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_pages(spark):
    got = {}
    for r in extract_addresses(pages(spark, TWO_OFFICES, ONE_LINE, PLAIN)).orderBy("page_id", "ord").collect():
        got.setdefault(r.page_id, []).append(r.address)
    assert sorted(got[0]) == ["14 Mill Lane, Suite 3, Dover, DE 19901, United States", "250 Quarry Street, Floor 2, Salem, OR 97301, United States"]
    assert got[1] == ["Unit 6, 81 Castle Road, Cardiff, United Kingdom"]
    assert 2 not in got


def test_structured_data(spark):
    p = pages(spark, JSON_LD)
    assert [r.address for r in structured_addresses(p).collect()] == ["Storgatan 12, Umeå, 903 26 Sweden"]
    c = extract_company(p).first()
    assert (c.name, c.telephone) == ("Quarry Bakery", "+46 8 508 290")


def test_deep_lists_and_graphs(spark):
    node = '{"@type":"LocalBusiness","name":"Deep"}'
    for _ in range(6):
        node = f"[{node}]"
    assert extract_company(pages(spark, f'<script type="application/ld+json">{{"@graph":{node}}}</script>')).first().name == "Deep"


def test_containers_are_innermost(spark):
    rows = page_containers(pages(spark, TWO_OFFICES)).filter("kind = 'container'").collect()
    assert sorted(r.lines[0] for r in rows) == ["14 Mill Lane, Suite 3", "250 Quarry Street, Floor 2"]


def test_countries(spark):
    cases = {"PK": ("Pakistan", True), "uk": ("United Kingdom", True), "Pakistan.": ("Pakistan.", True), "Springfield": ("Springfield", False), " U.S.A. ": ("United States", False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", country_name(F.col("t")).alias("n"), is_country_only(F.col("t")).alias("o")).collect():
        assert (r.n, r.o) == cases[r.t]


def test_clean_is_idempotent(spark):
    raws = ["Address: 12 High St.,, Leeds | UK", "Our Head Office - 5 Mall Road • Lahore.", "- Office 4, 2nd Floor ;", "12 Main Street,, , Springfield"]
    df = spark.createDataFrame([(r,) for r in raws], "t string").select(clean_address(F.col("t")).alias("a"))
    assert df.filter(clean_address(F.col("a")) != F.col("a")).count() == 0


def test_finalize_drops_contained_and_equal(spark):
    xs = ["12 Main Street, Springfield", "12 Main Street, Springfield, IL 62704", "12 main street, Springfield IL 62704", "Pakistan", "9 Elm Road, Leeds"]
    df = spark.createDataFrame([(xs,), (xs[::-1],)], "xs array<string>").select(finalize_addresses(F.col("xs")).alias("f"))
    for r in df.collect():
        assert [x.lower().replace(",", "") for x in r.f] == ["12 main street springfield il 62704", "9 elm road leeds"]
