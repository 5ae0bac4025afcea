from pyspark.sql import functions as F

from pagequarry.operators import emails

#: Own cases: pictures and files, placeholder addresses, tracker ids, numeric domains, shared boxes, people.
CASES = {
    "hero-image@2x.jpeg": None, "thumb@1x.gif": None, "bundle@4.js": None, "someone@123.456": None, "0f9e8d7c6b5a4f3e2d1c@sentry.io": None,
    "billing@quietharbour.dk": "role", "press@north-mill.se": "role", "maria.lund@quietharbour.dk": "personal", "k.berg@north-mill.se": "personal",
}


def test_usable_and_kind(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "email string")
    assert {r.email: r.kind for r in emails.normalize_emails(df).collect()} == CASES


def test_repair(spark):
    df = spark.createDataFrame([("desk@harbor.net.Newsletter",), ("q@quay.photography",), ("ops@pier.info.org.Read.More",)], "email string")
    got = [r.normalized for r in emails.normalize_emails(df).collect()]
    assert got == ["desk@harbor.net", "q@quay.photography", "ops@pier.info.org"]


def test_page_forms(spark):
    html = (
        '<a href="mailto:Jo%2Bx@Firm.org,second@firm.org?subject=a">m</a><p>ann [at] firm (dot) org and bob{at}firm.org</p>'
        '<p>kim&#64;firm.org</p><script>var x = "noise [at] script [dot] com"</script><img src="logo@2x.png">'
    )
    pages = spark.createDataFrame([(1, "https://firm.org/", html)], "page_id long, url string, html string")
    hits = {r.email: r.via_mailto for r in emails.find_page_emails(pages).collect()}
    # the plain scan sees the undecoded link text as well
    assert hits == {"jo+x@firm.org": True, "second@firm.org": True, "ann@firm.org": False, "kim@firm.org": False, "jo%2bx@firm.org": False}
    plain = {r.email for r in emails.extract_emails(pages).collect()}
    assert {"ann@firm.org", "noise@script.com"} <= plain


def test_adjacent_matches_survive(spark):
    df = spark.createDataFrame([(1, "a@b.com-c@d.com x.y@z.org,q@w.net.")], "k int, text string")
    assert {r.email for r in emails.text_emails(df).collect()} == {"a@b.com", "-c@d.com", "x.y@z.org", "q@w.net"}


def test_scores(spark):
    rows = [
        ("www.firm.org", "sales@firm.org", "u1", 0, True, True), ("www.firm.org", "sales@firm.org", "u2", 1, False, False),
        ("www.firm.org", "joe1234@gmail.com", "u2", 1, False, False),
    ]
    df = spark.createDataFrame(rows, "domain string, email string, url string, ord int, via_mailto boolean, on_contact_page boolean")
    got = {r.email: (r.score, r.confidence, r.sources) for r in emails.score_emails(df).collect()}
    assert got == {"sales@firm.org": (99, "high", ["u1", "u2"]), "joe1234@gmail.com": (17, "low", ["u2"])}
