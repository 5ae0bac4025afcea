"""Phone rules: own cases for each rule, and scans with their expected numbers written out."""

from pyspark.sql import functions as F

from pagequarry.operators import phones

#: The first rule that an untrusted number breaks, in the order in which rules are asked.
OBJECTIONS = {
    "no digits": ["()", "+", "call the desk"],
    "characters": ["206/555/0148", "212*555*0142", "[206] 555 0148"],
    "parentheses": ["(20) (45) 881002", "( ) 5558674"],
    "dotted": ["10.200.30.41", "01.44.27.00", "+44.20.7946.0.11", "2.50"],
    "date": ["2019-07-04 12", "1987 2003 44", "7-11-24"],
    "groups": ["1 2 345 678 90 12", "11-22-33-44-55"],
    "group length": ["123456789012", "55 123456789012"],
    "tax id": ["47-8123456", "12 345678"],
    "thousands": ["9 876 543", "45-600-700"],
    "length": ["44-5561", "+4420794", "1234 5678 9012 3456"],
    "bare run": ["44556677", "0423456780", "25556667778"],
    "repeated": ["444-444-4444", "+5555 5555"],
    "sequential": ["234-567-89", "(987) 654-3210"],
    "repeated run": ["211-111-1113"],
    "zeros": ["000-415-7762"],
    "country code": ["+0 415 776 2301"],
}
ACCEPTED = {
    "2065550148": "2065550148", "10235550148": "10235550148", "206.555.0148": "206-555-0148", "+45.3392.3311": "+45-3392-3311",
    "(030) 9018-2233": "(030) 9018-2233", "+31 20 624 1111": "+31 20 624 1111", "+358 9 160 2211 x12": "+358 9 160 2211 ext. 12",
    "206\u2013555\u20130148": "206-555-0148", "206 555 0148 #9": "206 555 0148 ext. 9",
}


def test_validator_cases(spark):
    raws = [*(raw for rule in OBJECTIONS.values() for raw in rule), *ACCEPTED]
    df = spark.createDataFrame([(r, False) for r in raws] + [("44556677", True)], "raw string, trusted boolean")
    got = {(r.raw, r.trusted): (r.display, r.reject) for r in phones.validate_phones(df).collect()}
    assert {raw: got[raw, False][1] for rule in OBJECTIONS.values() for raw in rule} == {raw: rule for rule, raws in OBJECTIONS.items() for raw in raws}
    assert {raw: got[raw, False][0] for raw in ACCEPTED} == ACCEPTED
    assert got["44556677", True] == ("44556677", None)


def test_display_is_stable(spark):
    df = spark.createDataFrame([(v, False) for v in ACCEPTED.values()], "raw string, trusted boolean")
    assert all(r.display == r.raw for r in phones.validate_phones(df).collect())


def test_scan_of_texts(spark):
    """Numbers in running text: two on a line, at the ends, next to words, in brackets, none."""
    texts = {
        1: "617-253-1000 or (617) 253-2000.", 2: "ring +49 30 901820 today\nfax: 02071838750", 3: "no number here, only 42 and 2024-05-06", 4: "abc617-253-1000",
        5: "server 172.16.254.3 has 16 GB", 6: "", 7: "(see 617.253.1000)",
    }
    df = spark.createDataFrame([*texts.items()], "doc_id int, text string")
    got = {}
    for r in phones.text_phones(df).collect():
        got.setdefault(r.doc_id, set()).add(r.digits)
    assert got == {1: {"6172531000", "6172532000"}, 2: {"4930901820", "02071838750"}, 7: {"6172531000"}}


def test_scan_of_pages(spark):
    html = "<p>Front desk<br>617-253-1000</p><script>var n = '617-253-9999'</script><ul><li>(617) 253-2000</li><li>Order id 6172533000</li></ul>"
    pages = spark.createDataFrame([(1, "http://desk.test/", html)], "page_id long, url string, html string")
    assert {r.digits for r in phones.extract_phones(pages).filter("NOT trusted").collect()} == {"6172531000", "6172532000"}


def test_context_of_a_match(spark):
    lines = "Order id 8893214455\nWeight 5551234567 kg\nCost $5551234567\n555-123-4567 and 555-987-6543\nCall 555 123 4567, ext 12\n5551234567+ users"
    df = spark.createDataFrame([(1, lines)], "k int, text string")
    assert [r.display for r in phones.text_phones(df).orderBy("ord").collect()] == ["555-123-4567", "555-987-6543", "555 123 4567 ext. 12"]


def test_declared_numbers(spark):
    html = (
        '<a href="tel:%2B92%20300%201234567?x">x</a><a href="callto:555%20123%204567">y</a><span itemprop="telephone">(021) 34567890</span>'
        '<meta itemprop="faxNumber" content="+44 20 7123 4567"><script type="application/ld+json">{"telephone":"+92 21 34567890"}</script>'
    )
    pages = spark.createDataFrame([(1, "http://a.org", html)], "page_id long, url string, html string")
    got = [r.display for r in phones.extract_phones(pages).filter("trusted").orderBy("ord").collect()]
    assert got == ["+92 300 1234567", "555 123 4567", "(021) 34567890", "+44 20 7123 4567", "+92 21 34567890"]


MENTIONS = [
    ("a", "03001234567", "03001234567", False, 0), ("a", "+923001234567", "923001234567", False, 1), ("a", "300 1234567", "3001234567", False, 2),
    ("b", "0300 1234567", "03001234567", True, 1), ("b", "03001234567", "03001234567", False, 0), ("c", "1234567", "1234567", True, 0), ("c", "99 1234567", "991234567", True, 1),
]


def test_dedupe_and_partitioning(spark):
    df = spark.createDataFrame(MENTIONS, "domain string, display string, digits string, trusted boolean, ord int")
    want = {("a", "+923001234567"), ("b", "0300 1234567"), ("c", "1234567"), ("c", "99 1234567")}
    for parts in (1, 3, 7):
        got = phones.dedupe_phones(df.repartition(parts, F.rand(parts)))
        assert {(r.domain, r.display) for r in got.collect()} == want


def test_dedupe_matches_all_pairs(spark):
    import random

    rnd = random.Random(7)
    rows = []
    for site in "xyz":
        base = ["".join(rnd.choice("123456789") for _ in range(10)) for _ in range(12)]
        for b in base:
            rows += [(site, b, b), (site, "0" + b, "0" + b), (site, "+92" + b, "92" + b), (site, "12345" + b, "12345" + b)][: rnd.randint(1, 4)]
    df = spark.createDataFrame([(s, d, g, False, i) for i, (s, d, g) in enumerate(rows)], "domain string, display string, digits string, trusted boolean, ord int")
    want = set()
    for site in "xyz":
        digits = {g for s, _, g in rows if s == site}
        for p in digits:
            tail = p.lstrip("0")
            covered = len(tail) >= 8 and any(
                len(q) > len(p) and q.lstrip("0").endswith(tail) and len(q.lstrip("0")) - len(tail) <= 4 for q in digits if q != p)
            if not covered:
                want.add((site, p))
    assert {(r.domain, r.digits) for r in phones.dedupe_phones(df).collect()} == want
