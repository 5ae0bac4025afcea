import pytest
from pyspark.sql import functions as F

from pagequarry.operators import verify


def osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def test_edit_distance(spark):
    words = ["gmial.com", "gmail.com", "ca", "abc", "abcd", "badc", "kitten", "sitting", "a", "yaho.co.uk"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", verify.edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == osa(r.a, r.b), (r.a, r.b)


SESSIONS = [
    ("ok@acme.org", 250, 250, 550, None), ("sales@acme.org", 250, 250, 550, None), ("joe@gmail.com", 250, 250, 550, None), ("rej@acme.org", 250, 550, None, None),
    ("grey@acme.org", 250, 451, None, None), ("refused@acme.org", None, None, None, "ECONNREFUSED"), ("catch@acme.org", 250, 250, 250, None),
    ("joe@gmial.com", None, None, None, "ETIMEDOUT"), ("t@mailinator.com", 250, 250, 550, None),
]
WANT = {
    "ok@acme.org": ("valid", 92), "sales@acme.org": ("risky", 80), "joe@gmail.com": ("valid", 90), "rej@acme.org": ("invalid", 4), "grey@acme.org": ("unknown", 63),
    "refused@acme.org": ("unknown", 67), "catch@acme.org": ("risky", 60), "joe@gmial.com": ("risky", 40), "t@mailinator.com": ("risky", 12), "x@nomx.org": ("invalid", 2),
    "a@arec.org": ("unknown", 67), "e@err.org": ("invalid", 2), "a b@x.com": ("invalid", 0), "a@@b.com": ("invalid", 0), ".a@b.com": ("invalid", 0),
    "a..b@c.com": ("invalid", 0), "joe@acme.con": ("invalid", 0), "t@x.yopmail.com": ("invalid", 2),
}


@pytest.fixture(scope="module")
def verified(spark):
    e = spark.createDataFrame([(f" {k.upper()} ",) for k in WANT], "email string")
    mx = spark.createDataFrame([("acme.org", 20, "b.acme.org."), ("acme.org", 10, "a.acme.org."), ("gmail.com", 5, "g"), ("mailinator.com", 1, "m"), ("gmial.com", 1, "z")], "domain string, priority int, exchange string")
    a = spark.createDataFrame([("arec.org", "1.1.1.1"), ("err.org", "1.1.1.1")], "domain string, ip string")
    d = spark.createDataFrame([("err.org", "ESERVFAIL"), ("arec.org", "ENODATA")], "domain string, code string")
    s = spark.createDataFrame([(m, x, None, x, r, c, err, "reply\nmore") for m, x, r, c, err in SESSIONS],
                              "email string, ehlo int, helo int, mail_from int, rcpt int, control int, err string, text string")
    return {r.email: r for r in verify.verify_emails(e, mx, a, d, s).collect()}


def test_scores(verified):
    assert {k: (r.verdict, r.score) for k, r in verified.items()} == WANT


def test_hosts_and_checks(verified):
    assert verified["ok@acme.org"].mx_hosts == ["a.acme.org", "b.acme.org"]
    assert verified["a@arec.org"].mx_hosts == ["arec.org"]
    assert verified["e@err.org"].mx_error == "DNS lookup failed (ESERVFAIL)."
    assert [c.status for c in verified["ok@acme.org"].checks] == ["Valid", "Professional", "Valid", "Valid"]
    assert [c.status for c in verified["joe@gmial.com"].checks] == ["Possible typo", "Professional", "Valid", "Unknown"]
    assert verified["joe@acme.con"].suggestion == "joe@acme.com"
    assert verified["joe@gmial.com"].suggestion == "joe@gmail.com"


def test_skewed_domains_keep_every_row(spark):
    rows = spark.range(5000).select(F.concat(F.lit("u"), "id", F.lit("@big.org")).alias("email"), F.lit("big.org").alias("domain"))
    facts = spark.createDataFrame([("big.org", 1), ("small.org", 2)], "domain string, x int")
    joined = verify.join_domain_facts(rows, facts, "email")
    assert joined.count() == 5000 and joined.filter("x = 1").count() == 5000


def test_suggestions_from_a_table_are_brute_force(spark):
    import random

    rng = random.Random(8)
    targets = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 24))) for _ in range(120)] + ["a-common-prefix-of-many" + c for c in "wxyz"]

    def edited(t):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            t = rng.choice([t[:i] + rng.choice("abc") + t[i:], t[:i] + t[i + 1:], t[:i] + t[i + 1:i + 2] + t[i:i + 1] + t[i + 2:], t[:max(0, i - 1)] + "b" + t[i:]])
        return t

    asked = [edited(rng.choice(targets)) for _ in range(300)]
    domains = spark.createDataFrame([(x,) for x in [*asked, *asked[:50], "", None, "zzzzzzzzz"]], "domain string")
    table = spark.createDataFrame([(x,) for x in [*targets, *targets[:9], "", None]], "target string")
    for radius in (1, 2):
        want = {}
        for a in set(asked) - set(targets) - {""}:
            best = min((osa(a, t), t) for t in targets)
            if best[0] <= radius:
                want[a] = best
        for prefix in (radius + 1, 16):
            got = {r.domain: (r.distance, r.suggestion) for r in verify.suggest_from_table(domains, table, radius, prefix).collect()}
            assert len(want) > 20 and got == want
    assert verify.suggest_from_table(domains, table.where("1 = 0")).count() == 0
