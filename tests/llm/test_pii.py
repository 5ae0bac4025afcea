import datetime
import re

from pagequarry.llm import pii, queries

from .conftest import ODD

KEY = "test key"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(value):
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def replaced(spark, values):
    df = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(values)], "doc_id long, text string")
    rows = sorted(pii.pseudonymize(df, KEY).collect(), key=lambda r: r.doc_id)
    return [(r.text[4:-6], [tuple(f) for f in r.pii]) for r in rows]


def shape(text):
    return re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text)))


VALID = {
    "email": ["jane.doe42@mail.example.com", "x@y.org", "A_b-9@sub.host-1.net"],
    "card": ["4041894974608795", "4111 1111 1111 1111", "3782-822463-10005"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ssn": ["078-05-1120", "899-99-9999", "001-01-0001", "667-01-0001"],
    "phone": ["+1 (988) 555-2485", "+44 20 7123 4567", "(212) 555-0187"],
}


def test_formats_and_validity(spark):
    for kind, values in VALID.items():
        for value, (new, found) in zip(values, replaced(spark, values)):
            assert [f[0] for f in found] == [kind] and new != value and found[0][1] == new, (value, new)
            assert shape(new) == shape(value)
            digits = re.sub(r"\D", "", new)
            if kind == "card":
                assert luhn(digits)
            if kind == "iban":
                assert iban_ok(new) and new[:2] == value[:2]
            if kind == "email":
                assert new.split("@")[1] == value.split("@")[1]
            if kind == "ssn":
                assert digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def test_dates_and_addresses(spark):
    for value, (new, found) in zip(["1987-06-05", "29.02.2000", "31/12/1999"], replaced(spark, ["1987-06-05", "29.02.2000", "31/12/1999"])):
        assert [f[0] for f in found] == ["date"] and shape(new) == shape(value)
        datetime.datetime.strptime(new, {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%d/%m/%Y"}[re.search(r"\D", value)[0]])
    ((new, found),) = replaced(spark, ["161.17.88.162"])
    assert found[0][0] == "ip" and all(0 <= int(x) < 256 for x in new.split(".")) and len(new.split(".")) == 4
    assert [len(f) for _, f in replaced(spark, ["30.02.2001", "4041894974608796", "DE89370400440532013001", "1.2.3", "999.1.1.1", "000-12-1234", "4.0."])] == [0] * 7


def test_permutations(spark):
    cards = [c + str(next(d for d in range(10) if luhn(c + str(d)))) for c in (f"40{i:013d}" for i in range(400))]
    new = [n for n, _ in replaced(spark, cards)]
    assert len(set(new)) == len(cards) and all(map(luhn, new))
    days = [(datetime.date(1950, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(700)]
    assert len({n for n, _ in replaced(spark, days)}) == len(days)
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(600)]
    assert len({n for n, _ in replaced(spark, ips)}) == len(ips)


def test_links_and_surroundings(spark, docs_of):
    a, b = "call +1 (988) 555-2485 190.137.223.204 x", "4041894974608795 4041 8949 7460 8795,me@a.com;me@a.com"
    out = {r.doc_id: r for r in pii.pseudonymize(docs_of([(1, a), (2, b), (3, a)]), KEY).collect()}
    assert out[1].text == out[3].text and [f.kind for f in out[1].pii] == ["phone", "ip"]
    assert out[1].text.startswith("call +1 (") and out[1].text.endswith(" x")
    first, second, m1, m2 = out[2].pii
    assert first.pseudonym == second.pseudonym.replace(" ", "") and m1 == m2
    other = pii.pseudonymize(docs_of([(1, a)]), "another key").first()
    assert other.text != out[1].text


def test_nothing_private_stays(spark, sf, texts):
    out = {r.doc_id: r for r in queries.op9_pseudonyms(spark, sf).collect()}
    found = 0
    for d, t in texts:
        private = re.findall(r"[\w.]+@[\w.-]+\.\w+|(?<!\S)\d{16}(?!\S)|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\S)(?:\d{1,3}\.){3}\d{1,3}(?!\S)", t)
        private = [p for p in private if not p.isdigit() or luhn(p)]
        found += len(private)
        assert not any(p in out[d].text for p in private)
        if not re.search(r"[0-9@]", t):
            assert out[d].text == t
        assert len(out[d].text) == len(t) or out[d].n_ip
    assert found > 5


def test_odd_rows(docs_of):
    df = docs_of(ODD).withColumnRenamed("lang", "pii")
    rows = pii.pseudonymize(df, KEY).collect()
    assert sorted((r.text is None, r.text or "") for r in rows) == sorted((t is None, t or "") for _, t in ODD)
    assert pii.pseudonymize(docs_of([]), KEY, found=None).columns == docs_of([]).columns
