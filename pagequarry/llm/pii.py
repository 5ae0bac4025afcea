"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Validated values are replaced by others of the same format.  Strings of digits (and the letters of mail names) go through
a Feistel network that moves every character within its class; numbers with a structure (IPv4 addresses, dates, social
security numbers) are ranked, permuted within all valid ranks and written back.  Check digits (card, IBAN) are computed
anew.  All are permutations under one key, so equal values get equal pseudonyms in every document, different ones stay
different, and punctuation, lengths and validity stay.

Kinds: ``email`` (name permuted, domain kept), ``iban`` (mod 97), ``ip``, ``date`` (1900 to 2100; year-month-day or
day-month-year), ``ssn``, ``phone`` (country code kept), ``card`` (Luhn).  What fails its validation stays as it is.

Edge cases: null texts stay null; texts without digits and without ``@`` pass unread by the patterns; repeated values and
adjacent values are replaced one by one; whole texts of any length are read; other columns are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

#: Kinds with the pattern of their candidates, in the order of precedence at one position.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([/.])(?:0[1-9]|1[0-2])\1(?:19|20)\d\d)(?![\w/-])",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|\+(?!1[ .(-])\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:[ -]\d{2,4}){2,4}(?!\w|\.\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\w))",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![\w-]|\.\d)",
}
CANDIDATE = "|".join(PATTERNS.values())
ROUNDS = 8
#: Days from 1900-01-01 that dates are permuted in (270 * 271: up to 2100-05-02).
_DATE_SIDES = (270, 271)
#: 898 areas * 99 groups, and 9,999 serials.
_SSN_SIDES = (898 * 99, 9_999)


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """512 keyed bits in hex."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts)).cast("binary"), 512)


def _moved(text: Column, bits: Column) -> Column:
    """Every digit and letter moved within its class by its own share of ``bits``."""

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(bits, i * 4 % 128 + 1, F.lit(4)), 16, 10).cast("int")

        def within(first: str, size: int) -> Column:
            return F.chr(ord(first) + (F.ascii(c) - ord(first) + step) % size)

        return F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permute_string(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the same character classes at the same places."""
    half = F.floor(F.length(text) / 2).cast("int")
    sides = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), sides,
        lambda s, r: F.struct(s["b"].alias("a"), let(_keyed(key, kind, r, s["b"]), lambda bits: F.when(s["a"] == "", s["a"]).otherwise(_moved(s["a"], bits))).alias("b")),
    )
    return F.concat(done["a"], done["b"])


def permute_number(a: Column, b: Column, sides: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of the pairs below ``sides``, as a struct ``a, b``."""

    def step(value: Column, other: Column, r: Column, size: int) -> Column:
        return (value + F.conv(F.substring(_keyed(key, kind, r, other), 1, 12), 16, 10).cast("long")) % size

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, r: F.when(r % 2 == 1, F.struct(step(s["a"], s["b"], r, sides[0]).alias("a"), s["b"].alias("b")))
        .otherwise(F.struct(s["a"].alias("a"), step(s["b"], s["a"], r, sides[1]).alias("b"))),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _refilled(value: Column, pattern: str, filling: Column) -> Column:
    """``value`` with the characters that match ``pattern`` replaced, in turn, by those of ``filling``."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c.rlike(pattern),
        F.substring(filling, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), f"(?!{pattern}).", "")), F.lit(1)),
    ).otherwise(c)), "")


def _luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """The Luhn sum; ``doubled_first`` says whether the first digit is doubled."""
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: let(
            c.cast("int") * F.when((i % 2 == 0) == doubled_first, F.lit(2)).otherwise(F.lit(1)), lambda d: d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0)),
        )), F.lit(0), lambda s, d: s + d,
    )


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, F.length(digits) % 2 == 0) % 10 == 0


def _mod97(alphanumerics: Column) -> Column:
    return F.aggregate(F.split(alphanumerics, ""), F.lit(0), lambda s, c: F.when(
        c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _card(value: Column, key: str) -> Column:
    def renewed(digits: Column) -> Column:
        body = permute_string(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        full = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, F.length(b) % 2 == 1) % 10) % 10).cast("string")))
        return let(full, lambda f: _refilled(value, "[0-9]", f))

    return let(_digits(value), lambda d: F.when(luhn_valid(d), renewed(d)).otherwise(value))


def _iban(value: Column, key: str) -> Column:
    def renewed(v: Column) -> Column:
        country = F.substring(v, 1, 2)
        body = permute_string(F.substring(v, F.lit(5), F.length(v)), key, "iban")
        full = let(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return let(full, lambda f: _refilled(value, "[A-Z0-9]", f))

    compact = F.replace(value, F.lit(" "), F.lit(""))
    return let(compact, lambda v: F.when(_mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1, renewed(v)).otherwise(value))


def _ip(value: Column, key: str) -> Column:
    def renewed(o: Column) -> Column:
        pair = permute_number(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), (65_536, 65_536), key, "ip")
        return let(pair, lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))

    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), renewed)


def _date(value: Column, key: str) -> Column:
    iso = value.rlike(r"^\d{4}")
    separator = F.substring(value, 3, 1)
    text = F.when(iso, value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    rank = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))

    def written(p: Column) -> Column:
        day = F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * _DATE_SIDES[1] + p["b"]).cast("int"))
        return let(F.date_format(day, "yyyy-MM-dd"), lambda d: F.when(iso, d).otherwise(
            F.concat(F.substring(d, 9, 2), separator, F.substring(d, 6, 2), separator, F.substring(d, 1, 4))))

    return let(rank, lambda n: F.when(n.isNull(), value).otherwise(
        let(permute_number(F.floor(n / _DATE_SIDES[1]), n % _DATE_SIDES[1], _DATE_SIDES, key, "date"), written)))


def _ssn(value: Column, key: str) -> Column:
    area = F.substring(value, 1, 3).cast("int")
    place = (area - 1 - F.when(area > 666, F.lit(1)).otherwise(F.lit(0))) * 99 + F.substring(value, 5, 2).cast("int") - 1

    def written(p: Column) -> Column:
        at = F.floor(p["a"] / 99).cast("int") + 1
        return F.concat_ws(
            "-", F.lpad((at + F.when(at >= 666, F.lit(1)).otherwise(F.lit(0))).cast("string"), 3, "0"),
            F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"),
        )

    return let(permute_number(place, F.substring(value, 8, 4).cast("int") - 1, _SSN_SIDES, key, "ssn"), written)


def _phone(value: Column, key: str) -> Column:
    code = F.regexp_extract(value, r"^(\+\d{1,3})", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, let(rest, lambda v: let(permute_string(_digits(v), key, "phone"), lambda f: _refilled(v, "[0-9]", f))))


def _email(value: Column, key: str) -> Column:
    return F.concat(permute_string(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1))


def kind_of(value: Column) -> Column:
    """The kind of a candidate, by its shape."""
    return (
        F.when(value.contains("@"), "email").when(value.rlike("^[A-Z]"), "iban").when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(value.rlike(r"^(\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4})$"), "date").when(value.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
        .when(value.rlike(r"^[+(]"), "phone").otherwise("card")
    )


def pseudonym(value: Column, key: str) -> Column:
    """The replacement of a candidate (itself where it is not valid)."""
    return let(kind_of(value), lambda kind: (
        F.when(kind == "email", _email(value, key)).when(kind == "iban", _iban(value, key)).when(kind == "ip", _ip(value, key))
        .when(kind == "date", _date(value, key)).when(kind == "ssn", _ssn(value, key)).when(kind == "phone", _phone(value, key))
        .otherwise(_card(value, key))
    ))


def pseudonymize(df: DataFrame, key: str, text: str = "text", found: str | None = "pii") -> DataFrame:
    """``df`` with the column ``text`` pseudonymised in place and, unless ``found`` is None, a column of that name:
    ``array<struct<kind, pseudonym>>`` of the values that were replaced, in text order."""
    source = F.col(f"`{text}`")
    candidates = F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    replaced = F.transform(candidates, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"), pseudonym(v, key).alias("pseudonym")))
    marked = df.withColumn("__found", replaced)
    rebuilt = F.when(F.size("__found") > 0, F.array_join(F.transform(
        F.split(source, CANDIDATE, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("__found"), i)["pseudonym"], F.lit(""))),
    ), "")).otherwise(source)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (text, found)]
    order = [rebuilt.alias(text) if c == text else F.col(f"`{c}`") for c in df.columns if c != found]
    out = marked.select(*order, "__found") if text in df.columns else marked.select(*kept, "__found")
    if found is None:
        return out.drop("__found")
    valid = F.filter("__found", lambda f: f["value"] != f["pseudonym"])
    return out.withColumn(found, F.transform(valid, lambda f: F.struct(f["kind"].alias("kind"), f["pseudonym"].alias("pseudonym")))).drop("__found")
