"""Small Column builders shared by every operator.

Everything returns a Column built from built-in functions, safe under ANSI mode (``try_*``
where a cast or an index can miss).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: Column) -> Column:
    """Trim every Unicode white-space character, not only the blank."""
    return F.btrim(x, F.lit(fv.TRIM_CHARS))


def squeeze(x: Column) -> Column:
    """Each run of white space becomes one blank."""
    return F.regexp_replace(x, fv.SP + "+", " ")


def extract(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(x, pattern, group)


def extract_all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def drop_prefix(x: Column, n: Column | int) -> Column:
    """Characters after the first ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    return x.substr(n + F.lit(1), F.length(x))


def before_last(x: Column, sep: str) -> Column:
    """Text before the last ``sep`` ('' when there is none)."""
    return extract(x, r"(?s)\A(.*)" + sep, 1)


def after_last(x: Column, sep: str) -> Column:
    return F.substring_index(x, sep, -1)


def array_of(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(table: dict[str, str]) -> Column:
    """A constant map, written as one literal so that plans stay small."""
    text = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02"))


def quoted(words: Iterable[str]) -> str:
    """Alternation of literals."""
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in words)


def is_one_of(x: Column, words: Iterable[str]) -> Column:
    """Membership in a constant list, as one literal pattern."""
    return x.rlike(r"\A(?:" + quoted(words) + r")\z")


def contains_any(x: Column, words: Iterable[str]) -> Column:
    """True when ``x`` contains any of the given literals."""
    words = list(words)
    if len(words) > 4:
        return x.rlike(quoted(words))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def ends_with_any(x: Column, suffixes: Iterable[str]) -> Column:
    return x.rlike("(?:" + quoted(suffixes) + r")\z")


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def each(values: Column, *steps) -> Column:
    """Run an array through several steps, one after the other.

    A step may use its element many times at no cost.  The steps are consecutive ``transform``
    calls, not nested ones: plans with flat lambdas are analysed far faster than deep ones.
    """
    for step in steps:
        values = F.transform(values, step)
    return values


def let(value: Column, *steps) -> Column:
    """``each`` for a single value: evaluated once, used several times inside a step."""
    return F.get(each(F.array(value), *steps), F.lit(0))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def decode_entities(x: Column, names: dict[str, str] = fv.ENTITIES) -> Column:
    """HTML character references: numeric ones, and the named ones in ``names``."""
    table = literal_map(names)

    def piece(p: Column, i: Column) -> Column:
        code = F.coalesce(
            extract(p, r"\A#([0-9]{1,7});", 1).try_cast("bigint"),
            F.conv(blank_to_null(extract(p, r"\A#[xX]([0-9a-fA-F]{1,6});", 1)), 16, 10).try_cast("bigint"),
        )
        # one UTF-32 unit; references outside Unicode stay as written
        numeric = F.when(
            code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF),
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"),
        )
        named = F.try_element_at(table, extract(p, r"\A([A-Za-z][A-Za-z0-9]{1,31});", 1))
        value = F.when(p.startswith("#"), numeric).otherwise(named)
        return F.when(i == 0, p).otherwise(
            F.coalesce(F.concat(value, F.regexp_replace(p, r"\A[^;]*;", "")), F.concat(F.lit("&"), p))
        )

    return F.array_join(F.transform(F.split(x, "&"), piece), "")
