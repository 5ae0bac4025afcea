"""Country codes and names, built from the platform's own locale data (one rule, no table)."""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from string import ascii_uppercase

from pyspark.sql import SparkSession

from . import fixed_values as fv


@lru_cache(maxsize=1)
def region_names() -> dict[str, str]:
    """Two-letter region code -> English name, for every pair of letters that names a region."""
    locale = SparkSession.active()._jvm.java.util.Locale
    names = {}
    for a, b in product(ascii_uppercase, repeat=2):
        code = a + b
        name = locale("", code).getDisplayCountry(locale.ENGLISH)
        if name and name != code and code != "ZZ":
            names[code] = name
    return names


@lru_cache(maxsize=1)
def country_names() -> list[str]:
    """Every country name and alias target, in lower case."""
    return sorted({n.lower() for n in [*region_names().values(), *fv.COUNTRY_ALIASES.values()]})


def country_codes() -> list[str]:
    """Codes and aliases of two or three letters, in upper case."""
    return sorted({*region_names(), *(a for a in fv.COUNTRY_ALIASES if a.isalpha() and len(a) <= 3)})
