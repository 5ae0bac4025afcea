"""Phone numbers of pages and texts, and their de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import lines_of, markup, script_bodies, visible_text
from ..functions.phones import declared_numbers, phone_steps, scan_lines, validate_phones
from ..functions.text import each
from .page_facts import with_domain

__all__ = ["extract_phones", "text_phones", "dedupe_phones", "validate_phones"]


def _accepted(values: Column, trusted: bool) -> Column:
    """Candidates to array of struct(display, digits, trusted), rejects dropped."""
    parsed = F.filter(each(values, *phone_steps(F.lit(trusted))), lambda p: p["reject"].isNull())
    return F.transform(
        parsed, lambda p: F.struct(p["display"].alias("display"), p["digits"].alias("digits"), F.lit(trusted).alias("trusted"))
    )


def _exploded(df: DataFrame, keys: list[str], numbers: Column) -> DataFrame:
    rows = df.select(*keys, F.posexplode(numbers).alias("ord", "p"))
    return rows.select(*keys, "ord", "p.display", "p.digits", "p.trusted")


def extract_phones(pages: DataFrame) -> DataFrame:
    """Accepted numbers per page in page order: declared ones first, then those in visible lines.

    The markup stays in the row until the candidates are found; only the short candidates are
    exploded, so nothing but numbers travels further.
    """
    p = with_domain(pages)
    keys = [c for c in p.columns if c not in ("html", "content_type", "headers")]
    p = p.select(
        *keys, declared_numbers(markup(F.col("html")), script_bodies(F.col("html"))).alias("declared"),
        lines_of(visible_text(F.col("html"))).alias("lines"),
    )
    return _exploded(p, keys, F.concat(_accepted(F.col("declared"), True), _accepted(scan_lines(F.col("lines")), False)))


def text_phones(df: DataFrame, column: str = "text") -> DataFrame:
    """Accepted numbers of a plain text column, line by line."""
    keys = [c for c in df.columns if c != column]
    return _exploded(df, keys, _accepted(scan_lines(F.split(F.col(column), "\n")), False))


def dedupe_phones(mentions: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Best form per number, and no national number that is the tail of a longer one.

    ``by`` is the scope (a site, or a page).  Both steps are keyed by scope *and* digits: the
    best form is a partial aggregate, and the tail rule groups each number with the numbers that
    cover it by the five possible suffixes, instead of comparing all pairs of a site.
    """
    by = by or ["domain"]
    order = order or [c for c in ("page_ord", "page_id", "ord") if c in mentions.columns]
    score = (
        F.when(F.col("trusted"), 100).otherwise(0) + F.length("digits")
        + F.when(F.startswith("display", F.lit("+")), 5).otherwise(0)
    )
    best = mentions.groupBy(*by, "digits").agg(
        F.min_by("display", F.struct(-score, *order)).alias("display"),
    )
    core = F.ltrim("digits", F.lit("0"))
    # one row for the number itself and one per suffix it covers, k leading digits shorter
    suffix = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda k: F.struct(core.substr(k + 1, F.length(core)).alias("core"), F.length("digits").alias("longer")),
    )
    itself = F.struct(core.alias("core"), F.lit(None).cast("int").alias("longer"))
    rows = best.select(
        *by, F.struct("digits", "display").alias("number"), F.explode(F.concat(F.array(itself), suffix)).alias("r")
    ).filter(F.col("r.longer").isNull() | (F.length("r.core") >= 8))
    # a core has at most a few spellings (leading zeros), so the list per key stays short
    grouped = rows.groupBy(*by, "r.core").agg(
        F.max("r.longer").alias("longer"),
        F.collect_list(F.when(F.col("r.longer").isNull(), F.col("number"))).alias("numbers"),
    )
    kept = grouped.select(*by, "longer", F.explode("numbers").alias("n")).select(*by, "longer", "n.digits", "n.display")
    return kept.filter(F.col("longer").isNull() | (F.col("longer") <= F.length("digits"))).select(*by, "digits", "display")
