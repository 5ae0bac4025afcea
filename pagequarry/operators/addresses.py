"""Postal addresses of pages."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.addresses import (
    JOIN_STEPS, address_key, address_substance, clean_address, finalize_addresses, greedy_spans, has_address_word, mined, walked_back,
)
from ..functions.html import body_of, lines_of, marked, raw_attr, strip_tags, text_of_marked
from ..functions.text import blank_to_null, decode_entities, each, extract, squeeze, trim_ws
from ..session import materialize
from .page_facts import with_domain

__all__ = ["page_containers", "extract_addresses", "distinct_addresses"]

#: Length of the character runs that addresses are looked up by; a key has at least six letters.
GRAM = 6


@lru_cache(maxsize=1)
def _containers_udf():
    """Arrow-batched finder of the innermost hint elements: the one step that needs a tag stack.

    Built in one function so that it travels to the workers by value.
    """
    hint_words = tuple(fv.ADDRESS_HINT_WORDS)
    tag_rx = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    attr_rx = re.compile(r"\b(class|id|itemprop|itemtype)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
    void = set("area base br col embed hr img input link meta param source track wbr".split())
    paragraph_ends = dict.fromkeys("p div ul ol footer address section table form".split(), {"p"})
    closed_by = {
        **paragraph_ends, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    }

    def roles(tag: str, attributes: str) -> tuple[bool, bool]:
        """(is an address hint, is a postal-address scope)"""
        a: dict[str, str] = {}
        for name, *values in attr_rx.findall(attributes):
            a.setdefault(name.lower(), "".join(values))
        scope = "postaladdress" in a.get("itemtype", "").lower()
        css, ident = a.get("class", "").lower(), a.get("id", "").lower()
        hint = (
            scope or tag in ("address", "footer") or a.get("itemprop") in ("address", "streetAddress")
            or any(w in css for w in hint_words)
            or "address" in ident or "location" in ident or a.get("id") == "footer"
        )
        return hint, scope

    def containers(html: str) -> list[dict]:
        out, stack = [], []  # stack: [tag, inner start, hint, scope, has hint inside]

        def close(end: int) -> None:
            _, start, hint, scope, inner = stack.pop()
            if hint and not inner:
                out.append({"kind": "container", "inner": html[start:end]})
            if scope:
                out.append({"kind": "scope", "inner": html[start:end]})
            if stack and (hint or inner):
                stack[-1][4] = True

        for m in tag_rx.finditer(html):
            tag = m.group(2).lower()
            if m.group(1):
                if any(s[0] == tag for s in stack):
                    while stack[-1][0] != tag:
                        close(m.start())
                    close(m.start())
                continue
            hint, scope = roles(tag, m.group(3))
            if tag in void or m.group(3).endswith("/"):
                if hint and stack:
                    stack[-1][4] = True
                continue
            while stack and stack[-1][0] in closed_by.get(tag, ()):
                close(m.start())
            stack.append([tag, m.end(), hint, scope, False])
        while stack:
            close(len(html))
        return out

    def batch(html: pd.Series) -> pd.Series:
        return html.map(lambda h: containers(h) if h else [])

    # real types, not the strings that postponed annotations leave behind
    batch.__annotations__ = {"html": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "array<struct<kind:string,inner:string>>")


_HINT_GATE = r"(?i)<(?:address|footer)[\s/>]|postaladdress|itemprop|addr|location|contact-info|contact-detail|branch|office|footer"


def _container_column() -> Column:
    """Pages without any hint word skip the stack walk."""
    m = F.col("marked")
    return _containers_udf()(F.when(m.rlike(_HINT_GATE), m))


def page_containers(pages: DataFrame) -> DataFrame:
    """One row per innermost address container and postal-address scope of a page."""
    p = with_domain(pages).select("domain", "page_id", marked(F.col("html")).alias("marked"))
    p = p.select("domain", "page_id", F.posexplode(_container_column()).alias("c_id", "c"))
    return p.select("domain", "page_id", "c_id", "c.kind", lines_of(text_of_marked(F.col("c.inner"))).alias("lines"), F.col("c.inner").alias("markup"))


def _items(scope: Column) -> Column:
    """Raw values of the five postal itemprops of a scope: content attribute or text."""

    def value(prop: str) -> Column:
        pattern = (
            r"(?is)<([a-z][a-z0-9]*)(?=\s)(?=[^>]*\bitemprop\s*=\s*[\"']?" + prop + r"[\"'\s/>])[^>]*>(?:(.*?)</\1\s*>)?"
        )
        tag = extract(extract(scope, pattern, 0), r"(?s)\A<[^>]*>", 0)
        return F.coalesce(blank_to_null(raw_attr(tag, "content")), strip_tags(extract(scope, pattern, 2)))

    return F.array(*[value(p) for p in fv.ADDRESS_PARTS])


def _from_items(values: Column) -> Column:
    return F.struct(*[F.get(values, F.lit(i)).alias(p) for i, p in enumerate(fv.ADDRESS_PARTS)])


def extract_addresses(pages: DataFrame) -> DataFrame:
    """Addresses per page: postal scopes, innermost containers, and patterns over the visible lines.

    One projection per step, no shuffle; pages without a street or unit word and without a line
    that ends in a country fall through the cheap tests.
    """
    p = with_domain(pages)
    keys = [c for c in p.columns if c not in ("html", "content_type", "headers")]
    p = p.select(*keys, marked(F.col("html")).alias("marked"))
    p = p.select(*keys, _container_column().alias("boxes"), lines_of(text_of_marked(body_of(F.col("marked")))).alias("lines"))

    scopes = F.transform(F.filter("boxes", lambda c: c["kind"] == "scope"), lambda c: c["inner"])
    declared = each(
        scopes, _items, lambda vs: F.transform(vs, lambda v: trim_ws(squeeze(decode_entities(v)))), _from_items, *JOIN_STEPS
    )
    p = p.withColumn("declared", F.filter(declared, lambda x: x.isNotNull()))
    sized = F.transform(
        F.filter("boxes", lambda c: c["kind"] == "container"),
        lambda c, i: F.struct(F.length(strip_tags(c["inner"])).alias("n"), i.alias("i"), c["inner"].alias("inner")),
    )
    blocks = F.transform(F.array_sort(sized), lambda b: lines_of(text_of_marked(b["inner"])))
    p = p.withColumn("blocks", F.filter(blocks, lambda ls: F.size(ls) > 0)).drop("boxes")

    none = F.array().cast("array<string>")
    per_block = F.flatten(each(F.col("blocks"), lambda ls: F.concat(mined(ls), walked_back(ls))))
    page_mined = F.when(has_address_word(F.col("lines")), mined(F.col("lines"))).otherwise(none)
    p = p.withColumn("found", F.concat("declared", greedy_spans(F.col("blocks")), per_block, page_mined, walked_back(F.col("lines"))))
    return p.select(*keys, F.posexplode(finalize_addresses(F.col("found"))).alias("ord", "address"))


def distinct_addresses(lines: DataFrame, by: list[str], order: list[str], address: str = "address") -> DataFrame:
    """One row per address of a group: ``by`` columns and ``address``; the rules of ``finalize_addresses`` for groups of any size.

    Lines are cleaned, and those without the substance of an address (null too) go.  Of lines with equal keys the longest stays,
    the first by ``order`` among equally long ones.  An address whose key lies inside a longer key of its group goes.  Groups
    with null columns are groups.  Other columns are dropped.

    No pairs of a group are listed: an address is looked up by its rarest run of six characters, through an equi-join with the
    runs of the others, and compared with those only.  Runs are counted by group *and* run, so a group with a third of all rows
    is spread; the join carries at most one row per character of the distinct keys, which have a fixed greatest length.  Spark
    sizes exploded runs like the keys they come from, so the joins say that none of their sides is to be broadcast.
    """
    # generated, so that a line is cleaned once and where it lies: filters on the text are not pushed below a repartition
    cleaned = lines.select(F.struct(*by).alias("__by"), F.struct(*order).alias("__order"), F.explode(F.array(clean_address(F.col(address)))).alias("__text"))
    real = cleaned.where(address_substance(F.col("__text"))).withColumn("__key", address_key(F.col("__text")))
    keyed = real.groupBy("__by", "__key").agg(F.min_by("__text", F.struct(-F.length("__text"), "__order")).alias("__text"))
    keyed = materialize(keyed, "address-keys")

    starts = F.sequence(F.lit(1), F.greatest(F.length("__key") - (GRAM - 1), F.lit(1)))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring("__key", i, F.lit(GRAM))))
    grams = keyed.select("__by", "__key", F.explode(runs).alias("__gram"))
    counts = grams.groupBy("__by", "__gram").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # a key with a run of its own lies in no other one
    shared = grams.join(counts.hint("merge"), ["__by", "__gram"], "left").groupBy("__by", "__key").agg(
        F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram"), F.bool_or(F.col("__n").isNull()).alias("__own")
    )
    asked = shared.where(~F.col("__own")).select("__by", "__gram", F.col("__key").alias("__inner"))
    longer = (F.length("__key") > F.length("__inner")) & F.contains("__key", "__inner")
    inside = asked.hint("merge").join(grams, ["__by", "__gram"]).where(longer).select("__by", F.col("__inner").alias("__key")).distinct()
    kept = keyed.join(inside.hint("merge"), ["__by", "__key"], "left_anti")
    return kept.select("__by.*", F.col("__text").alias(address))
