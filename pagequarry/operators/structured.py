"""Structured data of pages: JSON-LD nodes, companies, products, job postings, addresses.

Nodes are VARIANT values inside the page row; everything is a projection, so a page with many
nodes costs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.addresses import address_line, present_parts, address_substance, finalize_addresses
from ..functions.html import script_bodies
from ..functions.phones import parse_phone
from ..functions.text import each, let, squeeze, trim_ws
from .page_facts import with_domain

__all__ = ["structured_data", "jsonld_nodes", "extract_company", "extract_products", "extract_jobs", "structured_addresses"]

def _sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}" if path.isidentifier() else f"$['{path}']", "variant")


def _list(v: Column) -> Column:
    """A VARIANT list as an array; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _members(v: Column) -> Column:
    """The items of a list, or the value itself as the only item."""
    return F.coalesce(_list(v), F.array(v))


def _string(v: Column) -> Column:
    """The value when it is a string, as written."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _text(v: Column) -> Column:
    """Strings (trimmed, not empty) and numbers as text; NULL for everything else."""
    kind, raw = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    # a whole number written as 1e3 or 5.0 prints without its fraction
    number = F.regexp_replace(raw, r"\A(-?\d+)\.0+\z", "$1")
    return F.when(kind == "STRING", F.nullif(trim_ws(raw), F.lit(""))).when(
        kind.rlike(r"\A(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), number
    )


def _expand(xs: Column) -> Column:
    """One level: items of lists and of @graph, the graph's items before the node that holds it."""

    def open_one(x: Column) -> Column:
        pending = lambda items: F.transform(items, lambda e: F.struct(e.alias("v"), F.lit(False).alias("done")))
        graph = F.coalesce(_list(_sub(x["v"], "@graph")), F.array().cast("array<variant>"))
        return (
            F.when(x["done"], F.array(x))
            .when(_list(x["v"]).isNotNull(), pending(_list(x["v"])))
            .otherwise(F.concat(pending(graph), F.array(F.struct(x["v"].alias("v"), F.lit(True).alias("done")))))
        )

    return F.flatten(F.transform(xs, open_one))


def _depth(body: Column) -> Column:
    """How many lists lie inside each other in a JSON text; brackets within strings do not count."""
    code = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r'"[^"]*+"', "")

    def step(s: Column, bracket: Column) -> Column:
        now = s["now"] + F.when(bracket == "[", 1).when(bracket == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(F.regexp_replace(code, r"[^\[\]]+", ""), ""), start, step)["most"]


def nodes_array(html: Column) -> Column:
    """Typed nodes of a page's JSON-LD in document order: array of struct(node, types).

    A page's lists are opened as many times as they lie inside each other, whatever that depth is.
    """
    bodies = script_bodies(html)
    parsed = F.filter(F.transform(bodies, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    pending = F.transform(parsed, lambda v: F.struct(v.alias("v"), F.lit(False).alias("done")))
    levels = F.sequence(F.lit(0), F.coalesce(F.array_max(F.transform(bodies, _depth)), F.lit(0)))
    xs = F.aggregate(levels, pending, lambda found, _: _expand(found))

    def typed(x: Column) -> Column:
        kinds = F.transform(_members(_sub(x["v"], "@type")), lambda t: F.lower(_string(t)))
        return F.struct(x["v"].alias("node"), F.filter(kinds, lambda t: t.isNotNull()).alias("types"), _sub(x["v"], "@type").isNotNull().alias("typed"))

    return F.filter(F.transform(F.filter(xs, lambda x: x["done"]), typed), lambda n: n["typed"])


def _is(n: Column, *types: str) -> Column:
    return F.arrays_overlap(n["types"], F.array(*[F.lit(t.lower()) for t in types]))


def _address_facts(a: Column) -> Column:
    country = _sub(a, "addressCountry")
    return F.struct(
        *[_text(_sub(a, p)).alias(p) for p in fv.ADDRESS_PARTS[:-1]],
        F.coalesce(_text(country), _text(_sub(country, "name")), _text(_sub(country, "identifier"))).alias("addressCountry"),
        trim_ws(squeeze(_string(a))).alias("plain"),
    )


# address VARIANT -> one line, as consecutive steps for ``each`` / ``let``
FORMAT_STEPS = (
    _address_facts,
    lambda f: F.struct(present_parts(f).alias("parts"), f["plain"].alias("plain")),
    lambda f: F.struct(address_line(f["parts"]).alias("joined"), f["plain"].alias("plain")),
    lambda f: F.coalesce(F.when(address_substance(f["plain"]), f["plain"]), F.when(F.length(f["joined"]) >= fv.ADDRESS_MIN, f["joined"])),
)


def _format_address(a: Column) -> Column:
    """A postal-address object or an address text as one line."""
    return let(a, *FORMAT_STEPS)


def _address_values(n: Column) -> Column:
    """Every value of a node that may hold an address."""
    node = n["node"]
    nested = [
        F.flatten(F.transform(_members(_sub(node, key)), lambda v: _members(_sub(v, "address"))))
        for key in ("location", "hasPos", "areaServed", "jobLocation", "branch")
    ]
    own = F.when(_is(n, "PostalAddress"), F.array(node)).otherwise(F.array().cast("array<variant>"))
    return F.concat(own, _members(_sub(node, "address")), *[F.coalesce(x, F.array().cast("array<variant>")) for x in nested])


def _company(n: Column) -> Column:
    node = n["node"]
    logo = _sub(node, "logo")
    same = _sub(node, "sameAs")
    same_as = F.filter(F.transform(_members(same), _string), lambda x: x.isNotNull())
    listed = _list(same).isNotNull() | (F.schema_of_variant(same) == "STRING")
    return F.struct(
        F.coalesce(_text(_sub(node, "name")), F.lit("")).alias("name"),
        _text(_sub(node, "legalName")).alias("legal_name"),
        _text(_sub(node, "url")).alias("url"),
        F.coalesce(_string(logo), _text(_sub(logo, "url"))).alias("logo"),
        _text(_sub(node, "email")).alias("email"),
        parse_phone(_text(_sub(node, "telephone")), F.lit(True))["display"].alias("telephone"),
        _format_address(_sub(node, "address")).alias("address"),
        F.when(listed, same_as).alias("same_as"),
        _text(_sub(node, "description")).alias("description"),
    )


def _product(page_url: Column):
    def build(n: Column) -> Column:
        node = n["node"]
        offer = F.get(_members(_sub(node, "offers")), F.lit(0))
        brand = _sub(node, "brand")
        return F.struct(
            _text(_sub(node, "name")).alias("name"),
            F.coalesce(_text(_sub(offer, "price")), _text(_sub(offer, "lowPrice"))).alias("price"),
            _text(_sub(offer, "priceCurrency")).alias("currency"),
            F.coalesce(_text(_sub(node, "sku")), _text(_sub(node, "mpn"))).alias("sku"),
            F.coalesce(_string(brand), _text(_sub(brand, "name"))).alias("brand"),
            _text(_sub(node, "category")).alias("category"),
            F.regexp_replace(_text(_sub(offer, "availability")), r"\Ahttps?://schema\.org/", "").alias("availability"),
            F.coalesce(_text(_sub(node, "url")), page_url).alias("url"),
        )

    return build


def _job(page_url: Column):
    def build(n: Column) -> Column:
        node = n["node"]
        org = _sub(node, "hiringOrganization")
        return F.struct(
            _text(_sub(node, "title")).alias("title"),
            F.coalesce(_string(org), _text(_sub(org, "name"))).alias("company"),
            _format_address(_sub(_sub(node, "jobLocation"), "address")).alias("location"),
            _text(_sub(node, "employmentType")).alias("employment_type"),
            _text(_sub(node, "datePosted")).alias("date_posted"),
            F.coalesce(_text(_sub(node, "url")), page_url).alias("url"),
        )

    return build


def _with_nodes(pages: DataFrame) -> DataFrame:
    """Pages that carry JSON-LD, with their nodes; the markup itself is dropped here."""
    p = with_domain(pages)
    keep = [c for c in p.columns if c not in ("html", "content_type", "headers")]
    p = p.filter(F.contains(F.lower("html"), F.lit("ld+json")))
    return p.select(*keep, nodes_array(F.col("html")).alias("nodes"))


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """One row per typed node: ``ord, types, node`` (VARIANT)."""
    p = _with_nodes(pages).select("domain", "page_id", F.posexplode("nodes").alias("ord", "n"))
    return p.select("domain", "page_id", "ord", "n.types", "n.node")


def _company_column() -> Column:
    """The first typed organisation decides; without a name there is no company."""
    firsts = F.slice(F.filter("nodes", lambda n: _is(n, "Organization", "LocalBusiness", "Corporation", "Store")), 1, 1)
    return F.get(F.filter(F.transform(firsts, _company), lambda c: c["name"] != ""), F.lit(0))


def _addresses_column() -> Column:
    values = F.flatten(F.transform("nodes", _address_values))
    lines = F.filter(each(values, *FORMAT_STEPS), lambda x: x.isNotNull())
    return finalize_addresses(lines)


def _items_column(type_name: str, build, required: str, per_page: int | None = None) -> Column:
    nodes = F.filter("nodes", lambda n: _is(n, type_name))
    items = F.transform(nodes if per_page is None else F.slice(nodes, 1, per_page), build(F.col("url")))
    return F.filter(items, lambda x: x[required].isNotNull())


def extract_company(pages: DataFrame) -> DataFrame:
    p = _with_nodes(pages).select("domain", "page_id", F.explode(F.array_compact(F.array(_company_column()))).alias("c"))
    return p.select("domain", "page_id", "c.*")


def extract_products(pages: DataFrame, per_page: int | None = None) -> DataFrame:
    items = _items_column("Product", _product, "name", per_page)
    p = _with_nodes(pages).select("domain", "page_id", F.posexplode(items).alias("ord", "i"))
    return p.select("domain", "page_id", "ord", "i.*")


def extract_jobs(pages: DataFrame, per_page: int | None = None) -> DataFrame:
    items = _items_column("JobPosting", _job, "title", per_page)
    p = _with_nodes(pages).select("domain", "page_id", F.posexplode(items).alias("ord", "i"))
    return p.select("domain", "page_id", "ord", "i.*")


def structured_addresses(pages: DataFrame) -> DataFrame:
    p = _with_nodes(pages).select("domain", "page_id", F.posexplode(_addresses_column()).alias("ord", "address"))
    return p


def structured_data(pages: DataFrame, per_page: int | None = None) -> DataFrame:
    """Company, products, jobs (all, or the first ``per_page``) and addresses of each page in one pass over its nodes."""
    p = _with_nodes(pages)
    keep = [c for c in p.columns if c != "nodes"]
    return p.select(
        *keep, _company_column().alias("company"),
        _items_column("Product", _product, "name", per_page).alias("products"),
        _items_column("JobPosting", _job, "title", per_page).alias("jobs"),
        _addresses_column().alias("addresses"),
    )
