"""URL Column builders: normalise, site key, joining, stripping.

A URL is split with regular expressions (``parse_url`` rejects blanks and raises on odd
input); the WHATWG behaviours that matter for keys are kept: host in lower case, default port
dropped, dot segments resolved, non-ASCII and unsafe characters percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import blank_to_null, each, extract, let, trim_ws

_HTTP = r"(?i)\Ahttps?://"
_OTHER_SCHEME = r"\A(?!(?i:https?://))[A-Za-z][A-Za-z0-9+.\-]*:"
# scheme, authority, path, query, fragment
_PARTS = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
# negated classes: everything but the characters that stay as they are
_PATH_SAFE = r"^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e"
_QUERY_SAFE = r"^\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e"
_FRAGMENT_SAFE = r"^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e"
_HOST_OK = r"\A[^\s#%/:<>?@\[\\\]^|]+\z"


def _encode(v: Column, unsafe: str) -> Column:
    """Percent-encode the characters matching ``unsafe`` (a character class body)."""
    ch = f"[{unsafe}]"

    def one(s: Column) -> Column:
        return F.when(s.rlike(ch), F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))).otherwise(s)

    return F.when(v.rlike(ch), F.array_join(F.transform(F.split(v, ""), one), "")).otherwise(v)


def _resolve_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(seg == ".", acc)
            .otherwise(F.array_append(acc, seg))
        )

    # a final dot segment leaves a trailing slash
    segments = F.split(F.regexp_replace(p, r"(/\.{1,2})\z", "$1/"), "/")
    folded = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(p.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)"), folded).otherwise(p)


def _split_url(u: Column) -> Column:
    return F.struct(
        F.lower(extract(u, _PARTS, 1)).alias("scheme"),
        F.lower(F.regexp_replace(extract(u, _PARTS, 2), r"\A.*@", "")).alias("authority"),
        F.coalesce(blank_to_null(F.regexp_replace(extract(u, _PARTS, 3), r"\\", "/")), F.lit("/")).alias("path"),
        extract(u, _PARTS, 4).alias("query"),
        extract(u, _PARTS, 5).alias("fragment"),
    )


def _canonical(p: Column) -> Column:
    """Split parts to struct(scheme, host, path, query, fragment); NULL for a bad host."""
    name = F.regexp_replace(p["authority"], r":\d*\z", "")
    port = extract(p["authority"], r":(\d+)\z", 1)
    default = ((p["scheme"] == "http") & (port == "80")) | ((p["scheme"] == "https") & (port == "443"))
    return F.when(
        (p["scheme"] != "") & name.rlike(_HOST_OK),
        F.struct(
            p["scheme"].alias("scheme"),
            F.when(default | (port == ""), name).otherwise(F.concat(name, F.lit(":"), port)).alias("host"),
            _resolve_dots(p["path"]).alias("path"),
            F.when(p["query"] == "?", "").otherwise(_encode(p["query"], _QUERY_SAFE)).alias("query"),
            F.when(p["fragment"] == "#", "").otherwise(_encode(p["fragment"], _FRAGMENT_SAFE)).alias("fragment"),
        ),
    )


def _encoded_path(s: Column) -> Column:
    return F.when(s.isNotNull(), s.withField("path", _encode(s["path"], _PATH_SAFE)))


# absolute URL -> struct, as consecutive steps for ``each`` / ``let``
URL_STEPS = (_split_url, _canonical, _encoded_path)


def url_struct(url: Column) -> Column:
    """Struct(scheme, host, path, query, fragment) of an absolute URL; NULL when unparsable.

    ``host`` keeps a non-default port, as a URL's host does.
    """
    return let(url, *URL_STEPS)


def _with_scheme(t: Column) -> Column:
    return F.when(t.rlike(_HTTP), t).otherwise(F.concat(F.lit("https://"), t))


def _full(s: Column) -> Column:
    return F.concat(s["scheme"], F.lit("://"), s["host"], F.rtrim(s["path"], F.lit("/")), s["query"], s["fragment"])


def normalize_url(url: Column) -> Column:
    """Trimmed, with scheme, lower-case host, no trailing slash on the path."""
    typed = let(trim_ws(url), _with_scheme)
    return F.coalesce(_full(url_struct(typed)), typed)


def site_key(url: Column) -> Column:
    """Host (with port) in lower case; '' when the URL does not parse."""
    return F.coalesce(url_struct(let(trim_ws(url), _with_scheme))["host"], F.lit(""))


def page_key(url: Column) -> Column:
    """What a fetch of ``url`` resolves to: the normalised URL without its fragment."""
    return F.regexp_replace(normalize_url(url), r"(?s)#.*\z", "")


def is_same_site(host: Column, base: Column) -> Column:
    """Equal to the base host, or a sub-domain of it."""
    return F.coalesce((host == base) | F.endswith(host, F.concat(F.lit("."), base)), F.lit(False))


def resolve_links(base: Column, hrefs: Column) -> Column:
    """Array of the URL structs that the hrefs of page ``base`` point to (NULL: unparsable).

    ``base`` is the struct of the page's URL.  Schemes other than http(s) get an empty host.
    """
    origin = F.concat(base["scheme"], F.lit("://"), base["host"])
    folder = F.concat(origin, F.regexp_replace(base["path"], r"[^/]*\z", ""))

    def absolute(h: Column) -> Column:
        return (
            F.when(h.rlike(_HTTP), h)
            .when(h.rlike(_OTHER_SCHEME), F.concat(F.regexp_replace(h, r"(?s)\A([^:]*):.*\z", "$1"), F.lit("://x")))
            .when(h.rlike(r"\A[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), h))
            .when(h.rlike(r"\A[/\\]"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, base["path"], h))
            .when(h.startswith("#") | (h == ""), F.concat(origin, base["path"], base["query"], h))
            .otherwise(F.concat(folder, h))
        )

    def blank_foreign(s: Column) -> Column:
        web = s["scheme"].isin("http", "https")
        return F.when(web, s).when(s.isNotNull(), s.withField("host", F.lit("")))

    return each(hrefs, absolute, *URL_STEPS, blank_foreign)


def strip_query_fragment(s: Column) -> Column:
    """``scheme://host/path`` of a URL struct, without trailing slashes."""
    return F.concat(s["scheme"], F.lit("://"), s["host"], F.rtrim(s["path"], F.lit("/")))


def is_valid_url(url: Column) -> Column:
    return trim_ws(url).rlike(fv.VALID_URL)


def path_of(url: Column) -> Column:
    """Lower-case path of a URL ('' when unparsable)."""
    return F.lower(F.coalesce(url_struct(url)["path"], F.lit("")))
