"""Column builders for addresses: validity, repair, kind, on-site test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import (
    after_last, before_last, decode_entities, drop_prefix, each, ends_with_any, extract_all, is_one_of, let, trim_ws,
)


def local_part(email: Column) -> Column:
    return before_last(email, "@")


def domain_part(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), after_last(email, "@")).otherwise("")


# ------------------------------------------------------------------------------ extractor rules
def is_kept_email(e: Column) -> Column:
    """Well formed and not an asset name, a junk domain or an unattended user."""
    return (
        e.rlike(r"\A(?:" + fv.EMAIL + r")\z")
        & ~ends_with_any(e, fv.ASSET_EXTENSIONS)
        & ~is_one_of(domain_part(e), fv.JUNK_EMAIL_DOMAINS)
        & ~is_one_of(local_part(e), fv.JUNK_EMAIL_USERS)
    )


def _spelled_out(raw: Column) -> Column:
    """``name [at] host (dot) tld`` to an address."""
    x = F.lower(raw)
    for word, sign in (("at", "@"), ("dot", ".")):
        for form in (f"[{word}]", f"({word})", f" {word} ", f"{{{word}}}"):
            x = F.replace(x, F.lit(form), F.lit(sign))
    return F.regexp_replace(x, fv.SP + "+", "")


def emails_in(text: Column, mailto_hrefs: Column) -> Column:
    """Distinct kept addresses of a page: plain, spelled-out and mailto forms."""
    plain = F.transform(
        extract_all(text, fv.EMAIL_SCAN),
        lambda m: F.regexp_replace(F.lower(m), r"\A[.,;:]+|[.,;:]+\z", ""),
    )
    spelled = F.transform(extract_all(text, fv.OBFUSCATED_SCAN), _spelled_out)
    linked = F.transform(mailto_hrefs, lambda h: F.lower(trim_ws(F.substring_index(drop_prefix(h, 7), "?", 1))))
    return F.array_distinct(F.filter(F.concat(plain, spelled, linked), is_kept_email))


# ------------------------------------------------------------------------------ finder rules
def _repair_domain(domain: Column) -> Column:
    """Drop up to two trailing labels that the next word of a sentence left on the domain."""

    def repair(labels: Column) -> Column:
        n = F.size(labels)

        def known(k: int) -> Column:
            return is_one_of(F.get(labels, n - 1 - k), fv.GENERIC_TLDS + fv.COUNTRY_TLDS)

        drop = F.when((n < 3) | known(0), 0).when(known(1), 1).when((n >= 4) & known(2), 2).otherwise(0)
        return F.array_join(F.slice(labels, F.lit(1), n - drop), ".")

    return let(F.split(domain, r"\."), repair)


def _usable(p: Column) -> Column:
    """Rules on struct(local, domain, email)."""
    local, domain, e = p["local"], p["domain"], p["email"]
    return (
        e.rlike(fv.USABLE_EMAIL)
        & ~e.rlike(r"@[0-9]x\z")
        & ~ends_with_any(e, fv.FINDER_ASSET_SUFFIXES)
        & (F.length(local) <= 64) & (F.length(e) <= 254)
        & ~is_one_of(domain, fv.PLACEHOLDER_DOMAINS)
        & ~is_one_of(local, fv.PLACEHOLDER_LOCALS + fv.UNREACHABLE_LOCALS)
        & ~local.rlike(r"\A[0-9a-f]{16,}\z")
        & ~((F.length(local) >= 20) & ~local.rlike("[._+-]") & local.rlike("[a-z]") & local.rlike("[0-9]"))
        & ~local.rlike(r"\Au[0-9a-f]{4}")
        & ~local.rlike(r"\A\d+\z")
        & ~domain.rlike(r"(?:\A|\.)\d+(?:\.|\z)")
    )


def _split_repaired(t: Column) -> Column:
    return F.struct(local_part(t).alias("local"), _repair_domain(domain_part(t)).alias("domain"))


def _whole(p: Column) -> Column:
    return p.withField("email", F.concat(p["local"], F.lit("@"), p["domain"]))


# raw address -> usable address or NULL, as consecutive steps for ``each`` / ``let``
USABLE_STEPS = (_split_repaired, _whole, lambda p: F.when(_usable(p), p["email"]))


def normalize_usable_email(raw: Column) -> Column:
    """Lower-cased and repaired address, NULL when it is not contactable: a placeholder, an
    asset name, a machine id, an unattended box."""
    return let(F.lower(trim_ws(raw)), *USABLE_STEPS)


def classify_email(email: Column) -> Column:
    """role (a shared box, by whole name or any part of it), personal (name-like) or generic."""

    def kind(base: Column) -> Column:
        roles = F.split(F.lit(" ".join(fv.FINDER_ROLES)), " ")
        return (
            F.when(is_one_of(base, fv.FINDER_ROLES) | F.arrays_overlap(F.split(base, "[._-]"), roles), "role")
            .when(base.rlike(fv.NAME_LIKE) | base.rlike(fv.INITIAL_NAME), "personal")
            .otherwise("generic")
        )

    return let(F.regexp_replace(local_part(F.lower(email)), r"\+.*\z", ""), kind)


def is_on_site(email_domain: Column, site: Column) -> Column:
    """The address is on the site's host, below it, or shares its last two labels."""
    host = F.substring_index(F.regexp_replace(F.lower(site), r"\Awww\.", ""), ":", 1)
    mail = F.lower(email_domain)
    return (host != "") & (
        (mail == host) | F.endswith(mail, F.concat(F.lit("."), host))
        | (F.substring_index(mail, ".", -2) == F.substring_index(host, ".", -2))
    )


def page_email_hits(html: Column, visible: Column, hrefs: Column) -> Column:
    """Usable addresses of a page as array of struct(email, via_mailto)."""
    names = {"commat": "@", "period": "."}
    edges = r"\A[.,;:<>(\"'" + fv.SP_CHARS + r"]+|[.,;:<>)\"'" + fv.SP_CHARS + r"]+\z"

    def tidy(x: Column) -> Column:
        return F.lower(trim_ws(F.regexp_replace(trim_ws(decode_entities(x, names)), edges, "")))

    def mail_value(h: Column) -> Column:
        return F.substring_index(drop_prefix(h, 7), "?", 1)

    def mail_parts(v: Column) -> Column:
        # a plus sign is literal in a mail link
        return F.split(F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v), "[,;]")

    mailto = F.flatten(each(F.filter(hrefs, lambda h: F.lower(h).startswith("mailto:")), mail_value, mail_parts))

    def spelled(m: Column) -> Column:
        sp = fv.SP
        x = F.lower(m)
        for pattern, sign in (
            (sp + r"*[\[({<]" + sp + "*(?:at|@)" + sp + r"*[\])}>]" + sp + "*", "@"),
            (sp + "+at" + sp + "+", "@"),
            (sp + r"*[\[({<]" + sp + "*(?:dot|punkt|punto)" + sp + r"*[\])}>]" + sp + "*", "."),
            (sp + "+(?:dot|punkt|punto)" + sp + "+", "."),
            (sp + "+", ""),
        ):
            x = F.regexp_replace(x, pattern, sign)
        return x

    linked = each(mailto, tidy, *USABLE_STEPS)
    written = F.concat(
        extract_all(decode_entities(html, names), fv.EMAIL_SCAN), F.transform(extract_all(visible, fv.OBFUSCATED_SCAN), spelled)
    )
    parsed = F.struct(
        F.array_distinct(F.filter(linked, lambda e: e.isNotNull())).alias("linked"),
        F.array_distinct(F.filter(each(written, tidy, *USABLE_STEPS), lambda e: e.isNotNull())).alias("written"),
    )

    def merge(p: Column) -> Column:
        return F.concat(
            F.transform(p["linked"], lambda e: F.struct(e.alias("email"), F.lit(True).alias("via_mailto"))),
            F.transform(
                F.array_except(p["written"], p["linked"]), lambda e: F.struct(e.alias("email"), F.lit(False).alias("via_mailto"))
            ),
        )

    return let(parsed, merge)
