"""Verification of address lists against supplied DNS and mail-server replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.emails import local_part
from ..functions.text import after_last, blank_to_null, ends_with_any, is_one_of, let, trim_ws

__all__ = [
    "edit_distance", "suggest_domains", "suggest_from_table", "check_syntax", "provider_flags", "resolve_mx", "probe_outcome",
    "verify_emails", "join_domain_facts",
]

SALTS = 16


def join_domain_facts(rows: DataFrame, facts: DataFrame, spread: str, how: str = "left") -> DataFrame:
    """Join one row per domain to rows whose domains are very uneven (a few providers hold most).

    Rows are spread over ``SALTS`` sub-keys by a hash of ``spread`` and the (narrow, unique)
    facts are repeated once per sub-key, so no task receives all rows of a large provider.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, ["domain", "_salt"], how).drop("_salt")


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two short texts, a swap of neighbours counting as one."""
    state = "struct<before:array<int>,last:array<int>>"
    n = F.length(b)

    def char(x: Column, i: Column) -> Column:
        return x.substr(i, F.lit(1))

    def next_row(s: Column, i: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            plain = F.least(
                F.get(s["last"], j) + 1, F.get(row, j - 1) + 1,
                F.get(s["last"], j - 1) + F.when(char(a, i) == char(b, j), 0).otherwise(1),
            )
            swapped = (i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j))
            return F.array_append(row, F.when(swapped, F.least(plain, F.get(s["before"], j - 2) + 1)).otherwise(plain))

        row = F.aggregate(F.sequence(F.lit(1), n), F.array(i), cell)
        return F.struct(s["last"].alias("before"), row.alias("last")).cast(state)

    start = F.struct(F.array().cast("array<int>").alias("before"), F.sequence(F.lit(0), n).alias("last")).cast(state)
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), start, next_row, lambda s: F.get(s["last"], n))


def _one_edit(tld: Column, word: str) -> Column:
    """One insertion, deletion, substitution or swap away from a short word."""
    swaps = [word[:i] + word[i + 1] + word[i] + word[i + 2:] for i in range(len(word) - 1)]
    return (F.levenshtein(tld, F.lit(word)) == 1) | tld.isin([s for s in swaps if s != word])


def suggest_domains(domains: DataFrame) -> DataFrame:
    """``(domain, suggestion)`` for distinct domains that look like a typo of a well-known one.

    The popular names are a constant array filtered inside the row (by length, then by a bounded
    plain edit distance that no swap can beat), so only the few near misses are compared fully.
    """
    d = domains.select("domain").filter(F.col("domain") != "").distinct()
    popular = F.transform(
        F.split(F.lit(" ".join(fv.POPULAR_DOMAINS)), " "), lambda p, i: F.struct(i.alias("i"), p.alias("p"))
    )
    near = F.filter(
        popular,
        lambda x: (F.abs(F.length(x["p"]) - F.length("domain")) <= 2) & F.levenshtein(F.col("domain"), x["p"], 4).between(0, 4),
    )
    tld = after_last(F.col("domain"), ".")
    known = is_one_of(tld, fv.GENERIC_TLDS + fv.VERIFIER_EXTRA_TLDS + fv.COUNTRY_TLDS)
    better = F.coalesce(*[F.when(_one_edit(tld, w), F.lit(w)) for w in fv.REPAIR_TLDS])
    stem = F.regexp_replace("domain", r"[^.]*\z", "")
    d = d.filter(~F.col("domain").isin(fv.POPULAR_DOMAINS)).select(
        "domain", F.when(~known, F.concat(stem, better)).alias("repaired"), near.alias("near")
    )
    c = d.select("domain", "repaired", F.explode_outer("near").alias("n"))
    c = c.withColumn("distance", F.when(F.col("n").isNotNull(), edit_distance(F.col("domain"), F.col("n.p"))))
    best = c.groupBy("domain").agg(
        F.min_by("n.p", F.when(F.col("distance") <= 2, F.struct("distance", "n.i"))).alias("typo_of"),
        F.first("repaired").alias("repaired"),
    )
    return best.select("domain", F.coalesce("typo_of", "repaired").alias("suggestion")).filter(F.col("suggestion").isNotNull())


def _deletions(x: Column, most: int) -> Column:
    """A short text and what is left of it after up to ``most`` deletions."""

    def shorter(x: Column) -> Column:
        places = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))

    found = F.array(x)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter))))
    return found


def suggest_from_table(domains: DataFrame, targets: DataFrame, radius: int = 2, prefix: int = 16) -> DataFrame:
    """``(domain, suggestion, distance)`` for distinct domains within ``radius`` edits of a caller's own ``targets (target)``.

    The nearest target wins, among equals the smallest.  Domains that are targets, empty ones and nulls have no suggestion.

    Two texts within ``radius`` edits have a common text after as many deletions from the first ``prefix`` characters of each
    (what an edit shifts out of one prefix is deleted from the other's end).  So both sides are looked up by equality, with
    a number of keys that depends on ``prefix`` alone; whether one side is small enough to broadcast is up to its measured size.
    Only what meets there is compared.
    """
    if prefix <= radius:
        raise ValueError("the prefix must be longer than the radius")
    known = targets.select(F.lower("target").alias("target")).where("target <> ''").distinct()
    asked = domains.select(F.lower("domain").alias("domain")).where("domain <> ''").distinct()
    asked = asked.join(known, asked["domain"] == known["target"], "left_anti")

    def keyed(table: DataFrame, name: str) -> DataFrame:
        return table.select(name, F.explode(_deletions(F.substring(name, 1, prefix), radius)).alias("key"))

    met = keyed(asked, "domain").join(keyed(known, "target"), "key").where(F.abs(F.length("domain") - F.length("target")) <= radius)
    sorted_of = lambda name: F.array_join(F.array_sort(F.split(name, "")), "")
    pairs = met.select("domain", "target").distinct().withColumn("plain", F.levenshtein("domain", "target", 2 * radius)).where("plain >= 0")
    # a swap is two plain edits and keeps the characters: where too many of them differ, no swap brings a pair nearer
    loose = F.when(F.col("plain") <= radius, 2 * (F.col("plain") - 2)).otherwise(2 * (2 * radius - F.col("plain")))
    swaps = F.levenshtein(sorted_of("domain"), sorted_of("target")) <= loose
    distance = F.when(swaps, edit_distance(F.col("domain"), F.col("target"))).otherwise(F.col("plain"))
    near = pairs.withColumn("distance", distance).where(F.col("distance") <= radius)
    best = near.groupBy("domain").agg(F.min(F.struct("distance", "target")).alias("best"))
    return best.select("domain", F.col("best.target").alias("suggestion"), "best.distance")


def _addresses(emails: DataFrame) -> DataFrame:
    e = emails.select(F.lower(trim_ws(F.col("email"))).alias("email")).distinct()
    e = e.withColumn("local_part", local_part(F.col("email")))
    return e.withColumn("domain", F.when(F.col("local_part") != "", after_last(F.col("email"), "@")).otherwise(""))


def _reason() -> Column:
    e, local, domain = F.col("email"), F.col("local_part"), F.col("domain")
    r = fv.SYNTAX_REASONS
    tld = after_last(domain, ".")
    known = is_one_of(tld, fv.GENERIC_TLDS + fv.VERIFIER_EXTRA_TLDS + fv.COUNTRY_TLDS)
    return (
        F.when(e == "", r["empty"])
        .when(e.rlike(fv.SP), r["spaces"])
        .when(F.instr(e, "@") == 0, r["no_at"])
        .when(local == "", r["no_at"])
        .when(F.contains(local, F.lit("@")), r["many_at"])
        .when(F.length(e) > 254, r["long"])
        .when(F.length(local) > 64, r["long_local"])
        .when(local.rlike(r"\A\.|\.\z"), r["edge_dot"])
        .when(F.contains(local, F.lit("..")), r["double_dot"])
        .when(~F.contains(domain, F.lit(".")), r["no_tld"])
        .when(domain.rlike(r"\A-|-\z"), r["edge_hyphen"])
        .when(~e.rlike(fv.MAILBOX), r["bad_chars"])
        .when(~known & F.col("suggestion").isNotNull(), F.concat(F.lit(r["tld_prefix"]), tld, F.lit(r["tld_suffix"])))
    )


def check_syntax(emails: DataFrame) -> DataFrame:
    """One row per distinct address: ``valid, reason, suggestion, local_part, domain``."""
    e = _addresses(emails)
    hints = suggest_domains(e)
    e = join_domain_facts(e, hints, "email")
    e = e.withColumn("suggestion", F.concat("local_part", F.lit("@"), "suggestion")).withColumn("reason", _reason())
    return e.select("email", "local_part", "domain", F.col("reason").isNull().alias("valid"), "reason", "suggestion")


def provider_flags(checked: DataFrame) -> DataFrame:
    """Adds ``webmail, disposable, role, professional`` (list look-ups are constants in the plan)."""
    domain = F.lower("domain")

    def role(base: Column) -> Column:
        tokens = F.filter(F.split(base, "[._-]"), lambda t: t != "")
        names = F.split(F.lit(" ".join(fv.VERIFIER_ROLES)), " ")
        return is_one_of(base, fv.VERIFIER_ROLES) | ((F.size(tokens) <= 2) & F.arrays_overlap(tokens, names))

    base = F.regexp_replace(F.lower("local_part"), r"\+.*\z", "")
    df = checked.withColumn("webmail", domain.isin(fv.WEBMAIL_DOMAINS))
    df = df.withColumn("disposable", domain.isin(fv.DISPOSABLE_DOMAINS) | ends_with_any(domain, fv.DISPOSABLE_SUFFIXES))
    df = df.withColumn("role", F.coalesce(let(base, role), F.lit(False)))
    return df.withColumn("professional", ~F.col("webmail") & ~F.col("disposable"))


def resolve_mx(domains: DataFrame, mx: DataFrame, a_records: DataFrame, dns_errors: DataFrame) -> DataFrame:
    """Mail hosts per distinct domain: MX by priority, else the domain itself when it has an A record.

    A resolver error other than "no such record" means not found, without the A fallback.
    """
    d = domains.select("domain").distinct()
    hosts = mx.filter(F.coalesce("exchange", F.lit("")) != "").groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("priority", "exchange"))),
                    lambda h: F.regexp_replace(h["exchange"], r"\.\z", "")).alias("mx_hosts")
    )
    has_a = a_records.select("domain").distinct().withColumn("has_a", F.lit(True))
    failed = dns_errors.filter(~F.col("code").isin("ENODATA", "ENOTFOUND")).groupBy("domain").agg(F.min("code").alias("code"))
    j = d.join(hosts, "domain", "left").join(has_a, "domain", "left").join(failed, "domain", "left")
    found = (
        F.when(F.col("mx_hosts").isNotNull(), F.col("mx_hosts"))
        .when(F.col("code").isNull() & F.col("has_a"), F.array("domain"))
        .otherwise(F.array().cast("array<string>"))
    )
    error = F.when(F.col("mx_hosts").isNull() & F.col("code").isNotNull(), F.concat(F.lit("DNS lookup failed ("), F.col("code"), F.lit(").")))
    return j.select("domain", (F.size(found) > 0).alias("mx_found"), found.alias("mx_hosts"), error.alias("mx_error"))


def probe_outcome(sessions: DataFrame) -> DataFrame:
    """Outcome and message per address from recorded reply codes."""
    m = fv.PROBE_MESSAGES
    ok = lambda c: F.coalesce(F.col(c).isin(250, 251), F.lit(False))
    first_line = F.coalesce(F.regexp_extract("text", r"\A([^\r\n]*)", 1), F.lit("")).substr(1, 200)
    greeted = F.coalesce((F.col("ehlo") == 250) | (F.col("helo") == 250), F.lit(False))
    sender = F.coalesce(F.col("mail_from") == 250, F.lit(False))
    error = (
        F.when(F.col("err") == "ECONNREFUSED", m["refused"])
        .when((F.col("err") == "ETIMEDOUT") | F.lower("err").contains("timeout"), m["timeout"])
        .when(F.col("err").isin("EHOSTUNREACH", "ENETUNREACH"), m["unreachable"])
        .otherwise(F.concat(F.lit("SMTP probe failed ("), F.col("err"), F.lit(").")))
    )
    outcome = (
        F.when(F.col("err").isNotNull() | ~greeted | ~sender, "blocked")
        .when(ok("rcpt") & ok("control"), "catch_all").when(ok("rcpt"), "accepted")
        .when(F.col("rcpt").between(500, 599), "rejected").when(F.col("rcpt").between(400, 499), "greylisted")
        .otherwise("blocked")
    )
    message = (
        F.when(F.col("err").isNotNull(), error).when(~greeted, m["handshake"]).when(~sender, m["sender"])
        .when(ok("rcpt") & ok("control"), m["catch_all"]).otherwise(first_line)
    )
    return sessions.select(F.lower(trim_ws(F.col("email"))).alias("email"), outcome.alias("outcome"), message.alias("message"))


def _initials() -> Column:
    parts = F.filter(F.split(F.coalesce(blank_to_null(F.col("local_part")), F.col("email")), r"[._\-+]"), lambda p: p != "")
    return let(
        parts,
        lambda p: F.when(F.size(p) >= 2, F.upper(F.concat(F.left(F.get(p, F.lit(0)), F.lit(1)), F.left(F.get(p, F.lit(1)), F.lit(1)))))
        .otherwise(F.coalesce(blank_to_null(F.upper(F.left(F.coalesce(F.get(p, F.lit(0)), F.col("local_part")), F.lit(2)))), F.lit("??"))),
    )


def _check(id_: str, label: str, status: Column | str, state: Column | str, detail: Column | str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(id_).alias("id"), F.lit(label).alias("label"), as_col(status).alias("status"),
        as_col(state).alias("state"), as_col(detail).alias("detail"),
    )


def verification_checks() -> Column:
    """The four checks of a verified row as array of struct(id, label, status, state, detail)."""
    t = fv.CHECK_TEXT
    typo = F.col("suggestion").isNotNull()
    fmt = _check(
        "format", "Format",
        F.when(~F.col("valid"), "Invalid").when(typo, "Possible typo").otherwise("Valid"),
        F.when(~F.col("valid"), "invalid").when(typo, "warning").otherwise("valid"),
        F.when(~F.col("valid"), F.coalesce("reason", F.lit(fv.SYNTAX_REASONS["fallback"])))
        .when(typo, F.concat(F.lit(t["format_typo_prefix"]), F.col("suggestion"), F.lit(t["format_typo_suffix"])))
        .otherwise(t["format_ok"]),
    )
    skipped = lambda id_, label, why: _check(id_, label, "Not checked", "unknown", why)
    pick = lambda d, r, w, p: F.when(F.col("disposable"), d).when(F.col("role"), r).when(F.col("webmail"), w).otherwise(p)
    kind = _check(
        "type", "Type", pick("Disposable", "Role-based", "Webmail", "Professional"), pick("invalid", "warning", "warning", "valid"),
        pick(t["type_disposable"], t["type_role"], t["type_webmail"], t["type_professional"]),
    )
    mx = F.col("mx_found")
    server = _check(
        "server", "Server status", F.when(mx, "Valid").otherwise("Invalid"), F.when(mx, "valid").otherwise("invalid"),
        F.when(mx, F.concat(F.lit(t["mx_prefix"]), F.col("domain"), F.lit(t["mx_suffix"]))).otherwise(
            F.coalesce("mx_error", F.concat(F.lit(t["no_mx_prefix"]), F.col("domain"), F.lit(t["no_mx_suffix"])))),
    )

    def by_outcome(i: int) -> Column:
        out = None
        for name, values in fv.SMTP_STATUS.items():
            value = F.lit(values[i]) if values[i] is not None else F.coalesce(blank_to_null(F.col("message")), F.lit(fv.SMTP_FALLBACK[name]))
            cond = F.col("outcome") == name
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    smtp = _check("smtp", "Email status", by_outcome(0), by_outcome(1), by_outcome(2))
    malformed = F.array(fmt, skipped("type", "Type", t["skip_malformed"]), skipped("server", "Server status", t["skip_malformed"]),
                        skipped("smtp", "Email status", t["skip_malformed"]))
    return (
        F.when(~F.col("valid"), malformed)
        .when(~mx, F.array(fmt, kind, server, skipped("smtp", "Email status", t["skip_no_mx"])))
        .otherwise(F.array(fmt, kind, server, smtp))
    )


def verify_emails(
    emails: DataFrame, mx: DataFrame, a_records: DataFrame, dns_errors: DataFrame, smtp_sessions: DataFrame | None = None
) -> DataFrame:
    """Score and verdict per distinct address, in stages: syntax, lists, DNS, mailbox replies.

    Domain-level work runs once per domain and is joined back with a spread key; the stages are
    guards of one CASE, so later look-ups never overrule an earlier failure.
    """
    e = provider_flags(check_syntax(emails))
    dns = resolve_mx(e.filter("valid").select("domain"), mx, a_records, dns_errors)
    e = join_domain_facts(e, dns, "email")
    if smtp_sessions is not None:
        probe = probe_outcome(smtp_sessions).groupBy("email").agg(F.min(F.struct("outcome", "message")).alias("probe"))
        e = e.join(probe, "email", "left")
    else:
        e = e.withColumn("probe", F.lit(None).cast("struct<outcome:string,message:string>"))
    reachable = F.col("valid") & F.coalesce("mx_found", F.lit(False))
    probed = reachable & ~F.col("disposable") & F.col("probe").isNotNull()
    e = e.withColumn("outcome", F.when(probed, F.col("probe.outcome")).otherwise("skipped")).withColumn(
        "message", F.when(probed, F.col("probe.message")).when(reachable, fv.CHECK_TEXT["smtp_skipped"])
    ).withColumn("mx_found", F.coalesce("mx_found", F.lit(False)))
    for flag in ("webmail", "disposable", "role", "professional"):
        e = e.withColumn(flag, F.col(flag) & F.col("valid"))
    accepted, typo = F.col("outcome") == "accepted", F.col("suggestion").isNotNull()
    base = (
        F.lit(55)
        + F.when(accepted, 37).when(F.col("outcome") == "catch_all", 5).when(F.col("outcome") == "greylisted", 8).otherwise(12)
        - F.when(F.col("role"), 12).otherwise(0) - F.when(F.col("webmail"), 2).otherwise(0)
    )
    score = F.greatest(F.lit(5), F.least(F.lit(99), F.when(typo & ~accepted, F.least(base, F.lit(40))).otherwise(base)))
    verdict = (
        F.when(typo & ~accepted, "risky")
        .when(accepted, F.when(F.col("role"), "risky").otherwise("valid"))
        .when(F.col("outcome") == "catch_all", "risky").otherwise("unknown")
    )

    def staged(invalid, no_mx, disposable, rejected, final: Column) -> Column:
        return (
            F.when(~F.col("valid"), invalid).when(~F.col("mx_found"), no_mx).when(F.col("disposable"), disposable)
            .when(F.col("outcome") == "rejected", rejected).otherwise(final)
        )

    e = e.withColumn("verdict", staged("invalid", "invalid", "risky", "invalid", verdict)).withColumn(
        "score", staged(0, 2, 12, 4, score)
    )
    summary = F.coalesce(*[F.when(F.col("verdict") == k, v) for k, v in fv.SUMMARIES.items()])
    return e.select(
        "email", "local_part", "domain", _initials().alias("initials"), "verdict", "score", summary.alias("summary"),
        "valid", "reason", "suggestion", "webmail", "disposable", "role", "professional", "mx_found",
        F.coalesce("mx_hosts", F.array().cast("array<string>")).alias("mx_hosts"), "mx_error", "outcome", "message",
        verification_checks().alias("checks"),
    )
