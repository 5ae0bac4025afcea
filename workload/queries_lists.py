"""Registered queries over address lists, campaigns and recorded look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import fixed_values as fv
from pagequarry.functions.addresses import clean_address, join_address_parts, plausible_address
from pagequarry.functions.text import squeeze, trim_ws
from pagequarry.operators import addresses
from pagequarry.operators import campaigns as ca
from pagequarry.operators import emails as em
from pagequarry.operators import page_facts, phones, verify
from pagequarry.plans.extractor import breakdown
from pagequarry.session import shared_folder
from pagequarry.sources import readers

from . import sqltext as st
from .derived import table
from .queries_pages import kind_sql
from .registry import query

K = "CAST(c_custkey AS STRING)"


def _case(key: str, forms: list[str]) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


# ------------------------------------------------------------------------------ raw phones, raw addresses
_P4 = "lpad(CAST(c_custkey % 9000 + 1000 AS STRING), 4, '0')"
_RAW_PHONES = _case("c_custkey", [
    f"concat('+92 300 123', {_P4})", f"concat('(555) 223-', {_P4})", f"concat('555.323.', {_P4})", f"concat('192.168.1.', CAST(c_custkey % 250 AS STRING))",
    f"concat('2024-01-', CAST(c_custkey % 20 + 10 AS STRING))", f"concat('84-402', {_P4})", f"concat('+1 800 555 ', {_P4}, ' ext ', CAST(c_custkey % 90 AS STRING))",
    f"concat('1 707 ', CAST(c_custkey % 900 + 100 AS STRING))", f"concat('978-0-306-', {_P4}, '-7')", f"concat('0300123', {_P4})", "'1234567890'", f"concat('16946', {_P4}, '1')",
])
_DISPLAY = _case("c_custkey", [
    f"concat('+92 300 123', {_P4})", f"concat('(555) 223-', {_P4})", f"concat('555-323-', {_P4})", "NULL", "NULL", "NULL",
    f"concat('+1 800 555 ', {_P4}, ' ext. ', CAST(c_custkey % 90 AS STRING))", "NULL", "NULL", f"concat('0300123', {_P4})", "NULL", "NULL",
])


@query(f"SELECT c_custkey, {_RAW_PHONES} AS raw, {_DISPLAY} AS display FROM customer")
def phone_validation(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.expr(_RAW_PHONES).alias("raw"), F.lit(False).alias("trusted"))
    return phones.validate_phones(d).select("c_custkey", "raw", "display")


_RAW_ADDRESS = _case("c_custkey", [
    f"concat({K}, ' Main Street, Springfield')", f"concat('Plot ', {K}, ', Clifton, Karachi')", "'Pakistan'", f"concat('Call us at ', {K}, ' for more')",
    "'College Road, Bahawalpur, Punjab, Pakistan'", f"concat('We were at ', {K}, ' Main Street, Springfield')", "'The Apache Way, Learn, Blog'",
    "'Springfield, IL 62704'", f"concat({K}, ' apples, ', {K}, ' pears')", "'Karachi, Sindh, 75600, Pakistan'",
])


@query(f"SELECT c_custkey, c_custkey % 10 IN (0, 1, 4, 7, 9) AS plausible FROM customer")
def plausible_addresses(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", trim_ws(squeeze(F.expr(_RAW_ADDRESS))).alias("t"))
    return d.select("c_custkey", plausible_address(F.col("t")).alias("plausible"))


_LABELLED = _case("c_custkey", [
    f"concat('Address: ', {K}, ' High St.,, Leeds | UK')", f"concat('Head Office  ', {K}, ' Mall Road • Lahore.')", f"concat(' - Office ', {K}, ', 2nd Floor ;')",
])
_UNLABELLED = _case("c_custkey", [
    f"concat({K}, ' High St., Leeds, UK')", f"concat({K}, ' Mall Road, Lahore')", f"concat('Office ', {K}, ', 2nd Floor')",
])


@query(f"SELECT c_custkey, {_UNLABELLED} AS address FROM customer")
def cleaned_addresses(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean_address(F.expr(_LABELLED)).alias("address"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat(CAST(s_suppkey AS VARCHAR), ' Mall Road, Lahore, Punjab, 54000 Pakistan')
   WHEN 1 THEN concat('Town ', CAST(s_suppkey AS VARCHAR), ', United Kingdom') WHEN 2 THEN NULL ELSE NULL END AS address FROM supplier""")
def joined_address_parts(spark, sf):
    k, r = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    parts = F.struct(
        F.when(r == 0, F.concat(k, F.lit(" Mall Road"))).alias("streetAddress"),
        F.when(r == 0, "Lahore").when(r == 1, F.concat(F.lit("Town "), k)).alias("addressLocality"),
        F.when(r.isin(0, 2), "Punjab").alias("addressRegion"), F.when(r == 0, "54000").alias("postalCode"),
        F.when(r == 1, "uk").otherwise("PK").alias("addressCountry"),
    )
    return table(spark, sf, "supplier").select("s_suppkey", join_address_parts(parts).alias("address"))


# ------------------------------------------------------------------------------ found addresses
_FOUND = _case("c_custkey", [
    f"concat(' Support', '@firm', {K}, '.com')", f"concat('john.smith@acme', {K}, '.io')", f"concat('logo', {K}, '@2x.png')", f"concat('user@domain', {K}, '.com')",
    f"concat('team@apache', {K}, '.org.Subscribe')", f"concat('j.doe@firm', {K}, '.de')", f"concat('sales.uk+x@vendor', {K}, '.com')", f"concat('x', {K}, '@wixpress.com')",
    f"concat({K}, '@numbers.com')", f"concat('abcdefghijklmnopqrst', {K}, '@mail', {K}, '.net')", f"concat('kim', {K}, '@shop.museum')", f"concat('u003ekim@shop', {K}, '.com')",
])
_USABLE = _case("c_custkey", [
    f"concat('support@firm', {K}, '.com')", f"concat('john.smith@acme', {K}, '.io')", "NULL", "NULL", f"concat('team@apache', {K}, '.org')", f"concat('j.doe@firm', {K}, '.de')",
    f"concat('sales.uk+x@vendor', {K}, '.com')", "NULL", "NULL", "NULL", f"concat('kim', {K}, '@shop.museum')", "NULL",
])


@query(f"SELECT c_custkey, normalized, CASE WHEN normalized IS NOT NULL THEN {kind_sql('normalized')} END AS kind FROM (SELECT c_custkey, {_USABLE} AS normalized FROM customer)")
def email_classes(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.expr(_FOUND).alias("email"))
    return em.normalize_emails(d).select("c_custkey", "normalized", "kind")


# ------------------------------------------------------------------------------ verification
_ADDRESS = _case("c_custkey", [
    f"concat('user', {K}, '@shop', CAST(c_custkey % 50 AS STRING), '.org')", f"concat(' First.Last', {K}, '@Gmail.com')", "concat('info@firm', CAST(c_custkey % 97 AS STRING), '.co')",
    f"concat('bob', {K}, '@gmial.com')", f"concat('bad address', {K}, '@x.com')", f"concat('two@@at', {K}, 'longer.com')", f"concat('.dot', {K}, '@longdomain.com')",
    f"concat('a..b', {K}, '@longdomain.com')", f"concat('joe', {K}, '@acmeworks', CAST(c_custkey % 10 AS STRING), '.con')", f"concat('x', {K}, '@mailinator.com')",
    f"concat('y', {K}, '@box', CAST(c_custkey % 7 AS STRING), '.yopmail.com')", f"concat('sales.uk+tag', {K}, '@shop', CAST(c_custkey % 50 AS STRING), '.org')",
    f"concat('nodomain', {K})", f"concat('tld', {K}, '@host')", f"concat('hyph', {K}, '@-badlongname.com')", f"concat('ünï', {K}, '@longdomain.com')",
])
_Q = lambda ws: ", ".join(st.q(w) for w in ws)
_POPULAR = ", ".join(f"({i}, {st.q(p)})" for i, p in enumerate(fv.POPULAR_DOMAINS))
_ALL_TLDS = _Q(fv.GENERIC_TLDS + fv.VERIFIER_EXTRA_TLDS + fv.COUNTRY_TLDS)
_R = fv.SYNTAX_REASONS
ADDR_CTE = rf"""raw AS (SELECT DISTINCT lower(trim({_ADDRESS})) AS email FROM customer),
split AS (SELECT email, regexp_extract(email, '^(.+)@', 1) AS local_part, CASE WHEN regexp_matches(email, '^.+@') THEN regexp_extract(email, '@([^@]*)$', 1) ELSE '' END AS domain FROM raw),
domains AS (SELECT DISTINCT domain FROM split WHERE domain <> ''),
near AS (SELECT domain, arg_min(p, d * 100 + i) AS typo FROM (SELECT domain, p, i, damerau_levenshtein(domain, p) AS d FROM domains, (VALUES {_POPULAR}) v(i, p)
   WHERE abs(length(domain) - length(p)) <= 2) WHERE d <= 2 GROUP BY domain),
fix AS (SELECT domain, arg_min(t, i) AS tld FROM (SELECT domain, t, i FROM domains, (VALUES (0, 'com'), (1, 'net'), (2, 'org'), (3, 'co'), (4, 'io')) v(i, t)
   WHERE damerau_levenshtein(regexp_extract(domain, '([^.]*)$', 1), t) = 1 AND regexp_extract(domain, '([^.]*)$', 1) NOT IN ({_ALL_TLDS})) GROUP BY domain),
hints AS (SELECT domain, coalesce(typo, concat(regexp_replace(domain, '[^.]*$', ''), tld)) AS hint FROM domains LEFT JOIN near USING (domain) LEFT JOIN fix USING (domain)
   WHERE domain NOT IN ({_Q(fv.POPULAR_DOMAINS)}) AND coalesce(typo, tld) IS NOT NULL),
syntax AS (SELECT email, local_part, domain, concat(local_part, '@', hint) AS suggestion0, hint,
   CASE WHEN email = '' THEN {st.q(_R['empty'])} WHEN regexp_matches(email, '\s') THEN {st.q(_R['spaces'])} WHEN local_part = '' THEN {st.q(_R['no_at'])}
     WHEN local_part LIKE '%@%' THEN {st.q(_R['many_at'])} WHEN length(email) > 254 THEN {st.q(_R['long'])} WHEN length(local_part) > 64 THEN {st.q(_R['long_local'])}
     WHEN local_part LIKE '.%' OR local_part LIKE '%.' THEN {st.q(_R['edge_dot'])} WHEN local_part LIKE '%..%' THEN {st.q(_R['double_dot'])} WHEN domain NOT LIKE '%.%' THEN {st.q(_R['no_tld'])}
     WHEN domain LIKE '-%' OR domain LIKE '%-' THEN {st.q(_R['edge_hyphen'])}
     WHEN NOT regexp_matches(email, {st.q(fv.MAILBOX)}) THEN {st.q(_R['bad_chars'])}
     WHEN hint IS NOT NULL AND regexp_extract(domain, '([^.]*)$', 1) NOT IN ({_ALL_TLDS}) THEN concat('“.', regexp_extract(domain, '([^.]*)$', 1), '” does not look like a real top-level domain.') END AS reason
   FROM split LEFT JOIN hints USING (domain)),
checked AS (SELECT email, local_part, domain, reason IS NULL AS valid, reason, CASE WHEN hint IS NOT NULL THEN suggestion0 END AS suggestion FROM syntax)"""


def _addresses(spark, sf):
    return table(spark, sf, "customer").select(F.expr(_ADDRESS).alias("email"))


@query("WITH " + ADDR_CTE + " SELECT * FROM checked")
def email_syntax(spark, sf):
    return verify.check_syntax(_addresses(spark, sf))


@query("WITH " + ADDR_CTE + " SELECT domain, hint AS suggestion FROM hints")
def domain_suggestions(spark, sf):
    d = _addresses(spark, sf).select(F.lower(F.trim("email")).alias("email"))
    return verify.suggest_domains(d.select(F.regexp_extract("email", r"\A.+@([^@]*)\z", 1).alias("domain")))


_OWN_DOMAIN = lambda name, source: f"SELECT DISTINCT concat(w, '.example') AS {name} FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM {source}) WHERE length(w) >= 5"


@query(f"""WITH targets AS ({_OWN_DOMAIN('target', 'benchmark')}), asked AS ({_OWN_DOMAIN('domain', 'conversations')} AND concat(w, '.example') NOT IN (SELECT target FROM targets))
 SELECT domain, arg_min(target, (d, target)) AS suggestion, CAST(min(d) AS INTEGER) AS distance
 FROM (SELECT domain, target, damerau_levenshtein(domain, target) AS d FROM asked JOIN targets ON abs(length(domain) - length(target)) <= 2) WHERE d <= 2 GROUP BY domain""")
def table_domain_suggestions(spark, sf):
    """Targets by the table: a domain for every longer word of the benchmark, asked for those of the conversations."""

    def domains(source: str, name: str):
        words = table(spark, sf, source).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
        return words.where(F.length("w") >= 5).select(F.concat("w", F.lit(".example")).alias(name))

    return verify.suggest_from_table(domains("conversations", "domain"), domains("benchmark", "target"))


_ROLES = _Q(fv.VERIFIER_ROLES)
FLAG_CTE = rf"""flags AS (SELECT *, webmail0 AND valid AS webmail, disposable0 AND valid AS disposable, role0 AND valid AS role, NOT webmail0 AND NOT disposable0 AND valid AS professional FROM (
  SELECT *, domain IN ({_Q(fv.WEBMAIL_DOMAINS)}) AS webmail0, domain IN ({_Q(fv.DISPOSABLE_DOMAINS)}) OR regexp_matches(domain, '(?:{"|".join(s.replace(".", chr(92) + ".") for s in fv.DISPOSABLE_SUFFIXES)})$') AS disposable0,
    base IN ({_ROLES}) OR (len(tokens) <= 2 AND list_has_any(tokens, [{_ROLES}])) AS role0
  FROM (SELECT *, regexp_replace(local_part, '\+.*$', '') AS base, list_filter(string_split_regex(regexp_replace(local_part, '\+.*$', ''), '[._-]'), lambda t: t <> '') AS tokens FROM checked)))"""


@query("WITH " + ADDR_CTE + "," + FLAG_CTE + " SELECT email, webmail0 AS webmail, disposable0 AS disposable, role0 AS role, NOT webmail0 AND NOT disposable0 AS professional FROM flags")
def provider_flags(spark, sf):
    return verify.provider_flags(verify.check_syntax(_addresses(spark, sf))).select("email", "webmail", "disposable", "role", "professional")


_S = "CAST(s_suppkey % 50 AS STRING)"
_MX = f"""SELECT concat('shop', {_S}, '.org') AS domain, s_nationkey AS priority, concat('mx', CAST(s_suppkey AS STRING), '.shop', {_S}, '.org.') AS exchange FROM supplier WHERE s_suppkey % 10 <> 9
 UNION ALL SELECT 'gmail.com', n_nationkey, concat('smtp', CAST(n_nationkey AS STRING), '.gmail.com') FROM nation UNION ALL SELECT 'gmial.com', r_regionkey, 'mx.gmial.com' FROM region
 UNION ALL SELECT 'mailinator.com', r_regionkey, 'mx.mailinator.com.' FROM region UNION ALL SELECT concat('box', CAST(r_regionkey AS STRING), '.yopmail.com'), 1, 'mx.yopmail.com' FROM region"""
_F = "concat('firm', CAST(s_suppkey % 97 AS STRING), '.co')"
_A = f"SELECT DISTINCT {_F} AS domain, '10.0.0.1' AS ip FROM supplier WHERE s_suppkey % 2 = 0"
_DNS = f"SELECT DISTINCT {_F} AS domain, CASE WHEN s_suppkey % 97 % 3 = 0 THEN 'ESERVFAIL' ELSE 'ENODATA' END AS code FROM supplier WHERE s_suppkey % 97 % 5 = 1"


def _lookups(spark, sf):
    for t in ("supplier", "nation", "region"):
        table(spark, sf, t).createOrReplaceTempView(f"lookup_{t}")
    named = lambda sql: spark.sql(sql.replace("FROM supplier", "FROM lookup_supplier").replace("FROM nation", "FROM lookup_nation").replace("FROM region", "FROM lookup_region"))
    return named(_MX), named(_A), named(_DNS)


MX_CTE = f"""mx AS ({_MX}), a_records AS ({_A}), dns_errors AS ({_DNS}),
hosts AS (SELECT domain, string_agg(regexp_replace(exchange, '\\.$', ''), '|' ORDER BY priority, exchange) AS hosts FROM (SELECT DISTINCT * FROM mx) GROUP BY domain),
resolved AS (SELECT domain, hosts IS NOT NULL OR (code IS NULL AND a IS NOT NULL) AS mx_found, coalesce(hosts, CASE WHEN code IS NULL AND a IS NOT NULL THEN domain END, '') AS mx_hosts,
   CASE WHEN hosts IS NULL AND code IS NOT NULL THEN concat('DNS lookup failed (', code, ').') END AS mx_error
  FROM (SELECT DISTINCT domain FROM checked WHERE valid) LEFT JOIN hosts USING (domain) LEFT JOIN (SELECT domain, min(ip) AS a FROM a_records GROUP BY 1) USING (domain)
  LEFT JOIN (SELECT domain, min(code) AS code FROM dns_errors WHERE code NOT IN ('ENODATA', 'ENOTFOUND') GROUP BY 1) USING (domain))"""


@query("WITH " + ADDR_CTE + "," + MX_CTE + " SELECT * FROM resolved")
def mail_hosts(spark, sf):
    valid = verify.check_syntax(_addresses(spark, sf)).filter("valid").select("domain")
    return verify.resolve_mx(valid, *_lookups(spark, sf)).withColumn("mx_hosts", F.array_join("mx_hosts", "|"))


_M = "length(email) % 7"
_SESSION = f"""SELECT email, CASE WHEN {_M} = 6 THEN 500 WHEN {_M} IN (4, 5) THEN NULL ELSE 250 END AS ehlo, CASE WHEN {_M} = 6 THEN 501 END AS helo, CASE WHEN {_M} < 4 THEN 250 END AS mail_from,
  CASE {_M} WHEN 0 THEN 250 WHEN 1 THEN 251 WHEN 2 THEN 550 WHEN 3 THEN 451 END AS rcpt, CASE {_M} WHEN 0 THEN 250 WHEN 1 THEN 550 END AS control,
  CASE {_M} WHEN 4 THEN 'ECONNREFUSED' WHEN 5 THEN 'ETIMEDOUT' END AS err, concat('line one of ', email, chr(13), chr(10), 'line two') AS text"""


def _sessions(spark, sf):
    _addresses(spark, sf).select(F.lower(F.trim("email")).alias("email")).distinct().createOrReplaceTempView("lookup_addresses")
    return spark.sql(_SESSION + " FROM lookup_addresses")


_PM = fv.PROBE_MESSAGES
PROBE_CTE = f"""probe AS (SELECT email, CASE {_M} WHEN 0 THEN 'catch_all' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' WHEN 3 THEN 'greylisted' ELSE 'blocked' END AS outcome,
  CASE {_M} WHEN 0 THEN {st.q(_PM['catch_all'])} WHEN 4 THEN {st.q(_PM['refused'])} WHEN 5 THEN {st.q(_PM['timeout'])} WHEN 6 THEN {st.q(_PM['handshake'])} ELSE left(concat('line one of ', email), 200) END AS message FROM raw)"""


@query("WITH " + ADDR_CTE + "," + PROBE_CTE + " SELECT * FROM probe")
def probe_outcomes(spark, sf):
    return verify.probe_outcome(_sessions(spark, sf))


VERIFY_CTE = ",".join([ADDR_CTE, FLAG_CTE, MX_CTE, PROBE_CTE, """
staged AS (SELECT f.*, coalesce(mx_found, false) AS found, coalesce(mx_hosts, '') AS hosts, mx_error, CASE WHEN valid AND coalesce(mx_found, false) AND NOT disposable THEN p.outcome ELSE 'skipped' END AS outcome,
   CASE WHEN valid AND coalesce(mx_found, false) THEN CASE WHEN disposable THEN 'SMTP check was skipped.' ELSE p.message END END AS message
   FROM flags f LEFT JOIN resolved r ON f.domain = r.domain AND f.valid JOIN probe p ON f.email = p.email),
scored AS (SELECT *, 55 + CASE outcome WHEN 'accepted' THEN 37 WHEN 'catch_all' THEN 5 WHEN 'greylisted' THEN 8 ELSE 12 END - CASE WHEN role THEN 12 ELSE 0 END - CASE WHEN webmail THEN 2 ELSE 0 END AS points,
   suggestion IS NOT NULL AND outcome <> 'accepted' AS typo FROM staged),
verified AS (SELECT *, CASE WHEN NOT valid THEN 0 WHEN NOT found THEN 2 WHEN disposable THEN 12 WHEN outcome = 'rejected' THEN 4 ELSE greatest(5, least(99, CASE WHEN typo THEN least(points, 40) ELSE points END)) END AS score,
   CASE WHEN NOT valid OR NOT found THEN 'invalid' WHEN disposable THEN 'risky' WHEN outcome = 'rejected' THEN 'invalid' WHEN typo THEN 'risky' WHEN outcome = 'accepted' THEN CASE WHEN role THEN 'risky' ELSE 'valid' END
        WHEN outcome = 'catch_all' THEN 'risky' ELSE 'unknown' END AS verdict FROM scored)"""])


def _verified(spark, sf):
    return verify.verify_emails(_addresses(spark, sf), *_lookups(spark, sf), _sessions(spark, sf))


@query("WITH " + VERIFY_CTE + f""" SELECT email, domain, verdict, score, valid, suggestion, webmail, disposable, role, professional, found AS mx_found, hosts AS mx_hosts, mx_error, outcome, message,
  CASE verdict {' '.join(f"WHEN '{k}' THEN {st.q(v)}" for k, v in fv.SUMMARIES.items())} END AS summary FROM verified""")
def verified_emails(spark, sf):
    v = _verified(spark, sf).withColumn("mx_hosts", F.array_join("mx_hosts", "|"))
    return v.select("email", "domain", "verdict", "score", "valid", "suggestion", "webmail", "disposable", "role", "professional", "mx_found", "mx_hosts", "mx_error", "outcome", "message", "summary")


_CT = {k: st.q(v) for k, v in fv.CHECK_TEXT.items()}
_SKIP = lambda why: f"struct_pack(status := 'Not checked', state := 'unknown', detail := {why})"


@query("WITH " + VERIFY_CTE + f""", checks AS (SELECT email, unnest(['format', 'type', 'server', 'smtp']) AS id, unnest([
   CASE WHEN NOT valid THEN struct_pack(status := 'Invalid', state := 'invalid', detail := reason) WHEN suggestion IS NOT NULL THEN struct_pack(status := 'Possible typo', state := 'warning', detail := concat({_CT['format_typo_prefix']}, suggestion, '?'))
     ELSE struct_pack(status := 'Valid', state := 'valid', detail := {_CT['format_ok']}) END,
   CASE WHEN NOT valid THEN {_SKIP(_CT['skip_malformed'])} WHEN disposable THEN struct_pack(status := 'Disposable', state := 'invalid', detail := {_CT['type_disposable']}) WHEN role THEN struct_pack(status := 'Role-based', state := 'warning', detail := {_CT['type_role']})
     WHEN webmail THEN struct_pack(status := 'Webmail', state := 'warning', detail := {_CT['type_webmail']}) ELSE struct_pack(status := 'Professional', state := 'valid', detail := {_CT['type_professional']}) END,
   CASE WHEN NOT valid THEN {_SKIP(_CT['skip_malformed'])} WHEN found THEN struct_pack(status := 'Valid', state := 'valid', detail := concat({_CT['mx_prefix']}, domain, {_CT['mx_suffix']}))
     ELSE struct_pack(status := 'Invalid', state := 'invalid', detail := coalesce(mx_error, concat({_CT['no_mx_prefix']}, domain, {_CT['no_mx_suffix']}))) END,
   CASE WHEN NOT valid THEN {_SKIP(_CT['skip_malformed'])} WHEN NOT found THEN {_SKIP(_CT['skip_no_mx'])}
     {' '.join(f"WHEN outcome = '{k}' THEN struct_pack(status := {st.q(s)}, state := {st.q(t)}, detail := {st.q(d) if d else 'message'})" for k, (s, t, d) in fv.SMTP_STATUS.items())} END]) AS c FROM verified)
  SELECT email, id, c.status, c.state, c.detail FROM checks""")
def verification_checks(spark, sf):
    v = _verified(spark, sf).select("email", F.explode("checks").alias("c"))
    return v.select("email", "c.id", "c.status", "c.state", "c.detail")


# ------------------------------------------------------------------------------ recipient lists
LIST_SIZE = 500
_CELL = _case("c_custkey", [
    f"concat('user', {K}, '@shop.org')", f"concat(' User', {K}, '@Shop.org ')", "concat('user', CAST(c_custkey - 2 AS STRING), '@shop.org')", f"concat('not-an-email ', {K})", f"concat('m', {K}, '@mail', CAST(c_custkey % 5 AS STRING), '.example.com')",
])
_LINE = f"concat({_CELL}, ',\"', replace(c_name, '#', ', \"\"#'), '\",', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END)"


def _list_texts(spark, sf):
    """One text per five hundred customers: a list is bounded by the tool's upload limit."""
    c = table(spark, sf, "customer").select((F.col("c_custkey") / LIST_SIZE).cast("bigint").alias("n"), "c_custkey", F.expr(_LINE).alias("line"))
    lines = c.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("ls"))
    return lines.select(
        F.concat(F.lit("list-"), F.col("n")).alias("list_id"),
        F.concat(F.lit("Contact Email,name,segment\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"),
    )


LIST_CTE = rf"""cells AS (SELECT concat('list-', CAST(c_custkey // {LIST_SIZE} AS VARCHAR)) AS list_id, row_number() OVER (PARTITION BY c_custkey // {LIST_SIZE} ORDER BY c_custkey) AS "row",
   {_CELL} AS cell, replace(c_name, '#', ', "#') AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer),
parsed AS (SELECT *, lower(trim(cell)) AS email, regexp_matches(lower(trim(cell)), {st.q(fv.MAILBOX)}) AS ok, concat('name=', name, CASE WHEN segment <> '' THEN concat('|segment=', segment) ELSE '' END) AS fields FROM cells),
recipients AS (SELECT list_id, email, min("row") AS "row", arg_min(fields, "row") AS fields, count(*) AS copies FROM parsed WHERE ok GROUP BY 1, 2)"""
_flat = lambda df: df.withColumn("fields", F.array_join(F.transform("fields", lambda f: F.concat(f["k"], F.lit("="), f["v"])), "|"))
_as_big = lambda df: df.withColumn("row", F.col("row").cast("bigint"))


def _parsed(spark, sf):
    return ca.parse_recipients(readers.split_lists(_list_texts(spark, sf)))


@query("WITH " + LIST_CTE + ' SELECT list_id, "row", email, fields FROM recipients')
def parsed_recipients(spark, sf):
    return _as_big(_flat(_parsed(spark, sf)[0]))


@query("WITH " + LIST_CTE + """ SELECT list_id, "row", left(concat(cell, ', ', name, ', ', segment), 80) AS value FROM parsed WHERE NOT ok""")
def invalid_recipients(spark, sf):
    return _as_big(_parsed(spark, sf)[1])


@query("WITH " + LIST_CTE + """ SELECT list_id, count(DISTINCT email) FILTER (ok) AS recipients, count(*) FILTER (ok) - count(DISTINCT email) FILTER (ok) AS duplicates, count(*) FILTER (NOT ok) AS invalid FROM parsed GROUP BY list_id""")
def list_stats(spark, sf):
    return _parsed(spark, sf)[2]


@query("WITH " + LIST_CTE + """ SELECT email, arg_min(list_id, list_id || lpad(CAST("row" AS VARCHAR), 9, '0')) AS list_id, arg_min("row", list_id || lpad(CAST("row" AS VARCHAR), 9, '0')) AS "row" FROM recipients GROUP BY email""")
def merged_recipients(spark, sf):
    return _as_big(ca.merge_recipients(_parsed(spark, sf)[0]).select("email", "list_id", "row"))


@query("WITH " + LIST_CTE + ' SELECT list_id, "row", email FROM recipients')
def list_files_round_trip(spark, sf):
    """Lists written as text files, read back as files and parsed."""
    folder = shared_folder(spark, "lists")
    _list_texts(spark, sf).select("list_id", "text").write.partitionBy("list_id").option("lineSep", "\x00").text(folder)
    files = readers.read_list_files(spark, f"{folder}/*/*.txt")
    back = files.select(F.regexp_replace("text", "\x00", "").alias("text"))
    named = back.withColumn("list_id", F.concat(F.lit("list-"), (F.regexp_extract("text", r"Customer, \"\"#0*(\d+)", 1).cast("bigint") / LIST_SIZE).cast("bigint")))
    return _as_big(ca.parse_recipients(readers.split_lists(named))[0].select("list_id", "row", "email"))


_FILE = "c_custkey % 5"
#: Layouts of list files: commas with a header and line ends in quotes, tabs, semicolons, no header, one address a line.
_LAYOUT_LINE = (
    f"CASE {_FILE} WHEN 0 THEN concat({_CELL}, ',\"', replace(c_name, '#', ',' || chr(10) || '\"\"#'), '\",', c_mktsegment) WHEN 1 THEN concat(c_mktsegment, chr(9), c_name, chr(9), {_CELL})"
    f" WHEN 2 THEN concat(c_name, ';', {_CELL}, ';') WHEN 3 THEN concat(c_name, ',', {_CELL}) ELSE concat('u', CAST(c_custkey AS STRING), '@loose.org') END"
)
_LAYOUT_HEAD = "CASE file WHEN 0 THEN 'E-Mail,name,segment' || chr(10) WHEN 1 THEN concat('segment', chr(9), 'name', chr(9), 'Your mail') || chr(10) WHEN 2 THEN 'who;contact;' || chr(10) || chr(10) ELSE '' END"
_LAYOUT_FIELDS = (
    "CASE file WHEN 0 THEN concat('name=', replace(c_name, '#', ',' || chr(10) || '\"#'), '|segment=', c_mktsegment) WHEN 1 THEN concat('segment=', c_mktsegment, '|name=', c_name)"
    " WHEN 2 THEN concat('who=', c_name) WHEN 3 THEN concat('column_1=', c_name) ELSE '' END"
)


@query(f"""WITH lines AS (SELECT {_FILE} AS file, c_name, c_mktsegment, CASE WHEN {_FILE} = 4 THEN concat('u', CAST(c_custkey AS VARCHAR), '@loose.org') ELSE {_CELL} END AS cell,
    row_number() OVER (PARTITION BY {_FILE} ORDER BY c_custkey) AS "row" FROM customer),
 parsed AS (SELECT *, lower(trim(cell)) AS email, {_LAYOUT_FIELDS} AS fields FROM lines)
 SELECT CAST(file AS VARCHAR) AS list_id, email, min("row") AS "row", arg_min(fields, "row") AS fields FROM parsed WHERE regexp_matches(email, {st.q(fv.MAILBOX)}) GROUP BY file, email""")
def list_file_layouts(spark, sf):
    """One large list file of each layout, read line by line by many tasks."""
    folder = shared_folder(spark, "list-layouts")
    c = table(spark, sf, "customer").select("c_custkey", F.expr(_FILE).alias("file"), F.expr(_LAYOUT_LINE).alias("line"))
    texts = c.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    texts.select(F.col("file").alias("list_id"), F.concat(F.expr(_LAYOUT_HEAD), "body").alias("text")).write.partitionBy("list_id").text(folder)
    return _as_big(_flat(ca.parse_records(readers.read_list_records(spark, folder))[0]))


@query(r"""SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY n) - 1 AS "row", tok AS email FROM (
   SELECT c_custkey, unnest(ts) AS tok, generate_subscripts(ts, 1) AS n FROM (SELECT c_custkey, [concat('a', CAST(c_custkey AS VARCHAR), '@x.org'), 'b@y.org', concat('c', CAST(c_custkey AS VARCHAR), '@z.org')] AS ts FROM customer))""")
def pasted_lists(spark, sf):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit(" a"), k, F.lit("@x.org b@y.org\nc"), k, F.lit("@z.org "))
    rows = readers.split_lists(table(spark, sf, "customer").select(F.col("c_custkey").alias("list_id"), text.alias("text")))
    return rows.select(F.col("list_id").alias("c_custkey"), F.posexplode("rows").alias("row", "r")).select("c_custkey", F.col("row").cast("bigint").alias("row"), F.get("r", F.lit(0)).alias("email"))


@query(r"""SELECT c_custkey, ord, url, regexp_matches(url, '(?i)^(?:https?://)?(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost)(?::\d+)?(?:/?|[/?]\S+)$') AS valid FROM (
   SELECT c_custkey, unnest([concat('shop', CAST(c_custkey AS VARCHAR), '.example.com'), 'http://localhost:3000/x', 'not a url', concat('https://a.b-', CAST(c_custkey AS VARCHAR), '.org/p?q')]) AS url, unnest([0, 1, 2, 3]) AS ord FROM customer)""")
def pasted_urls(spark, sf):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit(" shop"), k, F.lit(".example.com,http://localhost:3000/x\n\nnot a url\nhttps://a.b-"), k, F.lit(".org/p?q , http://localhost:3000/x"))
    u = readers.url_list(table(spark, sf, "customer").select(F.col("c_custkey").alias("list_id"), text.alias("text")), finder=True)
    return u.select(F.col("list_id").alias("c_custkey"), "ord", "url", "valid")


# ------------------------------------------------------------------------------ campaigns
TEMPLATE = ca.Template("Hi {{ Name }}, news for {{segment|you}}", "<p>Dear {{name|friend}} &amp; co</p><p>{{email}} {{Missing-Tag|none}} {{unsubscribe_url}}</p>", "https://x.example.com/u?a=1&b=2")


def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace({x}, chr(39), '&#39;')"


@query("WITH " + LIST_CTE + f""", f AS (SELECT *, regexp_extract(fields, '^name=([^|]*)', 1) AS name, regexp_extract(fields, 'segment=(.*)$', 1) AS seg FROM recipients)
  SELECT list_id, email, concat('Hi ', name, ', news for ', CASE WHEN seg = '' THEN 'you' ELSE seg END) AS subject,
   concat('<p>Dear ', {_esc('name')}, ' &amp; co</p><p>', email, ' none https://x.example.com/u?a=1&amp;b=2</p>') AS html,
   concat('Dear ', name, ' & co', chr(10), email, ' none https://x.example.com/u?a=1&b=2') AS text FROM f""")
def rendered_messages(spark, sf):
    return ca.render_messages(_parsed(spark, sf)[0], TEMPLATE).select("list_id", "email", "subject", "html", "text")


@query("SELECT unnest(['email', 'name', 'segment']) AS tag FROM (SELECT count(*) AS n FROM customer) WHERE n > 0")
def merge_tags(spark, sf):
    return ca.available_tags(ca.merge_recipients(_parsed(spark, sf)[0]))


@query("SELECT 'missing-tag' AS tag, 3 AS ord FROM (SELECT count(*) AS n FROM customer) WHERE n > 0")
def unresolved_tags(spark, sf):
    return ca.unresolved_tags(TEMPLATE, ca.merge_recipients(_parsed(spark, sf)[0])).select("tag", F.col("ord"))


_CAMPAIGN = "c_custkey % 7"
PLAN_CTE = f"""plan AS (SELECT campaign_id, email, k, (k - floor(k / 50)) * 2.0 + floor(k / 50) * 60.0 AS planned_offset_s FROM (
   SELECT {_CAMPAIGN} AS campaign_id, concat('u', {K}, '@shop.org') AS email, row_number() OVER (PARTITION BY {_CAMPAIGN} ORDER BY c_custkey) - 1 AS k FROM customer))"""


def _campaign_recipients(spark, sf):
    return table(spark, sf, "customer").select(
        F.expr(_CAMPAIGN).alias("campaign_id"), F.expr(f"concat('u', {K}, '@shop.org')").alias("email"), F.col("c_custkey").alias("row"),
        F.array(F.struct(F.lit("Name").alias("k"), F.col("c_name").alias("v"))).alias("fields"))


@query("WITH " + PLAN_CTE + " SELECT campaign_id, email, k, CAST(planned_offset_s AS DOUBLE) AS planned_offset_s FROM plan")
def send_plan(spark, sf):
    p = ca.plan_sends(_campaign_recipients(spark, sf))
    return p.select("campaign_id", "email", F.col("k").cast("bigint").alias("k"), "planned_offset_s")


@query("WITH " + PLAN_CTE + f" SELECT campaign_id, email, CASE WHEN planned_offset_s >= 300 THEN 'skipped' ELSE 'sent' END AS state, CASE WHEN planned_offset_s >= 300 THEN {st.q(fv.CANCELLED_NOTE)} END AS message FROM plan")
def cancelled_plan(spark, sf):
    return ca.apply_cancel(ca.plan_sends(_campaign_recipients(spark, sf)), 300.0).select("campaign_id", "email", "state", "message")


@query("WITH " + PLAN_CTE + f" SELECT campaign_id, email, concat('Hi Customer#', lpad(regexp_extract(email, '[0-9]+'), 9, '0'), ', news for you') AS subject, 'sent' AS state, {st.q(fv.DRY_RUN_NOTE)} AS message FROM plan")
def campaign_dry_run(spark, sf):
    return ca.dry_run(_campaign_recipients(spark, sf), TEMPLATE).select("campaign_id", "email", "subject", "state", "message")


_STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'sent' END"
_CODE = _case("event_id", ["'EAUTH'", "'ETIMEDOUT'", "'550'", "CAST(NULL AS STRING)", "'EENVELOPE'", "'ENOTFOUND'"])
_DELIVERY = f"SELECT event_id AS delivery_id, user_id % 10 AS campaign_id, ts AS \"at\", {_STATE} AS state, {_CODE} AS code, concat('550 box ', CAST(event_id % 3 AS STRING), chr(10), 'more') AS response, CASE WHEN event_id % 2 = 1 THEN 'Boom' END AS message FROM events"


def deliveries(spark, sf, events=None):
    e = events if events is not None else table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("delivery_id"), (F.col("user_id") % 10).alias("campaign_id"), F.col("ts").alias("at"), F.expr(_STATE).alias("state"), F.expr(_CODE).alias("code"),
        F.expr("concat('550 box ', CAST(event_id % 3 AS STRING), chr(10), 'more')").alias("response"), F.expr("CASE WHEN event_id % 2 = 1 THEN 'Boom' END").alias("message"))


SUMMARY_SQL = f"""SELECT campaign_id, total, sent, failed, skipped, total - sent - failed - skipped AS pending, CAST(floor(sent * 100.0 / (sent + failed) + 0.5) AS BIGINT) AS delivered_pct, CAST(floor(failed * 100.0 / (sent + failed) + 0.5) AS BIGINT) AS failed_pct FROM (
   SELECT campaign_id, count(*) + 5 AS total, count(*) FILTER (state = 'sent') AS sent, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped FROM ({_DELIVERY}) GROUP BY 1)"""


@query(SUMMARY_SQL)
def campaign_summary(spark, sf):
    d = deliveries(spark, sf)
    return ca.campaign_summary(d, d.groupBy("campaign_id").agg((F.count("*") + 5).alias("total")))


@query(f"""SELECT campaign_id, code, CASE code WHEN 'EAUTH' THEN concat({st.q(fv.DELIVERY_REASONS['EAUTH'])}, line) WHEN 'ETIMEDOUT' THEN {st.q(fv.DELIVERY_REASONS['ETIMEDOUT'])} WHEN 'ENOTFOUND' THEN {st.q(fv.DELIVERY_REASONS['ENOTFOUND'])}
   WHEN 'EENVELOPE' THEN concat({st.q(fv.DELIVERY_REASONS['EENVELOPE'])}, line) WHEN '550' THEN concat('SMTP 550: ', line) ELSE coalesce(message, 'Unknown SMTP error.') END AS reason, count(*) AS failures
  FROM (SELECT *, split_part(response, chr(10), 1) AS line FROM ({_DELIVERY})) WHERE state = 'failed' GROUP BY 1, 2, 3""")
def failure_breakdown(spark, sf):
    return ca.failure_breakdown(deliveries(spark, sf))


@query(f"""SELECT campaign_id, delivery_id, state, rank FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY "at" DESC, delivery_id DESC) AS rank FROM ({_DELIVERY})) WHERE rank <= 200""")
def activity_log(spark, sf):
    return ca.activity_log(deliveries(spark, sf)).select("campaign_id", "delivery_id", "state", F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT campaign_id, CASE WHEN campaign_id % 3 = 0 THEN 0 ELSE n * 3 + (n // 50) * 60 END AS eta_server, CAST((n - 1) * 2 + greatest(0, n // 50 - CASE WHEN n % 50 = 0 THEN 1 ELSE 0 END) * 60 + n AS DOUBLE) AS eta_form,
   CASE WHEN f < 60 THEN concat(CAST(f AS VARCHAR), 's') WHEN f // 60 < 60 AND f % 60 > 0 THEN concat(CAST(f // 60 AS VARCHAR), 'm ', CAST(f % 60 AS VARCHAR), 's') WHEN f // 60 < 60 THEN concat(CAST(f // 60 AS VARCHAR), 'm')
        ELSE concat(CAST(f // 3600 AS VARCHAR), 'h ', CAST(f // 60 % 60 AS VARCHAR), 'm') END AS shown FROM (
   SELECT *, (n - 1) * 2 + greatest(0, n // 50 - CASE WHEN n % 50 = 0 THEN 1 ELSE 0 END) * 60 + n AS f FROM (SELECT user_id AS campaign_id, count(*) AS n FROM events GROUP BY 1))""")
def campaign_eta(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("campaign_id")).agg(F.count("*").alias("n"))
    form = ca.form_eta(F.col("n"), 2, 50, 60)
    return n.select("campaign_id", ca.server_eta(F.col("n"), F.col("campaign_id") % 3 == 0, 2, 50, 60).alias("eta_server"), form.alias("eta_form"), ca.format_duration(form.cast("bigint")).alias("shown"))


_DRAFT = "SELECT c_custkey, c_custkey % 4 * 2000 AS recipients, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS subject, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'x' END AS html, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'bad' ELSE 'a@b.org' END AS from_email, CASE WHEN c_custkey % 7 = 0 THEN 'nope' END AS reply_to, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'smtp' END AS host, CAST(c_custkey % 9 * 10000 AS INT) AS port, c_custkey % 2 = 0 AS dry_run"


@query(f"""SELECT c_custkey, concat(CASE WHEN recipients = 0 THEN 'Add recipients in step 1.|' ELSE '' END, CASE WHEN trim(subject) = '' THEN 'Write a subject line in step 2.|' ELSE '' END, CASE WHEN html = '' THEN 'Write an email body in step 2.|' ELSE '' END,
   CASE WHEN from_email = '' THEN 'Set the “From” email in step 3.|' ELSE '' END, CASE WHEN NOT dry_run AND host = '' THEN 'Set the SMTP host in step 3.|' ELSE '' END) AS blockers,
   concat(CASE WHEN recipients > 5000 THEN concat('This tool sends up to 5000 recipients per campaign (got ', CAST(recipients AS VARCHAR), ').|') ELSE '' END, CASE WHEN from_email <> 'a@b.org' THEN 'A valid “From” email address is required.|' ELSE '' END,
   CASE WHEN reply_to IS NOT NULL THEN 'The reply-to address is not a valid email.|' ELSE '' END, CASE WHEN NOT dry_run AND (port < 1 OR port > 65535) THEN 'The SMTP port must be a number between 1 and 65535.|' ELSE '' END) AS route_errors FROM ({_DRAFT} FROM customer)""")
def campaign_readiness(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("lookup_customer")
    r = ca.campaign_readiness(spark.sql(_DRAFT + " FROM lookup_customer"))
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit("|"))), "")
    return r.select("c_custkey", lines("blockers").alias("blockers"), lines("route_errors").alias("route_errors"))


_STATUS = "SELECT user_id AS campaign_id, CASE WHEN user_id % 4 > 0 THEN max(ts) END AS finished_at FROM {} GROUP BY user_id"


@query(f"""WITH s AS ({_STATUS.format('events')}), live AS (SELECT * FROM s WHERE finished_at IS NULL OR finished_at >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
  r AS (SELECT count(*) AS n FROM live WHERE finished_at IS NULL)
  SELECT campaign_id FROM live WHERE finished_at IS NULL UNION ALL SELECT campaign_id FROM (SELECT campaign_id, row_number() OVER (ORDER BY finished_at DESC, campaign_id) AS k FROM live WHERE finished_at IS NOT NULL), r WHERE k <= greatest(0, 50 - n)""")
def retained_campaigns(spark, sf):
    e = table(spark, sf, "events")
    e.createOrReplaceTempView("lookup_events")
    now = e.agg(F.max("ts").alias("t")).first()["t"]
    return ca.retained_campaigns(spark.sql(_STATUS.format("lookup_events")), F.lit(now)).select("campaign_id")


# ------------------------------------------------------------------------------ charts, robots, fetch logs
@query("""WITH c AS (SELECT p_brand AS label, count(*) AS value FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS k, count(*) OVER () AS n FROM c),
  s AS (SELECT CASE WHEN n > 6 AND k >= 6 THEN concat('Other (', CAST(n - 5 AS VARCHAR), ')') ELSE label END AS label, CAST(sum(value) AS BIGINT) AS value, min(k) AS k FROM r GROUP BY 1),
  w AS (SELECT label, value, k - 1 AS rank, value * 100 // t AS whole, value * 100 % t AS rest FROM s, (SELECT CAST(sum(value) AS BIGINT) AS t FROM s))
  SELECT label, value, rank, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, rank) <= 100 - sum(whole) OVER () THEN 1 ELSE 0 END AS percent FROM w""")
def brand_breakdown(spark, sf):
    counts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("value"))
    return breakdown(counts).select("label", "value", F.col("rank").cast("bigint").alias("rank"), F.col("percent").cast("bigint").alias("percent"))


@query("SELECT concat('shop', CAST(s_suppkey AS VARCHAR), '.org') AS domain, CASE WHEN s_suppkey % 3 = 0 THEN concat('robots.txt may restrict crawl on https://shop', CAST(s_suppkey AS VARCHAR), '.org') END AS warning FROM supplier")
def robots_warnings(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("shop"), "s_suppkey", F.lit(".org")).alias("domain"), "s_suppkey")
    robots = s.filter(F.col("s_suppkey") % 4 != 1).select("domain", F.when(F.col("s_suppkey") % 3 == 0, "User-agent: *\nDisallow: /private").otherwise("User-agent: *\nDisallow:").alias("text"))
    extra = s.filter((F.col("s_suppkey") % 3 == 0) & (F.col("s_suppkey") % 4 == 1)).select("domain", F.lit("Disallow: /").alias("text"))
    all_sites = s.select("domain", F.concat(F.lit("https://"), "domain").alias("url"))
    return page_facts.robots_warnings(all_sites, robots.unionByName(extra)).select("domain", "warning")


_HTTP = _case("event_id", ["200", "404", "500", "429", "503", "403", "301"])


@query(f"""WITH a AS (SELECT user_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, {_HTTP} AS status FROM events), t AS (SELECT * FROM a WHERE attempt <= 3),
  d AS (SELECT url, min(attempt) AS k FROM t WHERE status BETWEEN 200 AND 299 OR status IN (403, 404, 410) GROUP BY 1)
  SELECT url, CASE WHEN status BETWEEN 200 AND 299 THEN 'fetched' ELSE 'failed' END AS outcome, status, coalesce(k, m) AS attempts FROM (SELECT url, max(attempt) AS m FROM t GROUP BY 1) LEFT JOIN d USING (url) LEFT JOIN (SELECT url, attempt AS k, status FROM t) USING (url, k)""")
def fetch_outcomes(spark, sf):
    from pyspark.sql import Window as W

    e = table(spark, sf, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    log = e.select(F.col("user_id").alias("url"), n.alias("attempt"), F.expr(_HTTP).alias("status"), F.col("ts").alias("at"))
    return page_facts.resolve_fetch_log(log).select("url", "outcome", "status", F.col("attempts").cast("bigint").alias("attempts"))


#: Addresses of customers: house numbers, suites and cities that lie inside one another, half of them of one nation.
_HOME = """concat(CASE WHEN c_custkey % 4 = 0 THEN 'Address: ' ELSE '' END, CAST(c_custkey % 997 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN ' Main Street' ELSE ' Mill  Lane' END,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(', Suite ', CAST(c_custkey % 23 AS STRING)) END, CASE WHEN c_custkey % 7 < 3 THEN ', Springfield' WHEN c_custkey % 7 < 5 THEN ' SPRINGFIELD, IL 62704' ELSE '' END)"""
_HOME_GROUP = "CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END"


@query(rf"""WITH homes AS (SELECT {_HOME_GROUP} AS nation, c_custkey, regexp_replace(regexp_replace({_HOME}, '^Address: ', ''), ' +', ' ', 'g') AS address FROM customer),
keyed AS (SELECT nation, key, arg_min(address, lpad(CAST(999 - length(address) AS VARCHAR), 4, '0') || lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS address FROM (
  SELECT *, trim(regexp_replace(lower(address), '[^a-z0-9]+', ' ', 'g')) AS key FROM homes) GROUP BY nation, key)
SELECT nation, address FROM keyed e WHERE NOT EXISTS (SELECT 1 FROM keyed o WHERE o.nation = e.nation AND length(o.key) > length(e.key) AND contains(o.key, e.key))""")
def nation_addresses(spark, sf):
    """Addresses per nation, none inside another."""
    customers = readers.spread(table(spark, sf, "customer"), "c_custkey")
    homes = customers.select(F.expr(_HOME_GROUP).alias("nation"), "c_custkey", F.expr(_HOME).alias("address"))
    return addresses.distinct_addresses(homes, ["nation"], ["c_custkey"])
