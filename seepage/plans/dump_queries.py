"""Dump lines, certificates and rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage import rules as R
from seepage.operators import certs as K
from seepage.operators import dumps as L
from seepage.operators import flat
from seepage.operators.order import placed
from seepage.operators import roster as M
from seepage.plans import duck as D
from seepage.plans.registry import query

CORP = "corp1.example.com"
SALT = "check-salt"
AS_OF = "1998-06-01T00:00:00"

FOUND = (
    "(SELECT source_file, line, lower(n) AS name, lower(r) AS rest FROM (SELECT source_file, line,"
    " unnest(regexp_extract_all(line, '\\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9._-]+)', 1)) AS n,"
    " unnest(regexp_extract_all(line, '\\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9._-]+)', 2)) AS r FROM dump_lines))"
)
WATCHED = (
    f"(SELECT name || '@' || domain AS email, domain AS watched_domain, source_file, line FROM {FOUND} JOIN corp_domains"
    " ON rest = domain OR starts_with(rest, domain || '.') OR starts_with(rest, domain || '-'))"
)
SHORT = "CASE WHEN length(line) > 200 THEN substr(line, 1, 200) || '...' ELSE line END"
EMAILS_SQL = (
    f"SELECT email, watched_domain, source_file, {D.masked(SHORT)} AS line_content FROM {WATCHED} WHERE {D.valid_email('email')}"
    " QUALIFY row_number() OVER (PARTITION BY email ORDER BY source_file, line) = 1"
)


@query("dump_emails", EMAILS_SQL, ("dump_lines", "corp_domains"))
def dump_emails(t):
    return L.dump_emails(t.dump_lines, t.corp_domains)


def _kind(v: str) -> str:
    return (
        f"CASE WHEN {v} = '' THEN 'plaintext' "
        + " ".join(f"WHEN regexp_matches({v}, {D.q(p)}) THEN '{k}'" for k, p in R.DIGEST_PATTERNS)
        + f" WHEN starts_with({v}, '$') THEN 'hashed' WHEN length({v}) > 50 THEN 'likely_hash' ELSE 'plaintext' END"
    )


PAIRS = " UNION ALL ".join(
    f"SELECT source_file, line, unnest(regexp_extract_all(line, {D.q(p)}, 1)) AS e, unnest(regexp_extract_all(line, {D.q(p)}, 2)) AS v"
    " FROM dump_lines"
    for _, p in R.CREDENTIAL_PAIRS
)
CREDENTIALS_SQL = (
    f"SELECT lower(e) AS email, {_kind('v')} AS password_hash_type, CAST(length(v) AS INTEGER) AS password_length,"
    f" sha256('{SALT}' || v) AS fingerprint, source_file FROM ({PAIRS}) WHERE {D.valid_email('e')} AND contains(lower(e), '{CORP}')"
    " QUALIFY row_number() OVER (PARTITION BY lower(e), v ORDER BY source_file, sha256(line)) = 1"
)


def credentials(t):
    return L.credential_exposure(t.dump_lines, CORP, SALT)


@query("credential_exposure", CREDENTIALS_SQL, ("dump_lines",))
def credential_exposure(t):
    return credentials(t)


@query(
    "dump_stats",
    f"""SELECT 'files_processed' AS statistic, count(DISTINCT source_file) AS n FROM dump_lines
 UNION ALL SELECT 'emails_found', count(*) FROM ({EMAILS_SQL}) UNION ALL SELECT 'credentials_found', count(*) FROM ({CREDENTIALS_SQL})""",
    ("dump_lines", "corp_domains"),
)
def dump_stats(t):
    return L.dump_stats(t.dump_lines, t.corp_domains, CORP, SALT)


@query(
    "digest_histogram",
    f"SELECT password_hash_type, count(*) AS n FROM ({CREDENTIALS_SQL}) GROUP BY 1",
    ("dump_lines",),
)
def digest_histogram(t):
    return L.digest_histogram(credentials(t))


# --- certificates

BARE = "regexp_replace(x, '^\\*\\.', '')"
CERTS = f"""(SELECT id, entry_timestamp AS logged_at, not_before, not_after, common_name, issuer_name AS issuer, serial_number,
 'ct_log' AS source, list_sort(list_distinct(list_concat(sans, [common_name]))) AS domains,
 coalesce(try_strptime(not_after, '%Y-%m-%dT%H:%M:%S') < TIMESTAMP '{AS_OF.replace('T', ' ')}', false) AS expired
 FROM (SELECT *, list_filter(list_transform(string_split(name_value, chr(10)), lambda x: trim(x)),
 lambda x: {D.valid_domain(BARE)}) AS sans FROM ct_entries))"""
OF_TARGET = f"list_filter(domains, lambda x: {BARE} = '{CORP}' OR {BARE} LIKE '%.{CORP}')"
UNIQUE = (
    f"(SELECT * FROM {CERTS} QUALIFY serial_number = '' OR row_number() OVER (PARTITION BY serial_number ORDER BY id) = 1)"
)
ACTIVE_UNIQUE = (
    f"(SELECT * FROM {CERTS} WHERE NOT expired QUALIFY serial_number = '' OR"
    " row_number() OVER (PARTITION BY serial_number ORDER BY id) = 1)"
)


def certs(t):
    return K.parse_certificates(t.ct_entries, CORP, AS_OF)


def unique_certs(t):
    return K.certificates(t.ct_entries, CORP, AS_OF, include_expired=True)


@query(
    "cert_domains",
    f"SELECT id, array_to_string(domains, ',') AS domains, array_to_string({OF_TARGET}, ',') AS target_domains FROM {CERTS}",
    ("ct_entries",),
)
def cert_domains(t):
    return certs(t).select(
        "id", F.array_join("domains", ",").alias("domains"), F.array_join("target_domains", ",").alias("target_domains")
    )


@query("ct_active", f"SELECT id, not_after, issuer FROM {CERTS} WHERE NOT expired", ("ct_entries",))
def ct_active(t):
    return K.active(certs(t)).select("id", "not_after", "issuer")


@query("ct_dedupe", f"SELECT id, logged_at, serial_number, issuer, expired FROM {UNIQUE}", ("ct_entries",))
def ct_dedupe(t):
    return unique_certs(t).select("id", "logged_at", "serial_number", "issuer", "expired")


@query(
    "certs_in_order",
    f"SELECT id, logged_at, issuer, row_number() OVER (ORDER BY logged_at DESC NULLS LAST, id) AS place FROM {UNIQUE}",
    ("ct_entries",),
)
def certs_in_order(t):
    """Certificates with their places, newest log time first."""
    certs = unique_certs(t).select("id", "logged_at", "issuer")
    return placed(certs, F.desc_nulls_last("logged_at"), "id")


@query(
    "ct_stats",
    f"""SELECT count(*) AS total_certificates, count(DISTINCT issuer) AS unique_issuers,
 count(*) FILTER (expired) AS expired_certificates,
 (SELECT count(DISTINCT s) FROM (SELECT {BARE} AS s FROM (SELECT unnest({OF_TARGET}) AS x FROM {UNIQUE})) WHERE {D.valid_domain('s')}) AS total_domains
 FROM {UNIQUE}""",
    ("ct_entries",),
)
def ct_stats(t):
    return K.stats(unique_certs(t))


@query("ct_issuers", f"SELECT issuer, count(*) AS certificates FROM {ACTIVE_UNIQUE} GROUP BY 1", ("ct_entries",))
def ct_issuers(t):
    return K.issuers(K.certificates(t.ct_entries, CORP, AS_OF))


@query(
    "ct_subdomains",
    f"SELECT DISTINCT s AS subdomain FROM (SELECT {BARE} AS s FROM (SELECT unnest({OF_TARGET}) AS x FROM {CERTS})) WHERE {D.valid_domain('s')}",
    ("ct_entries",),
)
def ct_subdomains(t):
    return K.subdomains(certs(t))


@query(
    "ct_limit",
    f"SELECT id, not_after, expired FROM (SELECT * FROM {CERTS} ORDER BY id LIMIT 1000) WHERE NOT expired",
    ("ct_entries",),
)
def ct_limit(t):
    first = K.limit_entries(t.ct_entries, 1000, ["id"])
    return K.active(K.parse_certificates(first, CORP, AS_OF)).select("id", "not_after", "expired")


@query(
    "cert_flat",
    f"SELECT id, common_name, issuer, not_before, not_after, expired, array_to_string({OF_TARGET}, ', ') AS domains, source FROM {UNIQUE}",
    ("ct_entries",),
)
def cert_flat(t):
    return K.flat(unique_certs(t))


# --- rosters


@query(
    "roster_users",
    """SELECT c_custkey, 'u' || c_custkey AS username, c_name AS display_name,
 'u' || c_custkey || '@corp' || (c_nationkey % 7) || '.example.com' AS email, '/i/' || c_custkey || '.png' AS profile_image,
 c_custkey % 5 = 0 AS is_admin FROM customer
 UNION ALL SELECT c_custkey, 'bot' || c_nationkey, '', '', '', false FROM customer""",
)
def roster_users(t):
    return M.roster_users(t.rosters, ["c_custkey"], "answer")


NAME_SQL = {
    "{first}.{last}@{domain}": "f || '.' || l || '@' || d", "{first}{last}@{domain}": "f || l || '@' || d",
    "{first}_{last}@{domain}": "f || '_' || l || '@' || d", "{first}@{domain}": "f || '@' || d",
    "{last}@{domain}": "l || '@' || d", "{first}{l}@{domain}": "f || substr(l, 1, 1) || '@' || d",
    "{f}{last}@{domain}": "substr(f, 1, 1) || l || '@' || d",
}
VARIANTS = " UNION ALL ".join(
    f"SELECT first, last, domain, {D.q(k)} AS template, {v} AS email FROM (SELECT *, lower(first) AS f, lower(last) AS l,"
    " lower(domain) AS d FROM people)"
    for k, v in NAME_SQL.items()
)


@query("roster_variants", f"SELECT * FROM ({VARIANTS}) WHERE {D.valid_email('email')}", ("people",))
def roster_variants(t):
    return M.roster_variants(t.people)


def _filled(template: str, **values) -> str:
    for name, value in values.items():
        template = f"replace({template}, chr(123) || '{name}' || chr(125), {value})"
    return template


@query(
    "roster_variants_user",
    f"""SELECT first, last, domain, template, email FROM (SELECT first, last, domain, template,
 {_filled('template', first='lower(first)', last='lower(last)', domain='lower(domain)', f='substr(lower(first), 1, 1)', l='substr(lower(last), 1, 1)')}
 AS email FROM people, (SELECT DISTINCT template FROM mail_templates)) WHERE {D.valid_email('email')}""",
    ("people", "mail_templates"),
)
def roster_variants_user(t):
    """The spellings of a user's own template table, which replaces the built-in list."""
    return M.roster_variants(t.people, t.mail_templates)


@query("dump_emails_flat", f"SELECT email, source_file FROM ({EMAILS_SQL})", ("dump_lines", "corp_domains"))
def dump_emails_flat(t):
    return flat.dump_emails(dump_emails(t))


@query(
    "dump_credentials_flat",
    f"SELECT email, password_hash_type AS password_type, password_length, source_file FROM ({CREDENTIALS_SQL})",
    ("dump_lines",),
)
def dump_credentials_flat(t):
    return flat.dump_credentials(credentials(t))


@query(
    "hosts_flat",
    f"SELECT DISTINCT s AS subdomain FROM (SELECT {BARE} AS s FROM (SELECT unnest({OF_TARGET}) AS x FROM {CERTS})) WHERE {D.valid_domain('s')}",
    ("ct_entries",),
)
def hosts_flat(t):
    return flat.values(K.subdomains(certs(t)), "subdomain", "subdomain")


@query(
    "role_mailboxes",
    " UNION ALL ".join(
        f"SELECT domain, {D.q(x)} AS template, {D.q(x.split('@')[0])} || '@' || domain AS email FROM corp_domains" for x in R.ROLE_TEMPLATES
    ),
    ("corp_domains",),
)
def role_mailboxes(t):
    return M.role_mailboxes(t.corp_domains)


@query(
    "roster_exposed",
    f"SELECT first, last, domain, template, email FROM ({VARIANTS}) WHERE email IN (SELECT lower(address) FROM observed)",
    ("people", "observed"),
)
def roster_exposed(t):
    observed = t.observed.select(F.lower("address").alias("email"))
    return M.exposed(M.roster_variants(t.people), observed).select("first", "last", "domain", "template", "email")
