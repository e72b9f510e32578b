"""Extractors, filters and scalar functions on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import hosts as H
from seepage.functions import text as X
from seepage.operators import pages as G
from seepage.operators import flat
from seepage.operators import scan as S
from seepage.operators import score as C
from seepage.plans import duck as D
from seepage.plans.registry import query

TARGET = "acme.example.com"
CORP = "corp1.example.com"
SALT = "check-salt"


def shown(findings, *keys):
    return findings.select(*keys, "kind", "match_count", F.array_join("sample_matches", " | ").alias("samples"))


@query("sensitive_docs", D.scan("documents", "doc_id", "text", R.DOCUMENT_RULES))
def sensitive_docs(t):
    return shown(S.scan_kinds(t.documents, ["doc_id"], "text", R.DOCUMENT_RULES), "doc_id")


@query("sensitive_docs_planted", D.scan("planted", "doc_id", "text", R.DOCUMENT_RULES), ("planted",))
def sensitive_docs_planted(t):
    return shown(S.scan_kinds(t.planted, ["doc_id"], "text", R.DOCUMENT_RULES), "doc_id")


@query("sensitive_paste", D.scan("pastes", "doc_id", "content", R.PASTE_RULES), ("pastes",))
def sensitive_paste(t):
    return shown(S.scan_kinds(t.pastes, ["doc_id"], "content", R.PASTE_RULES), "doc_id")


@query("secrets_code", D.scan("planted", "doc_id", "text", R.CODE_RULES), ("planted",))
def secrets_code(t):
    return shown(S.scan_kinds(t.planted, ["doc_id"], "text", R.CODE_RULES), "doc_id")


@query(
    "code_emails",
    f"SELECT DISTINCT e AS email FROM (SELECT unnest(regexp_extract_all(text, {D.q(R.EMAIL)})) AS e FROM planted)"
    f" WHERE contains(e, '{CORP}')",
    ("planted",),
)
def code_emails(t):
    found = t.planted.where(F.contains("text", F.lit("@"))).select(F.explode(X.matches("text", R.EMAIL)).alias("email"))
    return found.where(F.contains("email", F.lit(CORP))).distinct()


@query(
    "emails_flat",
    f"SELECT DISTINCT e AS email FROM (SELECT unnest(regexp_extract_all(text, {D.q(R.EMAIL)})) AS e FROM planted)"
    f" WHERE contains(e, '{CORP}')",
    ("planted",),
)
def emails_flat(t):
    return flat.values(code_emails(t), "email", "email")


def _redacted_sql(c: str) -> str:
    for r in R.PASTE_RULES:
        if r.shown != "clear":
            c = f"regexp_replace({c}, {D.q(r.pattern)}, '***REDACTED***', 'g')"
    return c


@query(
    "code_flat",
    f"""SELECT 'repository' AS type, coalesce(full_name, '') AS name, 'https://github.com/' || coalesce(full_name, '') AS url,
 coalesce(description, '') AS description, '' AS details FROM repositories
 UNION ALL SELECT 'code', 'src/' || doc_id || '.py', 'https://github.com/org/repo/blob/main/src/' || doc_id || '.py', 'org/' || source,
 CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '...' ELSE c END FROM (SELECT doc_id, source, {_redacted_sql('text')} AS c FROM planted)""",
    ("repositories", "planted"),
)
def code_flat(t):
    """Repositories and code matches in one flat table, secrets redacted."""
    name = X.or_empty("full_name")
    repositories = t.repositories.select(name.alias("name"), F.concat(F.lit("https://github.com/"), name).alias("url"), "description")
    path = F.concat(F.lit("src/"), "doc_id", F.lit(".py"))
    matches = t.planted.select(
        path.alias("file_path"), F.concat(F.lit("https://github.com/org/repo/blob/main/"), path).alias("url"),
        F.concat(F.lit("org/"), "source").alias("repository"), F.col("text").alias("content"))
    return flat.code(repositories, matches)


@query("chat_tokens", D.scan("planted", "doc_id", "text", R.CHAT_RULES), ("planted",))
def chat_tokens(t):
    return shown(S.scan_kinds(t.planted, ["doc_id"], "text", R.CHAT_RULES), "doc_id")


@query("chat_tokens_conversations", D.scan("planted_chat", "conv_id, turn", "text", R.CHAT_RULES), ("planted_chat",))
def chat_tokens_conversations(t):
    return shown(S.scan_kinds(t.planted_chat, ["conv_id", "turn"], "text", R.CHAT_RULES), "conv_id", "turn")


@query(
    "custom_rules",
    " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, CAST(len(m) AS INTEGER) AS match_count, {D.samples('m', 'masked')} AS samples"
        f" FROM (SELECT doc_id, regexp_extract_all(text, {D.q(p)}) AS m FROM documents) WHERE len(m) > 0"
        for kind, p in (("hex_token", 'token = "[0-9a-f]{40}"'), ("quoted_secret", '[Ss]ecret = "[^"]{10,}"'))
    )
    + " UNION ALL "
    + D.scan("documents", "doc_id", "text", R.CODE_RULES),
)
def custom_rules(t):
    rules = S.rules_from(t.rule_rows, R.CODE_RULES)
    return shown(S.scan_kinds(t.documents, ["doc_id"], "text", rules), "doc_id")


LONG_WORD = "[A-Za-z][a-z][a-z][a-z][a-z][a-z]+"


@query(
    "rule_table_hits",
    "SELECT doc_id, kind, pattern, CAST(len(m) AS INTEGER) AS match_count, " + D.samples("m", "masked") + " AS samples"
    " FROM (SELECT doc_id, kind, pattern, regexp_extract_all(text, pattern) AS m FROM documents JOIN"
    " (SELECT DISTINCT 'word' AS kind, w || '[a-z]*[.,]' AS pattern, w AS hint"
    f" FROM (SELECT lower(unnest(regexp_extract_all(text, '{LONG_WORD}'))) AS w FROM benchmark)"
    " UNION ALL SELECT kind, pattern, NULL FROM rule_rows)"
    " ON hint IS NULL OR contains(lower(text), hint)) WHERE len(m) > 0",
    ("rule_rows",),
)
def rule_table_hits(t):
    """A rule for every long word of the benchmark against all texts, and rules without a hint."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(LONG_WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("w"))
    rules = words.distinct().select(F.lit("word").alias("kind"), F.concat("w", F.lit("[a-z]*[.,]")).alias("pattern"), F.col("w").alias("hint"))
    rules = rules.unionByName(t.rule_rows.select("kind", "pattern", F.lit(None).cast("string").alias("hint")))
    return shown(S.scan_rule_table(t.documents, ["doc_id"], "text", rules), "doc_id", "pattern")


@query("secrets_masked", D.secrets("planted", "doc_id", "text", R.CODE_RULES + R.CHAT_RULES, SALT), ("planted",))
def secrets_masked(t):
    return S.scan_secrets(t.planted, ["doc_id"], "text", R.CODE_RULES + R.CHAT_RULES, SALT)


@query("extract_emails", f"SELECT doc_id, unnest({D.emails('text')}) AS email FROM documents")
def extract_emails(t):
    return t.documents.select("doc_id", F.explode(X.emails("text")).alias("email"))


PHONE_PARTS = ", ".join(f"regexp_extract_all(text, {D.q(R.PHONE)}, {i}) AS p{i}" for i in (1, 2, 3))


@query(
    "extract_phones",
    "SELECT DISTINCT doc_id, '(' || a || ') ' || b || '-' || c AS phone FROM"
    f" (SELECT doc_id, unnest(p1) AS a, unnest(p2) AS b, unnest(p3) AS c FROM (SELECT doc_id, {PHONE_PARTS} FROM documents))",
)
def extract_phones(t):
    return t.documents.select("doc_id", F.explode(X.phones("text")).alias("phone"))


@query(
    "extract_addresses",
    f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {D.q(R.ADDRESS)})) AS address FROM documents",
)
def extract_addresses(t):
    return t.documents.select("doc_id", F.explode(X.addresses("text")).alias("address"))


@query(
    "target_mention_filter",
    f"SELECT doc_id FROM pastes WHERE {D.words('''title || ' ' || content || ' ' || content_preview''', X.mention_keywords(TARGET))}",
    ("pastes",),
)
def target_mention_filter(t):
    return t.pastes.where(X.mentions_target(TARGET, "title", "content", "content_preview")).select("doc_id")


@query(
    "mention_title_snippet",
    f"SELECT hit_id, l_partkey, title, snippet FROM hits WHERE title <> '' AND ({D.words('title', [TARGET, 'slack'])}"
    f" OR {D.words('snippet', [TARGET])})",
    ("hits",),
)
def mention_title_snippet(t):
    return G.mentioned(t.hits.select("hit_id", "l_partkey", "title", "snippet"), TARGET, ("slack",))


EXTENSIONS = "|".join(e.replace(".", r"\.") for e in R.DOCUMENT_EXTENSIONS)


@query(
    "doc_link_filter",
    f"SELECT l_orderkey, l_linenumber, url, regexp_matches(lower(url), {D.q(rf'\.({EXTENSIONS})($|[?#])')}) AS is_strict"
    f" FROM urls WHERE regexp_matches(lower(url), {D.q(EXTENSIONS)})",
    ("urls",),
)
def doc_link_filter(t):
    return t.urls.where(X.is_document_link("url")).select(
        "l_orderkey", "l_linenumber", "url", X.is_document_link("url", strict=True).alias("is_strict")
    )


@query(
    "skip_doc_urls",
    r"SELECT l_orderkey, l_linenumber, url FROM urls WHERE url <> '' AND url NOT LIKE '#%'"
    r" AND NOT regexp_matches(lower(url), '\.(pdf|docx?|xlsx?|pptx?)$')",
    ("urls",),
)
def skip_doc_urls(t):
    return t.urls.where(X.is_readable_url("url")).select("l_orderkey", "l_linenumber", "url")


@query(
    "doc_url_profile",
    f"SELECT l_orderkey, l_linenumber, url, CASE WHEN regexp_matches(lower(url), {D.q(rf'\.({EXTENSIONS})$')})"
    f" THEN regexp_extract(lower(url), {D.q(rf'\.({EXTENSIONS})$')}, 1) ELSE 'unknown' END AS file_type,"
    f" {D.words('title', R.SENSITIVE_TITLE_WORDS)} AS is_sensitive FROM urls",
    ("urls",),
)
def doc_url_profile(t):
    return t.urls.select(
        "l_orderkey", "l_linenumber", "url",
        X.file_type("url").alias("file_type"), X.is_sensitive_title("title").alias("is_sensitive"),
    )


@query(
    "title_risk",
    f"SELECT title, CASE WHEN {D.words('title', R.HIGH_RISK_WORDS)} THEN 'high'"
    f" WHEN {D.words('title', R.MEDIUM_RISK_WORDS)} THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n FROM urls GROUP BY 1, 2",
    ("urls",),
)
def title_risk(t):
    return t.urls.groupBy("title", X.title_risk("title").alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "preview_text",
    "SELECT doc_id, "
    + ", ".join(
        f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END AS first_{n}" for n in (20, 50, 200, 500)
    )
    + " FROM documents",
)
def preview_text(t):
    return t.documents.select("doc_id", *[X.truncate("text", n).alias(f"first_{n}") for n in (20, 50, 200, 500)])


@query(
    "digest_kind",
    "SELECT kind AS digest_kind, count(*) AS n FROM (SELECT CASE WHEN v = '' THEN 'plaintext'"
    + "".join(f" WHEN regexp_matches(v, {D.q(p)}) THEN '{k}'" for k, p in R.DIGEST_PATTERNS)
    + " WHEN starts_with(v, '$') THEN 'hashed' WHEN length(v) > 50 THEN 'likely_hash' ELSE 'plaintext' END AS kind FROM"
    " (SELECT regexp_extract(line, '(?:[:;,|]|' || chr(9) || ')(.*)$', 1) AS v FROM dump_lines)) GROUP BY 1",
    ("dump_lines",),
)
def digest_kind(t):
    second = F.regexp_extract("line", r"(?:[:;,|]|\t)(.*)$", 1)
    return t.dump_lines.groupBy(X.digest_kind(second).alias("digest_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("content_id", "SELECT doc_id, md5(url || title || date) AS content_id FROM pastes", ("pastes",))
def content_id(t):
    return t.pastes.select("doc_id", X.content_id("url", "title", "date").alias("content_id"))


@query(
    "mention_count",
    f"SELECT doc_id, CAST((length(content) - length(replace(lower(content), '{TARGET}', ''))) / {len(TARGET)} AS INTEGER)"
    " AS mentions FROM pastes",
    ("pastes",),
)
def mention_count(t):
    return t.pastes.select("doc_id", X.mention_count("content", F.lit(TARGET)).alias("mentions"))


@query(
    "effective_content",
    "SELECT doc_id, CAST(length(e) AS INTEGER) AS n_chars, md5(e) AS digest FROM (SELECT doc_id,"
    " CASE WHEN length(content_preview) < 100 AND content <> '' THEN content ELSE content_preview END AS e FROM pastes)",
    ("pastes",),
)
def effective_content(t):
    chosen = X.effective_content("content_preview", "content")
    return t.pastes.select("doc_id", F.length(chosen).alias("n_chars"), F.md5(chosen).alias("digest"))


@query(
    "path_issues",
    "SELECT l_orderkey, l_linenumber, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {D.words(f, w)} THEN {D.q(m)} END" for f, w, m in R.PATH_ISSUES)
    + "], lambda x: x IS NOT NULL), '; ') AS issues FROM (SELECT *, regexp_extract(url, 'github\\.com/([^/]+/[^/]+)', 1) AS repository,"
    " regexp_extract(url, '/blob/[^/]+/(.+)$', 1) AS file_path FROM urls)",
    ("urls",),
)
def path_issues(t):
    issues = X.path_issues("title", X.file_path_of("url"), X.repository_of("url"))
    return t.urls.select("l_orderkey", "l_linenumber", F.array_join(issues, "; ").alias("issues"))


@query(
    "code_url_parts",
    "SELECT url, regexp_extract(url, 'github\\.com/([^/]+/[^/]+)', 1) AS repository,"
    " regexp_extract(url, '/blob/[^/]+/(.+)$', 1) AS file_path,"
    " split_part(regexp_extract(url, '/blob/[^/]+/(.+)$', 1), '/', 1) AS first_part, count(*) AS n FROM urls GROUP BY 1, 2, 3, 4",
    ("urls",),
)
def code_url_parts(t):
    parts = t.urls.select("url", X.repository_of("url").alias("repository"), X.file_path_of("url").alias("file_path"))
    return parts.groupBy(
        "url", "repository", "file_path", F.split_part("file_path", F.lit("/"), F.lit(1)).alias("first_part")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_names",
    f"SELECT event_id, regexp_replace(s, '[^a-zA-Z0-9_-]', '', 'g') AS clean FROM (SELECT event_id, {D.strip('name')} AS s FROM names)"
    " WHERE length(s) > 0 AND length(s) < 50 AND regexp_replace(s, '[^a-zA-Z0-9_-]', '', 'g') <> ''",
    ("names",),
)
def clean_names(t):
    return t.names.select("event_id", X.clean_name("name").alias("clean")).where("clean is not null")


@query("clean_domain", f"SELECT l_orderkey, l_linenumber, {D.clean_domain('url')} AS host FROM urls", ("urls",))
def clean_domain(t):
    return t.urls.select("l_orderkey", "l_linenumber", H.clean_domain("url").alias("host"))


@query(
    "domain_filter",
    f"SELECT DISTINCT host FROM (SELECT {D.clean_domain('url')} AS host FROM urls) WHERE host = '{CORP}' OR host LIKE '%.{CORP}'",
    ("urls",),
)
def domain_filter(t):
    hosts = t.urls.select(H.clean_domain("url").alias("host"))
    return hosts.where(H.belongs_to("host", F.lit(CORP))).distinct()


@query("emails_exact_domain", f"SELECT DISTINCT lower(address) AS email FROM observed WHERE lower(address) LIKE '%@{CORP}'", ("observed",))
def emails_exact_domain(t):
    emails = t.observed.select(X.normalise_email("address").alias("email"))
    return emails.where(F.endswith("email", F.lit("@" + CORP))).distinct()


@query(
    "emails_loose_domain",
    "SELECT lower(address) AS email, count(*) AS n FROM observed WHERE contains(lower(address), 'example.com') GROUP BY 1",
    ("observed",),
)
def emails_loose_domain(t):
    emails = t.observed.select(X.normalise_email("address").alias("email"))
    return emails.where(F.contains("email", F.lit("example.com"))).groupBy("email").agg(F.count(F.lit(1)).alias("n"))


@query(
    "validate_hosts",
    f"SELECT url, {D.valid_domain(D.clean_domain('url'))} AS is_domain, {D.valid_url(D.strip('url'))} AS is_url,"
    f" {D.valid_email(D.clean_domain('url'))} AS is_email, count(*) AS n FROM urls GROUP BY 1, 2, 3, 4",
    ("urls",),
)
def validate_hosts(t):
    return t.urls.groupBy(
        "url",
        X.valid_domain(H.clean_domain("url")).alias("is_domain"),
        X.valid_url(X.strip("url")).alias("is_url"),
        X.valid_email(H.clean_domain("url")).alias("is_email"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("url_hosts", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages")
def url_hosts(t):
    return t.pages.select("page_id", H.url_host("url").alias("host"))


@query(
    "risk_score",
    f"SELECT doc_id, risk_score, has_credentials, has_code, target_mentions FROM ({D.scored('pastes', 'doc_id', 'content', TARGET, R.PASTE_RULES)})",
    ("pastes",),
)
def risk_score(t):
    return C.score_content(t.pastes, "content", TARGET).select(
        "doc_id", "risk_score", "has_credentials", "has_code", "target_mentions"
    )


UNIQUE_PASTES = (
    "(SELECT *, md5(url || title || date) AS content_id FROM pastes"
    " QUALIFY row_number() OVER (PARTITION BY md5(url || title || date) ORDER BY doc_id) = 1)"
)
SCORED_PASTES = D.scored(UNIQUE_PASTES, "doc_id, site, seen_at, content_id", "content", TARGET, R.PASTE_RULES)


def unique_scored(t):
    from seepage.operators.dedupe import keep_first

    pastes = t.pastes.withColumn("content_id", X.content_id("url", "title", "date"))
    return C.score_content(keep_first(pastes, ["content_id"], ["doc_id"], unique=True), "content", TARGET)


@query(
    "exposure_summary",
    f"""SELECT 7::BIGINT AS total_sites_checked, count(DISTINCT site) AS sites_with_detections, count(*) AS total_pastes_found,
 count(*) FILTER (has_credentials) AS credential_leaks, count(*) FILTER (NOT has_credentials AND has_code) AS code_exposures,
 count(*) FILTER (risk_score >= 8) AS high_risk_pastes, count(*) FILTER (risk_score >= 5 AND risk_score < 8) AS medium_risk_pastes,
 count(*) FILTER (risk_score < 5) AS low_risk_pastes FROM ({SCORED_PASTES})""",
    ("pastes",),
)
def exposure_summary(t):
    return C.exposure_summary(unique_scored(t), len(R.PASTE_SITES))


@query(
    "sites_with_hits",
    f"SELECT site, 'detections_found' AS status, max(seen_at) AS last_checked FROM {UNIQUE_PASTES} GROUP BY 1",
    ("pastes",),
)
def sites_with_hits(t):
    from seepage.operators.dedupe import keep_first

    pastes = t.pastes.withColumn("content_id", X.content_id("url", "title", "date"))
    return C.sites_with_hits(keep_first(pastes, ["content_id"], ["doc_id"], unique=True), "seen_at")
