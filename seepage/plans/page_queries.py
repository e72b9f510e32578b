"""Facts of stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import html as P
from seepage.functions import text as X
from seepage.operators import pages as G
from seepage.plans import duck as D
from seepage.plans.registry import query


def parsed(t):
    return G.with_nodes(t.pages)


def rich(t):
    return G.with_nodes(t.rich_pages)


SITE = "'https://site' || c_nationkey || '.example.com'"
# The valid anchors of a rich page, in page order.
RICH_LINKS = [
    f"{SITE} || '/dir/next'",
    f"{SITE} || '/root/' || c_custkey",
    "'https://www.example.org/out/' || c_custkey",
    "'http://abc' || c_nationkey || 'def.onion/x'",
    f"{SITE} || '/dir/bare' || (c_custkey % 10) || '.onion/path'",
    "'https://twitter.com/Login'",
    "'https://www.twitter.com/h' || c_custkey",
]

CLEAN = (
    f"list_filter(list_transform(regexp_split_to_array({D.visible('html')}, '\\r\\n|[\\n\\r]|  '),"
    f" lambda x: {D.strip('x')}), lambda x: x <> '')"
)


@query(
    "page_text",
    "SELECT page_id, substr(s, 1, 5000) AS content, CAST(length(s) AS INTEGER) AS content_length"
    f" FROM (SELECT page_id, array_to_string({CLEAN}, ' ') AS s FROM pages)",
)
def page_text(t):
    return G.page_text(parsed(t), ["page_id"])


@query(
    "page_titles",
    f"SELECT page_id, 'title' AS name, {D.strip(D.visible('''regexp_extract(html, '<title>([^<]*)</title>', 1)'''))} AS value FROM pages",
)
def page_titles(t):
    return G.page_metadata(parsed(t), ["page_id"])


@query(
    "page_metadata",
    """SELECT c_custkey, 'title' AS name, c_name AS value FROM customer
 UNION ALL SELECT c_custkey, 'meta_description', 'join ' || c_custkey FROM customer
 UNION ALL SELECT c_custkey, 'og:title', 'og ' || c_custkey FROM customer""",
)
def page_metadata(t):
    return G.page_metadata(rich(t), ["c_custkey"])


@query(
    "abs_links",
    "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || h AS link, h AS href FROM"
    " (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages)",
)
def abs_links(t):
    return G.anchors(parsed(t), ["page_id"]).select("page_id", "link", "href")


@query(
    "page_links",
    f"SELECT DISTINCT page_id, link FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || h AS link FROM"
    f" (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages)) WHERE {D.valid_url('link')}",
)
def page_links(t):
    return G.page_links(parsed(t), ["page_id"])


@query("page_links_rich", f"SELECT c_custkey, unnest([{', '.join(RICH_LINKS)}]) AS link FROM customer")
def page_links_rich(t):
    return G.page_links(rich(t), ["c_custkey"])


@query(
    "links_int_ext",
    f"""SELECT c_custkey, link, contains(host, 'example.org') OR contains('example.org', host) AS is_internal
 FROM (SELECT c_custkey, link, regexp_extract(link, '://([^/]+)', 1) AS host FROM
 (SELECT c_custkey, unnest([{', '.join(RICH_LINKS)}]) AS link FROM customer))""",
)
def links_int_ext(t):
    return G.split_links(G.page_links(rich(t), ["c_custkey"]), F.lit("example.org"))


@query(
    "hosts_by_tld",
    "SELECT c_custkey, unnest(['abc' || c_nationkey || 'def.onion', 'bare' || (c_custkey % 10) || '.onion']) AS host FROM customer",
)
def hosts_by_tld(t):
    return G.hosts_by_tld(rich(t), ["c_custkey"])


@query(
    "page_forms",
    """SELECT c_custkey, 0 AS pos, '/send' AS action, 'post' AS method, 3 AS n_fields,
 'input|text|n' || c_custkey || '|||true;select|||s||false;textarea||||say|false' AS fields FROM customer
 UNION ALL SELECT c_custkey, 1, '', 'get', 1, 'input|||||false' FROM customer""",
)
def page_forms(t):
    line = lambda f: F.concat_ws("|", f["tag"], f["type"], f["name"], f["id"], f["placeholder"], f["required"].cast("string"))
    return G.page_forms(rich(t), ["c_custkey"]).select(
        "c_custkey", "pos", "action", "method", F.size("fields").alias("n_fields"),
        F.array_join(F.transform("fields", line), ";").alias("fields"),
    )


@query(
    "script_urls",
    """SELECT c_custkey, unnest(['https://cdn.example.com/lib' || c_custkey || '.js',
 'http://api.example.org/v' || c_nationkey]) AS script_url FROM customer""",
)
def script_urls(t):
    return G.script_urls(rich(t), ["c_custkey"])


@query(
    "page_comments",
    f"SELECT page_id, CAST(i AS INTEGER) AS pos, {D.strip('c')} AS comment FROM (SELECT page_id, unnest(m) AS c, unnest(range(len(m))) AS i"
    " FROM (SELECT page_id, regexp_extract_all(html, '<!--(.*?)-->', 1, 's') AS m FROM pages))",
)
def page_comments(t):
    return G.page_comments(parsed(t), ["page_id"])


def tags(name: str) -> str:
    bare = "regexp_replace(html, '<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'gs')"
    return f"CAST(len(regexp_extract_all({bare}, '<{name}[ >/]')) AS INTEGER)"


@query(
    "page_structure",
    f"""SELECT page_id, 'h1=' || {tags('h1')} AS headings, {tags('img')} AS images, {tags('a')} AS links, {tags('form')} AS forms,
 CAST(len(regexp_extract_all(html, '<script[ >]')) AS INTEGER) AS scripts, 0 AS stylesheets FROM pages""",
)
def page_structure(t):
    return flat_structure(G.page_structure(parsed(t), ["page_id"]))


@query(
    "page_structure_rich",
    "SELECT c_custkey, 'h1=1;h2=2' AS headings, 2 AS images, 9 AS links, 2 AS forms, 1 AS scripts, 1 AS stylesheets FROM customer",
)
def page_structure_rich(t):
    return flat_structure(G.page_structure(rich(t), ["c_custkey"]))


def flat_structure(df):
    line = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    return df.withColumn("headings", F.array_join(F.array_sort(F.transform(F.map_entries("headings"), line)), ";"))


@query(
    "page_structure_by_host",
    f"""SELECT host, CAST(sum(links) AS BIGINT) AS links, count(*) AS pages FROM (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host,
 {tags('a')} AS links FROM pages) GROUP BY 1""",
)
def page_structure_by_host(t):
    from seepage.functions import hosts as H

    facts = G.page_structure(parsed(t), ["url"])
    return facts.groupBy(H.url_host("url").alias("host")).agg(
        F.sum("links").alias("links"), F.count(F.lit(1)).alias("pages")
    )


def social_sql(*contents: str) -> str:
    """Handles by platform, found in any of the contents."""
    found = lambda p: " || ".join(f"regexp_extract_all({c}, {D.q(p)}, 1)" for c in contents)
    return " || ".join(
        f"(SELECT CASE WHEN len(h) > 0 THEN ';{name}=' || array_to_string(list_sort(h), ',') ELSE '' END FROM (SELECT list_filter(list_distinct("
        f"{found(p)}), lambda x: x <> '' AND lower(x) NOT IN ('home', 'login', 'signin', 'signup')) AS h))"
        for name, p in sorted(R.SOCIAL_RULES)
    )


@query(
    "contact_info",
    f"""SELECT page_id, array_to_string(list_sort({D.emails('s')}), ' | ') AS emails,
 array_to_string(list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(s, {D.q(R.PHONE)}, 1), regexp_extract_all(s, {D.q(R.PHONE)}, 2),
 regexp_extract_all(s, {D.q(R.PHONE)}, 3)), lambda p: '(' || p[1] || ') ' || p[2] || '-' || p[3]))), ' | ') AS phones,
 ltrim({social_sql('s', 'html')}, ';') AS social_media,
 array_to_string(list_sort(list_distinct(regexp_extract_all(s, {D.q(R.ADDRESS)}))), ' | ') AS addresses
 FROM (SELECT page_id, html, {D.visible('html')} AS s FROM pages)""",
)
def contact_info(t):
    return flat_contact(G.contact_info(parsed(t), ["page_id"]), "page_id")


def flat_contact(info, *keys):
    """All fields of the contact row, lists and the map joined."""
    joined = {c: F.array_join(c, " | ").alias(c) for c in ("emails", "phones", "addresses")}
    return info.select(*keys, joined["emails"], joined["phones"], social("social_media").alias("social_media"), joined["addresses"])


@query(
    "page_facts",
    f"""SELECT page_id, url, trim({D.visible("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
 array_to_string(list_sort({D.emails('s')}), ' | ') AS emails,
 array_to_string(list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(s, {D.q(R.PHONE)}, 1), regexp_extract_all(s, {D.q(R.PHONE)}, 2),
 regexp_extract_all(s, {D.q(R.PHONE)}, 3)), lambda p: '(' || p[1] || ') ' || p[2] || '-' || p[3]))), ' | ') AS phones,
 coalesce(links, '') AS links, array_to_string(list_sort(list_distinct(regexp_extract_all(s, {D.q(R.ADDRESS)}))), ' | ') AS addresses,
 ltrim({social_sql('html')}, ';') AS social_media,
 'title=' || trim({D.visible("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS metadata
 FROM (SELECT page_id, url, html, {D.visible('html')} AS s FROM pages) LEFT JOIN
 (SELECT page_id, string_agg(link, ' | ' ORDER BY link) AS links FROM
  (SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || h AS link FROM
   (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages))
  WHERE {D.valid_url('link')} GROUP BY page_id) USING (page_id)""",
)
def page_facts(t):
    facts = G.page_facts(parsed(t), ["page_id"])
    return flat_facts(facts, "page_id", "url")


def flat_facts(facts, *keys):
    """All fields of the facts row, lists and maps joined."""
    joined = {c: F.array_join(c, " | ") for c in ("emails", "contact_info.phones", "contact_info.addresses", "links")}
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    metadata = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), pair)), ";")
    return facts.select(*keys, "title", *[c.alias(n.rpartition(".")[2]) for n, c in joined.items()],
                        social("contact_info.social_media").alias("social_media"), metadata.alias("metadata"))


@query(
    "page_facts_rich",
    """SELECT c_custkey, c_name AS title, 'me' || c_custkey || '@corp1.example.com' AS emails, 1 AS n_phones, 1 AS n_addresses, 9 AS n_anchors,
 'github=g' || c_nationkey || ';linkedin=l-' || c_custkey || ';twitter=h' || c_custkey AS social_media,
 'meta_description=join ' || c_custkey || ';og:title=og ' || c_custkey || ';title=' || c_name AS metadata FROM customer""",
)
def page_facts_rich(t):
    """The same row over pages that have all of it."""
    facts = G.page_facts(rich(t), ["c_custkey"])
    own = flat_facts(facts, "c_custkey").select("c_custkey", "title", "emails", "social_media", "metadata")
    counted = facts.select("c_custkey", F.size("contact_info.phones").alias("n_phones"), F.size("contact_info.addresses").alias("n_addresses"))
    links = G.page_structure(rich(t), ["c_custkey"]).select("c_custkey", F.col("links").alias("n_anchors"))
    return own.join(counted, "c_custkey").join(links, "c_custkey")


@query(
    "contact_info_rich",
    """SELECT c_custkey, 'me' || c_custkey || '@corp1.example.com' AS emails, 1 AS n_phones, 1 AS n_addresses,
 'github=g' || c_nationkey || ';linkedin=l-' || c_custkey || ';twitter=h' || c_custkey AS social FROM customer""",
)
def contact_info_rich(t):
    info = G.contact_info(rich(t), ["c_custkey"])
    return info.select(
        "c_custkey", F.array_join("emails", " | ").alias("emails"), F.size("phones").alias("n_phones"),
        F.size("addresses").alias("n_addresses"), social("social_media").alias("social"),
    )


def social(c):
    line = lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), line)), ";")


@query(
    "social_handles",
    "SELECT c_custkey, unnest(['github', 'linkedin', 'twitter']) AS platform,"
    " unnest(['g' || c_nationkey, 'l-' || c_custkey, 'h' || c_custkey]) AS handle FROM customer",
)
def social_handles(t):
    found = t.rich_pages.select("c_custkey", F.explode(X.social_handles("html")).alias("platform", "handles"))
    return found.select("c_custkey", "platform", F.explode("handles").alias("handle"))


@query(
    "page_flags",
    "SELECT c_custkey, c_name AS title, 'join ' || c_custkey AS description, true AS public_signup, false AS has_archive,"
    " true AS has_channel FROM customer",
)
def page_flags(t):
    return G.page_flags(rich(t), ["c_custkey"], ("archive", "channel"))


@query(
    "page_signup_flags",
    "SELECT page_id, contains(lower(html), 'sign up') OR contains(lower(html), 'join') AS public_signup,"
    " contains(lower(html), 'the') AS has_the FROM pages",
)
def page_signup_flags(t):
    return G.page_flags(parsed(t), ["page_id"], ("the",)).select("page_id", "public_signup", "has_the")


@query("table_hosts", "SELECT c_custkey, 'mail.corp' || c_nationkey || '.example.com' AS host FROM customer")
def table_hosts(t):
    return G.table_hosts(rich(t), ["c_custkey"])


@query(
    "class_names",
    "SELECT c_custkey, 'channel' AS kind, 0 AS pos, 'gen' || c_nationkey AS name FROM customer"
    " UNION ALL SELECT c_custkey, 'member', 0, 'Member ' || c_custkey FROM customer",
)
def class_names(t):
    return G.class_names(rich(t), ["c_custkey"])


@query(
    "serp_items",
    """SELECT p_partkey, site, p_name AS title, 'https://example.com/' || p_partkey AS url, 'about ' || p_brand AS snippet FROM result_pages
 UNION ALL SELECT p_partkey, site, 'second', '/s/' || p_partkey,
 CASE site WHEN 'google' THEN 'alt ' || p_type ELSE '' END FROM result_pages""",
    ("result_pages",),
)
def serp_items(t):
    pages = G.with_nodes(t.result_pages)
    return G.result_items(pages, ["p_partkey"], R.ENGINE_RULES).drop("pos")


@query(
    "paste_body",
    f"SELECT doc_id, site, CASE WHEN site IN ('rentry.co', 'justpaste.it', 'dpaste.org') THEN '' ELSE {D.strip('text')} END AS body"
    " FROM paste_pages JOIN documents USING (doc_id)",
    ("paste_pages",),
)
def paste_body(t):
    return G.paste_body(G.with_nodes(t.paste_pages), ["doc_id", "site"])


@query(
    "page_emails",
    f"SELECT page_id, unnest({D.emails('s')}) AS email FROM (SELECT page_id, {D.visible('html')} AS s FROM pages)",
)
def page_emails(t):
    return parsed(t).select("page_id", F.explode(X.emails(P.texts(F.col("nodes")))).alias("email"))


TARGET = "acme.example.com"


def listing(t):
    """All stored result pages; the rules decide which sites they fit."""
    return G.with_nodes(t.listing_pages.select("s_key", "site", "html"))


@query(
    "code_host_items",
    "SELECT s_key, site, name AS title, 'https://github.com/o/' || s_key AS url, 'desc ' || s_key AS snippet FROM listing_pages"
    " WHERE site IN ('repositories', 'code', 'commits', 'issues')",
    ("listing_pages",),
)
def code_host_items(t):
    pages = listing(t)
    return G.result_items(pages, ["s_key"], R.CODE_HOST_RULES).drop("pos")


@query(
    "paste_list_items",
    # Sites without a rule of their own go by boxes named paste, result or item; their first title element counts.
    """SELECT s_key, site, CASE site WHEN 'code' THEN 'x' WHEN 'issues' THEN 'desc ' || s_key ELSE name END AS title,
 CASE site WHEN 'issues' THEN '/z' WHEN 'paste.ee' THEN 'https://paste.ee/o/' || s_key ELSE '/o/' || s_key END AS url
 FROM listing_pages WHERE site NOT IN ('repositories', 'google.com')
 UNION ALL SELECT s_key, site, 'No title', '' FROM listing_pages WHERE site = 'pastebin.com'""",
    ("listing_pages",),
)
def paste_list_items(t):
    pages = listing(t)
    return G.result_items(pages, ["s_key"], R.PASTE_LIST_RULES).drop("pos", "snippet")


@query(
    "document_list_items",
    "SELECT s_key, site, name AS title, 'https://google.com/o/' || s_key || '.PDF' AS url, 'pdf' AS file_type FROM listing_pages"
    " WHERE site = 'google.com'",
    ("listing_pages",),
)
def document_list_items(t):
    items = G.result_items(listing(t), ["s_key"], R.DOCUMENT_LIST_RULES)
    return G.document_items(items).select("s_key", "site", "title", "url", X.file_type("url").alias("file_type"))


@query(
    "leaked_document_items",
    "SELECT s_key, site, name AS title, 'https://google.com/o/' || s_key || '.PDF' AS url,"
    " CASE WHEN s_key % 4 = 0 THEN 'high' ELSE 'low' END AS risk_level FROM listing_pages WHERE site = 'google.com'",
    ("listing_pages",),
)
def leaked_document_items(t):
    items = G.result_items(listing(t), ["s_key"], R.DOCUMENT_LIST_RULES)
    return G.leaked_items(items).drop("pos", "snippet")


@query(
    "chat_mention_items",
    # The boxes of the code pages hold another box, which the outer one shows as its snippet.
    """SELECT s_key, site, CASE WHEN site = 'code' AND box = 1 THEN 'x' ELSE name END AS title, CASE site WHEN 'google.com' THEN 'https://google.com/o/' || s_key || '.PDF' ELSE '/o/' || s_key END AS url,
 CASE WHEN site IN ('google.com', 'ahmia.fi') THEN 'desc ' || s_key WHEN site = 'code' AND box = 1 THEN name ELSE '' END AS snippet
 FROM listing_pages, (SELECT unnest([1, 2]) AS box)
 WHERE s_key % 4 = 0 AND (box = 1 OR site = 'code') AND site IN ('ahmia.fi', 'code', 'commits', 'google.com', 'rentry.co', 'repositories')""",
    ("listing_pages",),
)
def chat_mention_items(t):
    items = G.result_items(listing(t), ["s_key"], R.MENTION_LIST_RULES)
    return G.mentioned(items, TARGET, ("slack",), 500).drop("pos")


@query(
    "leak_reference_items",
    # The boxes of the other sites open with an element that does not name the target.
    """SELECT s_key, site, name AS title, 'https://' || site || '/o/' || s_key || CASE site WHEN 'google.com' THEN '.PDF' ELSE '' END AS url
 FROM listing_pages WHERE s_key % 4 = 0 AND site IN ('ahmia.fi', 'code', 'commits', 'google.com', 'rentry.co', 'repositories')""",
    ("listing_pages",),
)
def leak_reference_items(t):
    items = G.result_items(listing(t), ["s_key"], R.LEAK_LIST_RULES)
    return G.leak_references(items, TARGET).drop("pos", "snippet")


@query(
    "directory_items",
    # The selectors overlap, so a box that fits two of them is listed twice.
    """SELECT s_key, site, name AS title, CASE site WHEN 'google.com' THEN 'https://google.com/o/' || s_key || '.PDF' ELSE '/o/' || s_key END AS url,
 'desc ' || s_key AS snippet FROM listing_pages, (SELECT unnest([1, 2]) AS fit)
 WHERE s_key % 4 = 0 AND (site = 'ahmia.fi' OR (site = 'google.com' AND fit = 1))""",
    ("listing_pages",),
)
def directory_items(t):
    items = G.result_items(listing(t), ["s_key"], R.DIRECTORY_LIST_RULES, all_rules=True)
    return G.mentioned(items, TARGET).drop("pos")
