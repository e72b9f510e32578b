"""Inputs that Spark derives from the test tables.

The test tables hold no certificate log, dump lines, pastes or result pages,
so each is a projection of whole tables and grows with them. The text is SQL
that Spark and DuckDB read alike: the check then compares only the operator.
A third of the rows share one key wherever the operator merges by key. All
addresses, hosts and secrets are made up.
"""

from __future__ import annotations

_HOST = "split_part(split_part(url, '://', 2), '/', 1)"
_CORP = "concat('corp', o_custkey % 7, '.example.com')"
_DAY = "replace(CAST(o_orderdate AS STRING), ' ', 'T')"
_HEX = "md5(CAST(o_orderkey AS STRING))"
_SITE = (
    "CASE doc_id % 7 WHEN 0 THEN 'pastebin.com' WHEN 1 THEN 'paste.ee' WHEN 2 THEN 'hastebin.com'"
    " WHEN 3 THEN 'ghostbin.co' WHEN 4 THEN 'rentry.co' WHEN 5 THEN 'justpaste.it' ELSE 'dpaste.org' END"
)
_PLANT = """CASE doc_id % 20
  WHEN 0 THEN concat('mail user', doc_id, '@corp1.example.com or admin@acme.example.com today')
  WHEN 1 THEN concat('pass', 'word = "hunter', doc_id, 'xyz"')
  WHEN 2 THEN concat('api', '_key: ', substr(md5(text), 1, 24))
  WHEN 3 THEN concat('mongodb', '://app:', substr(md5(text), 1, 8), '@db.corp1.example.com/x')
  WHEN 4 THEN concat('AK', 'IA', upper(substr(md5(text), 1, 16)))
  WHEN 5 THEN concat('-----BEGIN ', 'RSA PRIVATE KEY-----')
  WHEN 6 THEN concat('ey', 'J', substr(md5(text), 1, 10), '.ey', 'J', substr(md5(text), 11, 10), '.', substr(md5(text), 21, 10))
  WHEN 7 THEN concat('hosts 10.1.2.', doc_id % 250, ' and 192.168.0.1')
  WHEN 8 THEN concat('card 4', lpad(CAST(doc_id AS STRING), 15, '0'), ' ok')
  WHEN 9 THEN concat('ghp', '_', md5(text), 'abcd')
  WHEN 10 THEN concat('xox', 'b-', doc_id, '-77-', substr(md5(text), 1, 12), ' xox', 'p-1-2-3-', substr(md5(text), 1, 9))
  WHEN 11 THEN concat('https://hooks.', 'slack.com/services/T0', doc_id, '/B1/', substr(md5(text), 1, 20))
  WHEN 12 THEN concat('aws', '_secret_access_key = ', md5(text), 'ABCD/+12')
  WHEN 13 THEN concat('ssn 123-45-', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), ' call +1 (555) 010-', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'))
  WHEN 14 THEN concat('see https://acme.example.com/a/', doc_id, ' and http://corp1.example.com/?q=1')
  WHEN 15 THEN concat('pwd:s3cretpw', doc_id, ' access', '-token=', md5(text), ' bob', doc_id, '@corp2.example.com')
  WHEN 16 THEN 'ACME.example.com acme.example.com Acme leaks'
  WHEN 17 THEN concat('xox', 'a-1-2-3-', substr(md5(text), 1, 9), ' xox', 'r-4-5-', substr(md5(text), 1, 9))
  WHEN 18 THEN concat('redis', '://10.0.0.1:6379 10.0.0.1 postgresql', '://h/db')
  ELSE 'nothing to see' END"""

# name -> (SQL, tables it reads)
DERIVED: dict[str, tuple[str, tuple]] = {
    "page_hosts": (f"SELECT page_id, url, {_HOST} AS host FROM {{pages}}", ("pages",)),
    # Watched domains: what follows the www., blog. or m. label of a page host.
    "watch_domains": (
        "SELECT DISTINCT CASE WHEN host LIKE 'www.%' THEN substr(host, 5) WHEN host LIKE 'blog.%' THEN substr(host, 6)"
        " ELSE substr(host, 3) END AS domain FROM {page_hosts}"
        " WHERE host LIKE 'www.%' OR host LIKE 'blog.%' OR host LIKE 'm.%'",
        ("page_hosts",),
    ),
    "corp_domains": (
        "SELECT DISTINCT concat('corp', c_nationkey % 7, '.example.com') AS domain FROM {customer}", ("customer",)
    ),
    "ct_entries": (
        f"""SELECT o_orderkey AS id, {_DAY} AS entry_timestamp, {_DAY} AS not_before,
  CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN concat({_DAY}, '.123') ELSE {_DAY} END AS not_after,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('host', o_custkey, '.', {_CORP}) END AS common_name,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('CN=', o_orderpriority) END AS issuer_name,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'shared-serial'
       ELSE md5(CAST(o_custkey * 31 + o_orderkey % 5 AS STRING)) END AS serial_number,
  concat('api', o_custkey % 50, '.', {_CORP}, chr(10), '*.', {_CORP}, chr(10), ' www.', {_CORP}, ' ', chr(10),
         'not a name', chr(10), 'bad..name.com', chr(10), chr(10), 'other', o_orderkey % 100, '.example.org') AS name_value
FROM {{orders}}""",
        ("orders",),
    ),
    "dump_lines": (
        f"""SELECT source_file,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('nothing of note in entry ', o_orderkey)
       ELSE concat(email, CASE o_orderkey % 5 WHEN 0 THEN ':' WHEN 1 THEN ';' WHEN 2 THEN ',' WHEN 3 THEN '|' ELSE chr(9) END,
                   secret) END AS line
FROM (SELECT o_orderkey, concat('dump/part', o_custkey % 16, '.txt') AS source_file,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Shared.Box@corp1.example.com'
       WHEN o_orderkey % 8 = 1 THEN concat('user', o_custkey, '@mail.', {_CORP})
       WHEN o_orderkey % 8 = 2 THEN concat('user', o_custkey, '@', {_CORP}, '.au')
       WHEN o_orderkey % 8 = 4 THEN concat('user', o_custkey, '@elsewhere.example.org')
       ELSE concat('User', o_custkey, '@', {_CORP}) END AS email,
  CASE o_orderkey % 8 WHEN 0 THEN md5(CAST(o_custkey AS STRING))
       WHEN 1 THEN concat({_HEX}, substr({_HEX}, 1, 8))
       WHEN 2 THEN concat({_HEX}, {_HEX})
       WHEN 3 THEN concat('$2b$12$', {_HEX}, substr({_HEX}, 1, 21))
       WHEN 4 THEN concat('$6$', {_HEX})
       WHEN 5 THEN concat('zz', {_HEX}, {_HEX})
       WHEN 6 THEN concat('plain', o_custkey % 9)
       ELSE upper({_HEX}) END AS secret
FROM {{orders}}) AS pairs""",
        ("orders",),
    ),
    "planted": (f"SELECT doc_id, source, concat(text, chr(10), {_PLANT}) AS text FROM {{documents}}", ("documents",)),
    "planted_chat": (
        "SELECT conv_id, turn, role, concat(text, CASE (conv_id + turn) % 4 WHEN 0 THEN concat(' xox', 'b-', conv_id, '-1-', substr(md5(text), 1, 9))"
        " WHEN 1 THEN concat(' https://hooks.', 'slack.com/services/T', conv_id, '/B2/', md5(text)) ELSE '' END) AS text FROM {conversations}",
        ("conversations",),
    ),
    "pastes": (
        f"""SELECT doc_id, {_SITE} AS site,
  CASE WHEN doc_id % 3 = 1 THEN 'Untitled' WHEN doc_id % 4 = 0 THEN concat('acme dump ', doc_id % 40)
       ELSE concat('Notes ', lang, ' ', doc_id % 40) END AS title,
  CASE WHEN doc_id % 3 = 1 THEN '' ELSE concat('https://paste.example.net/', doc_id % 40) END AS url,
  '' AS author,
  CASE WHEN doc_id % 3 = 1 THEN '' ELSE concat('2024-01-', lpad(CAST(doc_id % 20 + 1 AS STRING), 2, '0')) END AS date,
  CASE WHEN doc_id % 2 = 0 THEN split_part(text, chr(10), 1) WHEN doc_id % 5 = 0 THEN 'acme preview' ELSE '' END AS content_preview,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE concat(text, chr(10), {_PLANT}, CASE WHEN doc_id % 6 = 1 THEN ' acme.example.com' ELSE '' END) END AS content,
  CAST(concat('2024-01-01 0', doc_id % 10, ':00:00') AS TIMESTAMP) AS seen_at
FROM {{documents}}""",
        ("documents",),
    ),
    "people": (
        "SELECT DISTINCT split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last,"
        " concat('corp', p_size % 7, '.example.com') AS domain FROM {part}",
        ("part",),
    ),
    "observed": (
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN concat('Hot.Ring@corp', l_linenumber % 7, '.example.com')"
        " WHEN l_partkey % 3 = 1 THEN concat('small', l_linenumber, '@corp1.example.com')"
        " ELSE concat('b', 'bolt@corp', l_suppkey % 7, '.example.com') END AS address FROM {lineitem}",
        ("lineitem",),
    ),
    "rosters": (
        "SELECT c_custkey, concat(chr(123), '\"ok\": true, \"members\": [', chr(123), '\"name\": \"u', c_custkey,"
        " '\", \"real_name\": \"', c_name, '\", \"is_admin\": ', CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END,"
        " ', \"profile\": ', chr(123), '\"email\": \"u', c_custkey, '@corp', c_nationkey % 7, '.example.com\", \"image_72\": \"/i/',"
        " c_custkey, '.png\"', chr(125), chr(125), ', ', chr(123), '\"name\": \"bot', c_nationkey, '\"', chr(125), ']', chr(125)) AS answer"
        " FROM {customer}",
        ("customer",),
    ),
    "passive_dns": (
        "SELECT concat(CASE WHEN c_custkey % 4 = 0 THEN 'Red' WHEN c_custkey % 4 = 1 THEN 'small'"
        " WHEN c_custkey % 4 = 2 THEN 'deep.blue' ELSE concat('x', c_custkey) END, '.corp', c_nationkey, '.example.com') AS host,"
        " CASE c_custkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'CNAME' WHEN 3 THEN 'TXT' WHEN 4 THEN 'a' ELSE 'CNAME' END AS rtype,"
        " concat('v', c_custkey) AS value FROM {customer}",
        ("customer",),
    ),
    "host_words": ("SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM {part}", ("part",)),
    "names": (
        "SELECT e.event_id, CASE e.event_id % 6 WHEN 0 THEN concat('  #', e.event_type, '-room ')"
        " WHEN 1 THEN concat('team ', e.user_id, '!') WHEN 2 THEN '' WHEN 3 THEN concat(e.props, e.props, e.props, e.props, e.props, e.props)"
        " WHEN 4 THEN '***' ELSE concat(e.event_type, '_', e.user_id) END AS name FROM {events} AS e",
        ("events",),
    ),
    # URLs of all shapes, one per line item.
    "urls": (
        """SELECT l_orderkey, l_linenumber, CASE l_partkey % 12
  WHEN 0 THEN concat('  HTTPS://Host', l_suppkey, '.Corp1.Example.com:8443/a/b?c=1 ')
  WHEN 1 THEN concat('http://corp', l_suppkey % 9, '.example.com/files/report', l_partkey, '.PDF')
  WHEN 2 THEN concat('corp1.example.com:99/x', l_partkey)
  WHEN 3 THEN concat('/relative/', l_partkey, '.docx')
  WHEN 4 THEN concat('#top', l_linenumber)
  WHEN 5 THEN concat('https://github.com/org', l_suppkey, '/public-repo/blob/main/config/secret', l_partkey, '.env')
  WHEN 6 THEN concat('https://example.org/orari/', l_partkey)
  WHEN 7 THEN concat('http://10.0.', l_suppkey % 256, '.1:80/a.tar.gz')
  WHEN 8 THEN concat('https://-bad-.example.com/', l_partkey)
  WHEN 9 THEN concat('https://user@notcorp1.example.com/a.xlsx?x=', l_partkey)
  WHEN 10 THEN ''
  ELSE concat('ftp://sub.corp', l_suppkey % 9, '.example.com') END AS url,
  CASE l_linenumber WHEN 1 THEN 'CONFIDENTIAL budget' WHEN 2 THEN 'Employee handbook' WHEN 3 THEN 'Docker webhook token'
  WHEN 4 THEN 'Restricted staff list' WHEN 5 THEN 'Annual agreement' ELSE concat('Notes ', l_partkey) END AS title
FROM {lineitem}""",
        ("lineitem",),
    ),
    # Search hits of three engines; a third of the rows share one URL.
    "hits": (
        """SELECT l_orderkey * 10 + l_linenumber AS hit_id, l_partkey,
  CASE l_suppkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' ELSE 'duckduckgo' END AS engine,
  CASE WHEN l_orderkey % 3 = 0 THEN 'https://example.com/hot' WHEN l_orderkey % 7 = 0 THEN ''
       ELSE concat('https://example.com/p/', l_partkey) END AS url,
  concat(CASE l_linenumber WHEN 1 THEN 'Acme.example.com leak ' WHEN 2 THEN 'Slack export ' ELSE 'Entry ' END, l_partkey) AS title,
  CASE WHEN l_quantity > 40 THEN 'found ACME.EXAMPLE.COM in text' ELSE 'nothing' END AS snippet
FROM {lineitem}""",
        ("lineitem",),
    ),
    # Result pages with two boxes each, laid out as each site does.
    "result_pages": (
        """SELECT p_partkey, site, CASE site
  WHEN 'google' THEN concat('<body><div class="g x"><a href="https://example.com/', p_partkey, '"><h3> ', p_name, ' </h3></a><div class="s">wrong</div><span class="st">about <b>', p_brand, '</b></span></div><div class="g"><h3>second</h3><a href="/s/', p_partkey, '">l</a><div class="s">alt ', p_type, '</div></div><div class="g">empty</div></body>')
  WHEN 'bing' THEN concat('<ol><li class="b_algo"><h2><a href="https://example.com/', p_partkey, '">', p_name, '</a></h2><p>about ', p_brand, '</p></li><li class="b_algo"><h2>no link</h2></li><li class="b_algo"><h2><a href="/s/', p_partkey, '">second</a></h2><div>no par</div></li></ol>')
  ELSE concat('<div class="results"><div class="result"><a class="result__a" href="https://example.com/', p_partkey, '">', p_name, '</a><a class="result__snippet">about ', p_brand, '</a></div><div class="result"><a class="other">x</a></div><div class="result"><a class="result__a" href="/s/', p_partkey, '">second</a></div></div>') END AS html,
  p_name, p_brand, p_type
FROM (SELECT p.*, CASE p_partkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' ELSE 'duckduckgo' END AS site FROM {part} AS p) AS parts""",
        ("part",),
    ),
    # Result pages of code hosts, paste sites, document engines and leak lists.
    "listing_pages": (
        """SELECT s_key, site, name, CASE site
  WHEN 'repositories' THEN concat('<div class="f4"><a href="/o/', s_key, '">', name, '</a></div><p>desc ', s_key, '</p><div class="f4">none</div>')
  WHEN 'code' THEN concat('<div class="code-list-item"><a>x</a><div class="f4 b"><a href="/o/', s_key, '"> ', name, ' </a></div><div class="code-list-item-code">desc ', s_key, '</div></div>')
  WHEN 'commits' THEN concat('<div class="commit-group-item"><a class="commit-link" href="/o/', s_key, '">', name, '</a><a class="commit-author">desc ', s_key, '</a></div>')
  WHEN 'issues' THEN concat('<div class="issue-list-item"><a class="muted-link" href="/z">desc ', s_key, '</a><a class="h4 x" href="/o/', s_key, '">', name, '</a></div>')
  WHEN 'pastebin.com' THEN concat('<div class="gsc-result"><h3>no</h3><a href="/o/', s_key, '">', name, '</a></div><div class="gsc-result">bare</div>')
  WHEN 'paste.ee' THEN concat('<div class="paste-item"><a href="/o/', s_key, '">link</a><h3>', name, '</h3></div>')
  WHEN 'rentry.co' THEN concat('<ul><li class="search-result"><h2>', name, '</h2><a href="/o/', s_key, '">go</a></li><li class="x-item"><a>no link</a></li><li class="other"><a href="/q">q</a></li></ul>')
  WHEN 'google.com' THEN concat('<div class="g"><h3>', name, '</h3><a href="https://google.com/o/', s_key, '.PDF">go</a><p>desc ', s_key, '</p></div><div class="g"><a href="/plain">plain page</a></div>')
  ELSE concat('<div class="search-result"><a href="/o/', s_key, '">', name, '</a><span>desc ', s_key, '</span></div>') END AS html
FROM (SELECT o_orderkey AS s_key, CASE o_custkey % 9 WHEN 0 THEN 'repositories' WHEN 1 THEN 'code' WHEN 2 THEN 'commits' WHEN 3 THEN 'issues'
  WHEN 4 THEN 'pastebin.com' WHEN 5 THEN 'paste.ee' WHEN 6 THEN 'rentry.co' WHEN 7 THEN 'google.com' ELSE 'ahmia.fi' END AS site,
  concat(CASE WHEN o_orderkey % 4 = 0 THEN 'Secret Acme.example.com ' ELSE 'Plain ' END, o_orderpriority) AS name FROM {orders}) AS listed""",
        ("orders",),
    ),
    "paste_pages": (
        """SELECT doc_id, site, concat('<html><head><title>Paste</title></head><body><div class="nav">menu</div>', CASE site
  WHEN 'pastebin.com' THEN concat('<pre>side</pre><textarea id="paste_code">', body, '</textarea>')
  WHEN 'paste.ee' THEN concat('<pre>side</pre><div class="big paste-content">', body, '<br></div>')
  WHEN 'hastebin.com' THEN concat('<pre><code>', body, '</code></pre>')
  WHEN 'ghostbin.co' THEN concat('<div class="main-content"> ', body, ' </div>')
  ELSE '<span>gone</span>' END, '</body></html>') AS html, body
FROM (SELECT doc_id, """ + _SITE + """ AS site,
  replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body FROM {documents}) AS bodies""",
        ("documents",),
    ),
    # Pages with a form, links of all kinds, images, headings, tables and scripts.
    "rich_pages": (
        """SELECT c_custkey, concat('https://site', c_nationkey, '.example.com/dir/', c_custkey) AS url,
  concat('<!DOCTYPE html><html><head><title> ', c_name, ' </title><meta name="Description" content="seg ', c_mktsegment, '"><meta name="description" content="join ', c_custkey,
  '"><meta property="OG:Title" content="og ', c_custkey, '"><link rel="stylesheet" href="a.css"><link rel="icon" href="b.ico"><script>var u = "https://cdn.example.com/lib', c_custkey,
  '.js"; var v = "//x"; f("http://api.example.org/v', c_nationkey, '");</script></head><body><h1>', c_name, '</h1><h2>a</h2><h2>b</h2><img src="x.png"><img src="y.png"/>',
  '<a href="next">rel</a><a href="/root/', c_custkey, '">root</a><a href="https://www.example.org/out/', c_custkey, '">ext</a><a href="mailto:me@example.com">mail</a><a name="anchor">none</a>',
  '<a href="http://abc', c_nationkey, 'def.onion/x">o</a><a href="bare', c_custkey % 10, '.onion/path">o2</a><a href="https://twitter.com/Login">t</a><a href="https://www.twitter.com/h', c_custkey, '">t2</a>',
  '<p>github.com/g', c_nationkey, ' and linkedin.com/company/l-', c_custkey, ' facebook.com/HOME </p>',
  '<form action="/send" method="POST"><input type="text" name="n', c_custkey, '" required><div><select id="s"></select></div><textarea placeholder="say"></textarea></form><form><input></form>',
  '<table class="table wide"><tr><th>h</th></tr><tr><td> mail.corp', c_nationkey, '.example.com </td><td>1</td></tr><tr><td>single</td></tr><tr><td>not a host</td><td>2</td></tr></table>',
  '<!-- build ', c_custkey, ' --><ul><li class="channel-item"># gen ', c_nationkey, '</li><li><span class="user">Member ', c_custkey, '</span></li></ul>',
  '<p>Call 555-010-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' or me', c_custkey, '@corp1.example.com at 12 Main Street, Springfield, 12345</p></body></html>') AS html,
  c_name, c_nationkey, c_mktsegment FROM {customer}""",
        ("customer",),
    ),
    # A site whose page k links to pages 8k+1..8k+8 and back to the start; pages ending in 9 get no link.
    "site_pages": (
        "SELECT k, concat('https://wiki.example.com/p/', k) AS url, concat('<body><a href=\"/p/0\">home</a>', "
        + ", ".join(
            f"CASE WHEN (8 * k + {j}) % 10 = 9 THEN '' ELSE concat('<a href=\"/p/', 8 * k + {j}, '\">n</a>') END"
            for j in range(1, 9)
        )
        + ", '</body>') AS html FROM (SELECT o_orderkey AS k FROM {orders}) AS ids",
        ("orders",),
    ),
    "paste_history": (
        "SELECT DISTINCT md5(concat(url, title, date)) AS content_id FROM {pastes} WHERE site = 'paste.ee' OR site = 'rentry.co'",
        ("pastes",),
    ),
    "rule_rows": (
        "SELECT DISTINCT CASE r_regionkey % 2 WHEN 0 THEN 'hex_token' ELSE 'quoted_secret' END AS kind,"
        " CASE r_regionkey % 2 WHEN 0 THEN concat('token = \"[0-9a-f]', chr(123), '40', chr(125), '\"')"
        " ELSE concat('[Ss]ecret = \"[^\"]', chr(123), '10,', chr(125), '\"') END AS pattern FROM {region}",
        ("region",),
    ),
    # Templates that a user brings, one a region; angle brackets stand for braces, which Spark's SQL strings would fill.
    "mail_templates": (
        "SELECT translate(concat(CASE r_regionkey % 5 WHEN 0 THEN '<first>-<last>' WHEN 1 THEN '<l>.<first>' WHEN 2 THEN 'x<f><l>'"
        " WHEN 3 THEN '<last>_<unknown>' ELSE 'team' END, '@<domain>'), '<>', concat(chr(123), chr(125))) AS template FROM {region}",
        ("region",),
    ),
    "search_templates": (
        "SELECT concat('own', r_regionkey % 2) AS category, translate(CASE r_regionkey % 5 WHEN 0 THEN 'www.<domain>' WHEN 1 THEN '<label>'"
        " WHEN 2 THEN '&copy; <query>' WHEN 3 THEN 'm.<domain> ' ELSE '<spaced>' END, '<>', concat(chr(123), chr(125))) AS template FROM {region}",
        ("region",),
    ),
    "repositories": (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'org/hot' WHEN o_orderkey % 10 = 1 THEN NULL"
        " ELSE concat('org', o_custkey % 50, '/repo', o_custkey) END AS full_name, o_orderpriority AS description FROM {orders}",
        ("orders",),
    ),
}


def closure(names) -> list[str]:
    """The derived inputs and those they read, inputs first."""
    out: list[str] = []

    def add(name):
        if name in DERIVED and name not in out:
            for other in DERIVED[name][1]:
                add(other)
            out.append(name)

    for n in names:
        add(n)
    return out
