"""Facts of stored pages. ``with_nodes`` parses each page once; everything else is a projection of its node list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import hosts as H
from seepage.functions import html as P
from seepage.functions import text as X

NODES = "nodes"


def _nodes() -> Column:
    return F.col(NODES)


def with_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    return X.with_once(pages, NODES, P.html_nodes(html))


def page_text(parsed: DataFrame, keys, limit: int = 5000) -> DataFrame:
    """Visible text on one line: the first ``limit`` characters and the whole length."""
    return parsed.select(*keys, P.clean_text(_nodes()).alias("_t")).select(
        *keys, F.substring("_t", 1, limit).alias("content"), F.length("_t").alias("content_length")
    )


def title_of(nodes: Column) -> Column:
    return X.strip(P.text_of(nodes, P.first(P.by_tag(nodes, "title"))))


def metadata_of(nodes: Column) -> Column:
    """Map with the title, ``meta_<name>`` and ``og:*``; of equal names the last one holds."""
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    title = F.when(F.size(P.by_tag(nodes, "title")) > 0, F.array(pair(F.lit("title"), title_of(nodes)))).otherwise(
        F.array().cast("array<struct<key:string,value:string>>")
    )
    named = F.transform(
        F.filter(nodes, lambda m: (m["tag"] == "meta") & (P.attr(m, "name") != "") & (P.attr(m, "content") != "")),
        lambda m: pair(F.concat(F.lit("meta_"), F.lower(P.attr(m, "name"))), P.attr(m, "content")),
    )
    graph = F.transform(
        F.filter(nodes, lambda m: (m["tag"] == "meta") & F.lower(P.attr(m, "property")).startswith("og:")),
        lambda m: pair(F.lower(P.attr(m, "property")), P.attr(m, "content")),
    )

    def last_of_each(entries):
        later = lambda i: F.transform(F.slice(entries, i + 2, F.size(entries)), lambda e: e["key"])
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(later(i), e["key"])))

    return X.let(F.concat(title, named, graph), last_of_each)


def page_metadata(parsed: DataFrame, keys) -> DataFrame:
    """One row per page and metadata entry."""
    return parsed.select(*keys, F.explode(metadata_of(_nodes())).alias("name", "value"))


def _hrefs(nodes: Column) -> Column:
    return F.filter(F.transform(P.by_tag(nodes, "a"), lambda n: n["attrs"]["href"]), lambda href: href.isNotNull())


def _with_hrefs(parsed: DataFrame, keys, url: str):
    """Pages with their anchors' links as written, and the expression for the same links as absolute URLs.

    Most links are resolved in Spark; Python gets nulls for those and only
    resolves the rest, one list per page. Its arguments are plain columns,
    because Spark does not find a Python call whose arguments hold lambdas.
    """
    left = lambda u, r: F.when(r.isNull(), u)
    pages = (
        parsed.select(*keys, F.col(url).alias("_base"), _hrefs(_nodes()).alias("_hrefs"))
        .withColumn("_ready", H.plain_urls("_base", "_hrefs"))
        .withColumn("_left", F.zip_with("_hrefs", "_ready", left))
    )
    return pages, F.zip_with("_ready", H.join_urls("_base", "_left"), lambda a, b: F.coalesce(a, b))


def anchors(parsed: DataFrame, keys, url: str = "url") -> DataFrame:
    """Every anchor of a page as written and as an absolute URL."""
    pages, links = _with_hrefs(parsed, keys, url)
    both = F.arrays_zip(F.col("_hrefs").alias("href"), links.alias("link"))
    return pages.select(*keys, F.posexplode(both).alias("pos", "a")).select(*keys, "pos", "a.href", "a.link")


def page_links(parsed: DataFrame, keys, url: str = "url") -> DataFrame:
    """Distinct valid absolute links per page.

    The host of a page, which most of its links share, is tested once; of a
    link there only the rest is left to test.
    """
    pages, links = _with_hrefs(parsed, keys, url)
    pages = pages.withColumn("_root", F.concat(H.url_root("_base"), F.lit("/"))).withColumn("_sound", X.valid_url("_root"))

    def valid(link):
        return F.when(F.startswith(link, F.col("_root")), F.col("_sound") & link.rlike(r"^\S*$")).otherwise(X.valid_url(link))

    return pages.select(*keys, F.explode(F.filter(F.array_distinct(links), valid)).alias("link"))


def split_links(links: DataFrame, target: Column) -> DataFrame:
    """Add ``is_internal``: the target occurs in the link's host or the host in the target."""
    host = H.url_authority("link")
    target = F.lower(target)
    return links.withColumn("is_internal", F.contains(host, target) | F.contains(target, host))


def hosts_by_tld(parsed: DataFrame, keys, tld: str = ".onion") -> DataFrame:
    """Distinct link hosts with the given ending per page, from absolute and bare links."""
    host = F.transform(
        F.filter(_hrefs(_nodes()), lambda h: F.contains(h, F.lit(tld))), lambda h: H.link_host(h, tld)
    )
    kept = F.array_distinct(F.filter(host, lambda h: h.isNotNull() & (h != "")))
    return parsed.select(*keys, F.explode(kept).alias("host"))


def page_forms(parsed: DataFrame, keys) -> DataFrame:
    """One row per form with its fields in page order."""

    def field(n):
        return F.struct(
            n["tag"].alias("tag"),
            *[P.attr(n, a).alias(a) for a in ("type", "name", "id", "placeholder")],
            P.has_attr(n, "required").alias("required"),
        )

    def form(n):
        method = F.when(P.has_attr(n, "method"), P.attr(n, "method")).otherwise("get")
        fields = P.by_tag(P.below(_nodes(), n), "input", "textarea", "select")
        return F.struct(
            P.attr(n, "action").alias("action"), F.lower(method).alias("method"),
            F.transform(fields, field).alias("fields"),
        )

    forms = F.transform(P.by_tag(_nodes(), "form"), form)
    return parsed.select(*keys, F.posexplode(forms).alias("pos", "f")).select(*keys, "pos", "f.*")


def script_urls(parsed: DataFrame, keys) -> DataFrame:
    """Distinct valid URLs in the scripts of a page."""
    bodies = F.transform(
        P.by_tag(_nodes(), "script"),
        lambda n: F.array_join(F.transform(P.below(_nodes(), n), lambda x: F.coalesce(x["text"], F.lit(""))), ""),
    )
    found = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(R.SCRIPT_URL), F.lit(0))))
    return parsed.select(*keys, F.explode(F.filter(F.array_distinct(found), X.valid_url)).alias("script_url"))


def page_comments(parsed: DataFrame, keys) -> DataFrame:
    found = F.filter(_nodes(), lambda n: n["tag"] == P.COMMENT)
    return parsed.select(*keys, F.posexplode(F.transform(found, lambda n: X.strip(n["text"]))).alias("pos", "comment"))


def page_structure(parsed: DataFrame, keys) -> DataFrame:
    """Counts of headings by level and of images, links, forms, scripts and stylesheets."""
    tags = F.transform(_nodes(), lambda n: n["tag"])
    count = lambda t: F.size(F.filter(tags, lambda x: x == t))
    headings = F.array(
        *[F.struct(F.lit(f"h{i}").alias("key"), count(f"h{i}").alias("value")) for i in range(1, 7)]
    )
    sheets = F.filter(_nodes(), lambda n: (n["tag"] == "link") & P.has_token(n, "rel", "stylesheet"))
    return parsed.select(
        *keys,
        F.map_from_entries(F.filter(headings, lambda e: e["value"] > 0)).alias("headings"),
        count("img").alias("images"), count("a").alias("links"), count("form").alias("forms"),
        count("script").alias("scripts"), F.size(sheets).alias("stylesheets"),
    )


def contact_info(parsed: DataFrame, keys, html: str = "html") -> DataFrame:
    """Addresses of all kinds a page shows: emails, phones, social handles, postal addresses.

    Handles are sought in the text, in the page as stored and, if it holds entities, in the attributes they are read from.
    """
    coded = F.when(F.contains(F.col(html), F.lit("&")), P.attr_values(_nodes())).otherwise("")
    return parsed.withColumns({"_text": P.texts(_nodes()), "_coded": coded}).select(
        *keys,
        F.array_sort(X.emails("_text")).alias("emails"),
        F.array_sort(X.phones("_text")).alias("phones"),
        X.social_handles("_text", html, "_coded").alias("social_media"),
        F.array_sort(X.addresses("_text")).alias("addresses"),
    )


def page_facts(parsed: DataFrame, keys, url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: url, title, emails, links (distinct valid absolute ones), contact_info and metadata.

    ``contact_info`` holds phones, social_media and addresses.
    """
    contact = F.struct(
        F.array_sort(X.phones("_text")).alias("phones"), X.social_handles("_text", html).alias("social_media"),
        F.array_sort(X.addresses("_text")).alias("addresses"),
    )
    facts = {"title": title_of(_nodes()), "emails": F.array_sort(X.emails("_text")), "contact_info": contact,
             "metadata": metadata_of(_nodes())}
    pages, links = _with_hrefs(
        parsed.withColumn("_text", P.texts(_nodes())), [*keys, *[c.alias(n) for n, c in facts.items()]], url
    )
    kept = F.array_sort(F.filter(F.array_distinct(links), X.valid_url))
    return pages.select(*keys, F.col("_base").alias("url"), "title", "emails", kept.alias("links"), "contact_info", "metadata")


def page_flags(parsed: DataFrame, keys, words=(), html: str = "html") -> DataFrame:
    """Title, description, sign-up flag and one flag per given word."""
    described = P.first(
        F.filter(_nodes(), lambda n: (n["tag"] == "meta") & (P.attr(n, "name") == "description"))
    )
    return parsed.select(
        *keys,
        title_of(_nodes()).alias("title"),
        P.attr(described, "content").alias("description"),
        X.contains_any(html, ("sign up", "join")).alias("public_signup"),
        *[X.contains_any(html, (w,)).alias(f"has_{w}") for w in words],
    )


def table_hosts(parsed: DataFrame, keys, table_class: str = "table") -> DataFrame:
    """First cells of the rows with two cells or more, in tables of a class, that are valid domains."""
    rows = F.flatten(
        F.transform(
            F.filter(_nodes(), lambda n: (n["tag"] == "table") & P.has_class(n, table_class)),
            lambda t: P.by_tag(P.below(_nodes(), t), "tr"),
        )
    )
    cells = F.transform(rows, lambda r: P.by_tag(P.below(_nodes(), r), "td"))
    hosts = F.transform(
        F.filter(cells, lambda c: F.size(c) >= 2), lambda c: X.strip(P.text_of(_nodes(), P.first(c)))
    )
    return parsed.select(*keys, F.explode(F.array_distinct(F.filter(hosts, X.valid_domain))).alias("host"))


def class_names(parsed: DataFrame, keys) -> DataFrame:
    """Channel and member names (kind, pos, name) from elements of telling classes.

    Channel names are cleaned; member names are only kept to under 50 characters.
    """

    def named(kind, tags, pattern, to_name):
        found = F.filter(P.by_tag(_nodes(), *tags), lambda n: P.attr(n, "class").rlike(pattern))
        names = F.filter(F.transform(found, lambda n: to_name(P.text_of(_nodes(), n))), lambda x: x.isNotNull())
        return F.transform(
            names, lambda name, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), name.alias("name"))
        )

    short = lambda c: X.let(X.strip(c), lambda s: F.when((s != "") & (F.length(s) < 50), s))
    both = F.concat(
        named("channel", ("div", "li", "span"), R.CHANNEL_CLASS, X.clean_name),
        named("member", ("span", "div"), R.MEMBER_CLASS, short),
    )
    return parsed.select(*keys, F.explode(both).alias("n")).select(*keys, "n.*")


def paste_body(parsed: DataFrame, keys, site: str = "site") -> DataFrame:
    """Main content of a stored paste page, stripped; '' if there is none."""
    known = list(dict.fromkeys(s for s, *_ in R.BODY_RULES))

    def fits(tags, el_id, cls):
        def test(n):
            ok = n["tag"].isin(*tags)
            ok = ok & (P.attr(n, "id") == el_id) if el_id else ok
            return ok & P.has_class(n, cls) if cls else ok

        return P.first(F.filter(_nodes(), test))

    generic = F.coalesce(
        P.first(P.by_tag(_nodes(), *R.GENERIC_BODY_TAGS)),
        P.first(F.filter(_nodes(), lambda n: (n["tag"] == "div") & P.attr(n, "class").rlike(R.GENERIC_BODY_CLASS))),
    )
    element = None
    for s in known:
        choice = F.coalesce(*[fits(t, i, c) for s2, t, i, c in R.BODY_RULES if s2 == s])
        here = F.contains(F.col(site), F.lit(s))
        element = F.when(here, choice) if element is None else element.when(here, choice)
    element = element.otherwise(generic)
    return parsed.withColumn("_body", element).select(*keys, X.strip(P.text_of(_nodes(), F.col("_body"))).alias("body"))


def _boxes(rule: R.SiteRule) -> Column:
    def test(n):
        ok = n["tag"].isin(*rule.box_tags)
        ok = ok & P.has_class(n, rule.box_class) if rule.box_class else ok
        return ok & P.attr(n, "class").rlike(rule.box_like) if rule.box_like else ok

    return F.filter(_nodes(), test)


def _pick(nodes: Column, tags, cls: str) -> Column:
    found = P.by_tag(nodes, *tags)
    return P.first(F.filter(found, lambda n: P.has_class(n, cls)) if cls else found)


def _item(rule: R.SiteRule, box: Column) -> Column:
    def parts(inner):
        holder = inner
        if rule.title_in:
            tag, cls = rule.title_in
            holder = P.below(_nodes(), _pick(inner, (tag,), cls))
        title = _pick(holder, rule.title_tags, rule.title_class)
        link = title if rule.own_link else P.first(
            F.filter(inner, lambda n: (n["tag"] == "a") & P.has_attr(n, "href"))
        )
        after = F.slice(_nodes(), box["id"] + 2, F.size(_nodes())) if rule.snippet_after else inner
        snippet = F.coalesce(*[_pick(after, t, c) for t, c in rule.snippets]) if rule.snippets else F.lit(None).cast(P.NODE)
        return F.struct(title.alias("title"), P.attr(link, "href").alias("href"), snippet.alias("snippet"))

    def item(found):
        title, href, snippet = found["title"], found["href"], found["snippet"]
        relative = (href != "") & ~F.startswith(href, F.lit("http"))
        return F.struct(
            F.when(title.isNull(), rule.default_title).otherwise(X.strip(P.text_of(_nodes(), title))).alias("title"),
            F.when(relative, F.concat(F.lit(rule.prefix), href)).otherwise(href).alias("url"),
            X.strip(P.text_of(_nodes(), snippet)).alias("snippet"),
        )

    return X.let(X.let(P.below(_nodes(), box), parts), item)


def result_items(parsed: DataFrame, keys, site_rules, site: str = "site", all_rules: bool = False) -> DataFrame:
    """Title, link and snippet of every result box on a result page.

    The first rule whose site name occurs in the page's site applies; with
    ``all_rules`` every fitting rule does, and a box may come up more than once.
    """

    def items(rule):
        found = F.transform(_boxes(rule), lambda b: _item(rule, b))
        if rule.need_title:
            found = F.filter(found, lambda i: i["title"] != "")
        return F.filter(found, lambda i: i["url"] != "") if rule.need_url else found

    fit = [(F.contains(F.col(site), F.lit(r.site)), items(r)) for r in site_rules]
    empty = F.array().cast("array<struct<title:string,url:string,snippet:string>>")
    if all_rules:
        found = F.concat(*[F.when(here, i).otherwise(empty) for here, i in fit])
    else:
        found = reduce(lambda other, hi: F.when(hi[0], hi[1]).otherwise(other), reversed(fit), empty)
    return parsed.select(*keys, site, F.posexplode(found).alias("pos", "i")).select(*keys, site, "pos", "i.*")


def mentioned(items: DataFrame, target: str, words=(), limit: int = 200) -> DataFrame:
    """Items that name the target in title or snippet, or one of the words in the title; long snippets are cut."""
    low = target.lower()
    test = F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("snippet"), F.lit(low))
    for w in words:
        test = test | F.contains(F.lower("title"), F.lit(w))
    return items.where((F.col("title") != "") & test).withColumn("snippet", X.truncate("snippet", limit))


def document_items(items: DataFrame) -> DataFrame:
    """Items that link to a document."""
    return items.where((F.col("url") != "") & X.is_document_link("url"))


def leaked_items(items: DataFrame, site: str = "site") -> DataFrame:
    """Items whose link names the page's site, with the risk level of their title."""
    named = (F.col("title") != "") & F.contains("url", F.col(site))
    return items.where(named).withColumn("risk_level", X.title_risk("title"))


def leak_references(items: DataFrame, target: str, site: str = "site") -> DataFrame:
    """Items whose title names the target; links without a scheme are put on the page's site."""
    absolute = F.when(F.startswith("url", F.lit("http")), F.col("url")).otherwise(
        F.concat(F.lit("https://"), site, "url")
    )
    return items.where(F.contains(F.lower("title"), F.lit(target.lower()))).withColumn("url", absolute)
