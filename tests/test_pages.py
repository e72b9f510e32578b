"""Page parsing and the operators on node lists, on odd pages."""

import random

import duckdb
from checking import compare
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import html as P
from seepage.functions import text as X
from seepage.functions import hosts as H
from seepage.operators import pages as G
from seepage.plans import ORACLES, QUERIES


FRAGMENTS = (
    "< > \" ' </p> <p> <div_a=\"b\"> &amp; &lt & = / <!-- --> -- <script> </script> <style> </style> x <br/> <br> <title> </title>"
    " <a_href=\"u?x&y=1&copy=2\"> </a> <!DOCTYPE_html> <?pi?> <![CDATA[x]]> <A_HREF=\"Q\"> <input_required> <b_c=d> </b_> <textarea>"
    " </textarea> <p/> </SCRIPT> é <i_x=\"1\"_X=\"2\"> </br> <template> </template> __"
).split(" ")


def test_plain_pages_read_like_all_others():
    class General(P._NodeList):
        def _plain_page(self, html):
            return False

    random.seed(7)
    plain = 0
    for _ in range(20_000):
        page = "".join(random.choice(FRAGMENTS).replace("_", " ") for _ in range(random.randint(1, 9)))
        fast, general = P._NodeList(), General()
        fast.page(page)
        general.page(page)
        assert (fast.rows, fast.last) == (general.rows, general.last), page
        fast.start, fast.stack = 0, []
        plain += fast._plain_page(page)
    assert plain > 500  # both ways were taken


def parse(spark, *pages):
    rows = [(i, f"https://x.org/d/{i}", "site", h) for i, h in enumerate(pages)]
    return G.with_nodes(spark.createDataFrame(rows, "id int, url string, site string, html string"))


def test_nodes_and_ranges(spark):
    got = parse(spark, "<div a=1><p>x<b>y</p>z<br>w</div><i>t</i>", None, "").select("nodes").collect()
    nodes = [(n.tag, n.id, n.last, n.text) for n in got[0].nodes]
    # </p> also closes the open <b>; <br> holds nothing.
    assert nodes == [
        ("div", 0, 7, None), ("p", 1, 4, None), ("#text", 2, 2, "x"), ("b", 3, 4, None), ("#text", 4, 4, "y"),
        ("#text", 5, 5, "z"), ("br", 6, 6, None), ("#text", 7, 7, "w"), ("i", 8, 9, None), ("#text", 9, 9, "t"),
    ]
    assert got[1].nodes == [] and got[2].nodes == []


def test_visible_text(spark):
    page = "<p>a &amp; b</p><script>if (x</p>) {}</script><style>p{}</style><!-- c --><p> d  e\n\nf </p>"
    row = G.page_text(parse(spark, page), ["id"], limit=5).first()
    assert (row.content, row.content_length) == ("a & b", len("a & b d e f"))


def test_unclosed_and_stray_tags(spark):
    rows = parse(spark, "</div><p>one<p>two</x>", "<a href=x>l").select("id", P.texts(F.col("nodes")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ["onetwo", "l"]


def test_links(spark):
    page = (
        '<a href="/a b">1</a><a href="../up?q=1#f">2</a><a href="https://Y.org">3</a><a href="//z.org/x">4</a>'
        '<a href="mailto:a@b.c">5</a><a href="/a/../b">6</a><a>7</a><a href="">8</a><a href="http://[">9</a><a href="#f">10</a>'
    )
    links = {r.href: r.link for r in G.anchors(parse(spark, page), ["id"]).collect()}
    assert links == {
        "/a b": "https://x.org/a b", "../up?q=1#f": "https://x.org/up?q=1#f", "https://Y.org": "https://Y.org",
        "//z.org/x": "https://z.org/x", "mailto:a@b.c": "mailto:a@b.c", "/a/../b": "https://x.org/b",
        "": "https://x.org/d/0", "http://[": None, "#f": "https://x.org/d/0#f",
    }
    valid = {r.link for r in G.page_links(parse(spark, page + page), ["id"]).collect()}
    assert valid == {
        "https://x.org/up?q=1#f", "https://Y.org", "https://z.org/x", "https://x.org/b", "https://x.org/d/0",
        "https://x.org/d/0#f",
    }


def test_plain_urls_agree_with_the_general_join(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b", "https://h.org:8/", "http://h.org?x", "HTTP://H.org/x", "nohost", ""]
    links = ["/", "/x/y", "/x-y_z~", "/x;p", "//o.org/x", "http://o.org", "https://o.org/", "ftp://f.org/x", "/x y", "x", "/ü"]
    df = spark.createDataFrame([(b, links) for b in bases], "base string, links array<string>")
    for row in df.withColumn("ready", H.plain_urls("base", "links")).collect():
        for link, ready in zip(row.links, row.ready):
            assert ready is None or ready == urljoin(row.base, link), (row.base, link)


def test_links_are_tested_alike_on_any_base(spark):
    hrefs = ["/x", "/", "/a b", "x y", "?q=1", "#f", "/a/../b", "//h.org/x", "http://h.org", "http://h.org/x&#10;", "http://h.org/x&#133;",
             "/é", "http://h.org:8/", "http://u@h.org/ x", "ftp://h.org/x", "HTTP://h.org/y", "http://h.org.evil.net/", "http://["]
    page = "".join(f'<a href="{h}">x</a>' for h in hrefs)
    bases = ["http://h.org/d/0", "http://u@h.org:8/", "http://-bad-.org/", "http://h.org", "http://h.org\n", "h.org/x", "", None, "http://u x@h.org/"]
    parsed = G.with_nodes(spark.createDataFrame([(i, b, page) for i, b in enumerate(bases)], "id int, url string, html string"))
    want = G.anchors(parsed, ["id"]).where(X.valid_url("link")).select("id", "link").distinct()
    links = G.page_links(parsed, ["id"])
    assert sorted(links.collect()) == sorted(want.collect()) and links.count() > 40
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "_sound" in plan  # a page's own host is tested once, not with every link


def test_join_urls_keeps_nulls_and_places(spark):
    rows = [(0, "http://h.org/d/", ["x", None, "http://["]), (1, None, ["y"]), (2, "http://h.org", None), (3, "b", []), (4, "c", [None, None])]
    df = spark.createDataFrame(rows, "id int, base string, links array<string>").repartition(1)
    got = {r.id: r.j for r in df.select("id", H.join_urls("base", "links").alias("j")).collect()}
    assert got == {0: ["http://h.org/d/x", None, None], 1: ["y"], 2: None, 3: [], 4: [None, None]}


def test_link_split_keeps_user_and_port(spark):
    df = spark.createDataFrame([("https://u@a.org:8/x",), ("https://org/x",), ("https://b.net/",)], "link string")
    got = {r.link: r.is_internal for r in G.split_links(df, F.lit("a.org")).collect()}
    assert got == {"https://u@a.org:8/x": True, "https://org/x": True, "https://b.net/": False}


def test_metadata_last_value_holds(spark):
    page = (
        '<title> T </title><meta name="A" content="1"><meta name="a" content="2"><meta name="b" content="">'
        '<meta property="og:x" content=""><meta property="other" content="y"><title>second</title>'
    )
    got = {r.name: r.value for r in G.page_metadata(parse(spark, page), ["id"]).collect()}
    assert got == {"title": "T", "meta_a": "2", "og:x": ""}


def test_comments_and_structure(spark):
    page = "<!-- a --><h1>x</h1><h3>y</h3><h3>z</h3><!--b--><link rel='alternate stylesheet'><img><script></script>"
    parsed = parse(spark, page)
    assert [r.comment for r in G.page_comments(parsed, ["id"]).orderBy("pos").collect()] == ["a", "b"]
    s = G.page_structure(parsed, ["id"]).first()
    assert (s.headings, s.images, s.links, s.forms, s.scripts, s.stylesheets) == ({"h1": 1, "h3": 2}, 1, 0, 0, 1, 1)


def test_forms(spark):
    page = "<form ACTION=/a METHOD=Post><p><input name=n required><select></select></p></form><input name=outside>"
    form = G.page_forms(parse(spark, page), ["id"]).collect()
    assert len(form) == 1 and (form[0].action, form[0].method) == ("/a", "post")
    assert [(f.tag, f.name, f.required) for f in form[0].fields] == [("input", "n", True), ("select", "", False)]


def test_items_without_title_or_link(spark):
    items = G.result_items(parse(spark, '<div class="g">x</div><div class="big">y</div>'), ["id"], R.MENTION_LIST_RULES[:1])
    assert items.count() == 0  # the page's site fits no rule
    page = parse(spark, '<div class="g"><p>only text</p></div>').withColumn("site", F.lit("google.com"))
    row = G.result_items(page, ["id"], R.MENTION_LIST_RULES).first()
    assert (row.title, row.url, row.snippet) == ("No title", "", "only text")


def test_nested_boxes_are_both_listed(spark):
    page = '<li class="item"><h2>outer</h2><div class="result"><a href="/i">inner</a></div></li>'
    items = G.result_items(parse(spark, page), ["id"], R.PASTE_LIST_RULES)
    assert sorted((r.title, r.url) for r in items.collect()) == [("inner", "/i"), ("outer", "/i")]


def test_tld_hosts(spark):
    page = (
        '<a href="http://u@ab.onion/x">1</a><a href="cd.onion/x">2</a><a href="https://ef.onion:80/">3</a>'
        '<a href="x/gh.onion">4</a><a href="http://ab.onion.org/">5</a><a href="cd.onion">6</a>'
    )
    got = sorted(r.host for r in G.hosts_by_tld(parse(spark, page), ["id"]).collect())
    assert got == ["cd.onion", "u@ab.onion"]


def test_names(spark):
    page = '<div class="channel-list"># a b</div><span class="room">***</span><div class="member">Jo Doe</div><li class="user">x</li>'
    got = {(r.kind, r.name) for r in G.class_names(parse(spark, page), ["id"]).collect()}
    assert got == {("channel", "ab"), ("member", "Jo Doe")}


def test_contact_info_query_has_every_kind(spark, tmp_path):
    pages = [
        (1, '<p>me@a.org or 555-010-1234</p><a href="https://www.twitter.com/bob">t</a><a href="https://twitter.com/Login">l</a>'),
        (2, "<p>github.com/a-b, linkedin.com/in/c </p><!-- github.com/z --><p>facebook.com/d<b>e</b></p>"),
        (3, "<p>12 Main Street, Springfield</p>"), (4, ""),
    ]
    spark.createDataFrame(pages, "page_id bigint, html string").withColumn("url", F.lit("https://x.org/")).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {r.page_id: r for r in QUERIES["contact_info"](spark, str(tmp_path)).collect()}
    assert {k: r.social_media for k, r in got.items()} == {
        1: "twitter=bob", 2: "facebook=d,de;github=a-b,z;linkedin=c", 3: "", 4: "",
    }
    assert (got[1].emails, got[1].phones, got[3].addresses) == ("me@a.org", "(555) 010-1234", "12 Main Street, Springfield")
    assert compare(spark, con, str(tmp_path), QUERIES["contact_info"], ORACLES["contact_info"]) is None


def test_handles_in_attributes_written_with_entities(spark):
    pages = parse(spark, '<a href="https:&#x2F;&#x2F;github.com&#x2F;carol" title="twitter.com&#47;eve">x</a><br>', '<a href="//facebook.com/d?x=1&amp;y">x</a>', "&", None)
    got = {r.id: r.social_media for r in G.contact_info(pages, ["id"]).collect()}
    assert got == {0: {"github": ["carol"], "twitter": ["eve"]}, 1: {"facebook": ["d"]}, 2: {}, 3: {}}
