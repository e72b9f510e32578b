"""Joins, keep-first rules, scores and the link walk against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.operators import certs as K
from seepage.operators import dedupe as U
from seepage.operators import dumps as L
from seepage.operators import matching as J
from seepage.operators import roster as M
from seepage.operators import score as C


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key; some rows are equal."""
    data = [("hot" if i % 3 == 0 else f"k{i % 40}", i % 50, f"p{i % 7}") for i in range(600)]
    return spark.createDataFrame(data, "k string, o int, payload string"), data


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, hot, how):
    facts, _ = hot
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, v int")
    small = J.lookup_join(facts, lookup, "k", how)
    large = J.lookup_join(facts, lookup, "k", how, max_rows=0)
    assert "_salt" not in large.columns
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))


def test_fits(spark):
    df = spark.range(10).withColumn("s", F.lit("x" * 100))
    assert J.fits(df, 10) and not J.fits(df, 9) and not J.fits(df, 10, size=500)
    assert J.fits(df.where("id < 0"), 0)


def test_keep_first(hot):
    df, data = hot
    want = {}
    for k, o, p in sorted(data):
        want.setdefault(k, (k, o, p))
    assert rows(U.keep_first(df, ["k"], ["o", "payload"])) == sorted(want.values())


def test_keep_first_merges_before_the_shuffle(hot):
    plan = U.keep_first(hot[0], ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_keep_first_or_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None)], "i int, s string")
    assert [r.i for r in U.keep_first_or_empty(df, "s", ["i"]).orderBy("i").collect()] == [1, 3, 4, 5]


def test_keep_first_without_a_sort(spark):
    """Fixed-width orders: same rows as the sorted aggregate, null keys and null ranks included."""
    from datetime import date, datetime

    random.seed(8)
    rows_ = [(random.choice(["a", "b", None, "c", f"k{i}"]), i if i % 50 else None, i % 3 == 0, date(2000 + i % 40, 1, 1),
              datetime(1960 + i % 80, 1, 1), f"text {i}") for i in random.sample(range(-200, 200), 300)]
    df = spark.createDataFrame([r for r in rows_ if r[1] is not None] + [("c", None, None, None, None, "no rank")],
                               "k string, n long, b boolean, d date, t timestamp, text string")
    for order in (["n"], [F.col("n").cast("int"), "b"], ["d", "n"], [F.col("n").cast("smallint"), "t", "b"]):
        assert rows(U.keep_first(df, ["k"], order, unique=True)) == rows(U.keep_first(df, ["k"], order))
    some = F.col("k") == "a"
    assert rows(U.keep_first(df, ["k"], ["n"], unique=True, where=some)) == rows(U.keep_first(df, ["k"], ["n"], where=some))
    assert U.packed_rank(df, [F.col("text")]) is None and U.packed_rank(df, [F.col("n"), F.col("t")]) is None
    text = U.keep_first(df, ["k"], ["n"], unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "Exchange hashpartitioning" not in text


def test_dedupe_ordered(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)], "v string, pos int")
    assert [r.v for r in U.dedupe_ordered(df, "v", "pos").collect()] == ["b", "a", "c"]


def test_sample_per_group_filters_before_the_shuffle(hot):
    df = U.sample_per_group(hot[0], ["k"], ["o", "payload"], 3)
    assert df.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_pattern_hits_paths_agree(spark, monkeypatch):
    random.seed(5)
    letters = lambda n: "".join(random.choice("ab.c \U0001f511é") for _ in range(n))
    texts = [(i, letters(40).upper() if i % 2 else letters(40)) for i in range(60)] + [(60, None), (61, ""), (61, "ab.c ab.c")]
    words = sorted({letters(random.randint(1, 9)) for _ in range(80)} - {""})
    corpus = spark.createDataFrame([(*t, "x", "y") for t in texts], "id int, text string, p string, g string")
    patterns = spark.createDataFrame([(w,) for w in [*words, "", None]], "pattern string")
    want = sorted((i, w) for i, t in texts for w in words if t and w in t.lower())
    run = lambda **kw: rows(J.pattern_hits(corpus, ["id"], "text", patterns, **kw))
    assert run() == want
    assert run(gram=3) == want
    monkeypatch.setattr(J, "MAX_GRAMS", 0)  # beyond any broadcast
    assert run(gram=2) == want
    assert J.pattern_hits(corpus, ["id"], "text", patterns.where("false")).count() == 0


def test_very_many_phrases(spark):
    """300,000 phrases against texts that hold few of them; no phrase passes through the driver."""
    phrases = spark.range(300_000).select(F.format_string("host-%06d.example.org", "id").alias("pattern"))
    corpus = spark.range(400).select("id", F.concat(F.lit("see HOST-"), F.lpad((F.col("id") * 900).cast("string"), 6, "0"),
                                                  F.when(F.col("id") % 2 == 0, ".example.org").otherwise(".example.com")).alias("text"))
    found = J.pattern_hits(corpus, ["id"], "text", phrases)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert rows(found) == [(i, f"host-{i * 900:06d}.example.org") for i in range(0, 334, 2)]


def test_watchlist_hits(spark):
    df = spark.createDataFrame([("A.B.example.com",), ("notexample.com",), ("example.com",), ("x.org",), (None,)], "host string")
    watch = spark.createDataFrame([("example.com",), ("Example.com",), ("b.example.com",), ("com",)], "domain string")
    assert rows(J.watchlist_hits(df, "host", watch)) == sorted(
        [("b.example.com", "A.B.example.com"), ("example.com", "A.B.example.com"), ("com", "A.B.example.com"),
         ("com", "notexample.com"), ("com", "example.com"), ("example.com", "example.com")]
    )


def test_known_hosts_prefers_a_records(spark):
    dns = spark.createDataFrame(
        [("www.x.org", "CNAME"), ("www.x.org", "a"), ("a.b.x.org", "AAAA"), ("mx.x.org", "MX"), ("zz.x.org", "A")],
        "host string, rtype string",
    )
    words = spark.createDataFrame([("WWW",), ("a.b",), ("mx",)], "word string")
    domains = spark.createDataFrame([("x.org",), ("y.org",)], "domain string")
    assert rows(J.known_hosts(words, domains, dns)) == [("a.b.x.org", "AAAA"), ("www.x.org", "A")]


def test_new_only(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "id string, o int")
    assert rows(J.new_only(df, spark.createDataFrame([("b",), ("b",)], "id string"), "id", ["o"])) == [("a", 1), ("c", 4)]


def test_reachable(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y"), ("d", "d"), ("a", "b")]
    df = spark.createDataFrame(edges, "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert rows(J.reachable(df, start)) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert rows(J.reachable(df, start, max_pages=3)) == [("a", 0), ("b", 1), ("c", 2)]
    at_hand = spark.createDataFrame([("a",), ("b",), ("d",)], "url string")
    assert rows(J.reachable(df, start, at_hand)) == [("a", 0), ("b", 1), ("d", 2)]
    long = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(25)], "src string, dst string")
    assert J.reachable(long, spark.createDataFrame([("000",)], "url string")).agg(F.max("depth")).first()[0] == 25


def test_reachable_moves_each_link_once(spark, monkeypatch):
    edges = [("a", "b"), ("a", "b"), ("b", "a"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "z")]
    df, start = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",)], "url string")
    at_hand = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "url string")
    kept, settle = [], J.settle

    def listed(made, name):
        if name == "links":
            kept.append(made)
        return settle(made, name)

    monkeypatch.setattr(J, "settle", listed)
    assert rows(J.reachable(df, start, at_hand)) == [("a", 0), ("b", 1), ("c", 2)]
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan  # links are not compared with each other
    assert plan.count("BroadcastExchange") == 1  # the start pages, which were measured; stored pages are not
    assert rows(kept[0]) == [("a", "b"), ("a", "b"), ("b", "c"), ("c", "b")]


def test_dump_emails_word_boundary(spark):
    lines = spark.createDataFrame(
        [("f", "Bob@Corp.com:x"), ("f", "al@corp.com.au|y"), ("f", "cy@corp.com-x"), ("f", "di@corp.comx"), ("f", "ed@corp.com_x"),
         ("f", "fy@sub.corp.com;z"), ("g", "bob@corp.com later"), ("f", "a@z.org@corp.com")],
        "source_file string, line string",
    )
    got = {r.email: (r.source_file, r.line_content) for r in L.dump_emails(
        lines, spark.createDataFrame([("corp.com",)], "domain string")).collect()}
    assert set(got) == {"bob@corp.com", "al@corp.com", "cy@corp.com", "z.org@corp.com"}
    assert got["bob@corp.com"] == ("f", "Xxx@Xxxx.xxx:x")


def test_credential_pairs(spark):
    mark = {":": "s1", ";": "s2", ",": "s3", "|": "s4", "\t": "s5"}
    data = [("f", f"u@corp.com{m}{s}") for m, s in mark.items()]
    data += [("f", "u@corp.com:s1"), ("g", "u@corp.com:s1"), ("f", "v@corp.com:" + "a" * 32), ("f", "w@other.org:s"),
             ("f", "bad@@corp.com:s"), ("f", "mycorp.com@x.org:s")]
    lines = spark.createDataFrame(data, "source_file string, line string")
    got = L.credential_exposure(lines, "Corp.com", "salt").collect()
    assert sorted((r.email, r.password_hash_type, r.password_length, r.source_file) for r in got) == sorted(
        [("u@corp.com", "plaintext", 2, "f")] * 5 + [("v@corp.com", "md5", 32, "f"), ("mycorp.com@x.org", "plaintext", 1, "f")]
    )
    assert not {"s1", "s2", "s3", "s4", "s5"} & {str(v) for r in got for v in r}


def test_certificates(spark):
    entries = spark.createDataFrame(
        [
            (1, "2024-01-02T00:00:00", "", "2020-01-01T00:00:00", "x.org", None, "s", "*.x.org\n a.x.org \nbad name"),
            (2, "2024-01-03T00:00:00", "", "2020-01-01T00:00:00.5", "y.org", "I", "s", "y.org"),
            (3, None, "", "", "", "I", "", None),
            (4, "2024-01-01T00:00:00", "", "2030-01-01T00:00:00", "*.b.x.org", "I", "", "notx.org"),
        ],
        "id long, entry_timestamp string, not_before string, not_after string, common_name string, issuer_name string,"
        " serial_number string, name_value string",
    )
    certs = K.parse_certificates(entries, "x.org", "2024-06-01T00:00:00")
    got = {r.id: r for r in certs.collect()}
    assert [got[i].expired for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[1].subject_alt_names == ["*.x.org", "a.x.org"]
    assert got[1].target_domains == ["*.x.org", "a.x.org", "x.org"] and got[4].target_domains == ["*.b.x.org"]
    assert [r.id for r in K.dedupe_certificates(certs).collect()] == [1, 4, 3]
    at = "2024-06-01T00:00:00"
    for keep in (True, False):
        longer = K.dedupe_certificates(K.active(certs, keep))
        assert K.certificates(entries, "x.org", at, keep).collect() == longer.collect()
    assert [r.id for r in K.certificates(entries, "x.org", at, max_certificates=2).collect()] == [2]
    assert [r.subdomain for r in K.subdomains(certs).collect()] == ["a.x.org", "b.x.org", "x.org"]
    assert tuple(K.stats(certs).first()) == (4, 2, 1, 3)
    assert tuple(K.stats(certs.where("false")).first()) == (0, 0, 0, 0)
    assert [r.id for r in K.active(K.parse_certificates(K.limit_entries(entries, 2, ["id"]), "x.org", "2024-06-01T00:00:00")).collect()] == [2]


def test_scores_and_tiers(spark):
    data = [
        ("none", "plain", 0, "low", "paste"), ("ip", "10.0.0.1", 3, "low", "paste"),
        ("ip + mention", "10.0.0.1 acme.com", 5, "medium", "paste"), ("mentions", "acme.com " * 9, 5, "medium", "paste"),
        ("db", "redis" + "://h", 8, "high", "code_exposure"), ("mail", "a@b.org", 6, "medium", "credential_leak"),
        ("mail + key", "a@b.org api" + "_key=1", 10, "high", "credential_leak"),
    ]
    df = spark.createDataFrame([d[:2] for d in data], "name string, text string")
    scored = C.score_content(df, "text", "acme.com").select("name", "risk_score", C.tier().alias("t"), C.category().alias("c"))
    assert {r.name: tuple(r)[1:] for r in scored.collect()} == {d[0]: d[2:] for d in data}


def test_roster(spark):
    answers = spark.createDataFrame([('{"members":[{"name":"a","profile":{}},{"is_admin":true}]}',), ("not json",), ("{}",)], "j string")
    assert rows(M.roster_users(answers, [], "j")) == [("", "", "", "", True), ("a", "", "", "", False)]
    people = spark.createDataFrame([(" Ann ", "Lee", "X.org")], "first string, last string, domain string")
    got = {r.email for r in M.roster_variants(people).collect()}
    assert got == {"ann.lee@x.org", "annlee@x.org", "ann_lee@x.org", "ann@x.org", "lee@x.org", "annl@x.org", "alee@x.org"}
    own = spark.createDataFrame([("{last}.{f}@{domain}",)], "template string")
    assert [r.email for r in M.roster_variants(people, own).collect()] == ["lee.a@x.org"]
    assert M.role_mailboxes(people).count() == len(R.ROLE_TEMPLATES)


def test_section_totals_lists_empty_sections(spark):
    one = spark.createDataFrame([("i", "u", "d")], "item string, url string, detail string")
    assert rows(C.section_totals(C.report_long({"a": one, "b": one.union(one)}), ("a", "b", "c"))) == [("a", 1), ("b", 2), ("c", 0)]


def test_template_tables_of_any_size(spark):
    people = spark.createDataFrame([("Ann", "Lee", "x.example.com"), ("{f}", "Ö", "y.example.com")], "first string, last string, domain string")
    templates = ["{first}.{last}@{domain}", "{f}{l}@{domain}", "{who}", "plain", "{first}{first}", "{"] + [f"n{i}-{{last}}" for i in range(300)]
    values = {"first": F.col("first"), "last": F.col("last"), "domain": F.col("domain"), "f": F.substring("first", 1, 1), "l": F.substring("last", 1, 1)}
    table = spark.createDataFrame([(t,) for t in templates], "template string")
    got = {(r.first, r.template): r.out for r in J.expand_templates(people, table, "out", **values).collect()}
    assert len(got) == 2 * len(templates)
    assert got["Ann", templates[0]] == "Ann.Lee@x.example.com" and got["{f}", templates[0]] == "{f}.Ö@y.example.com"
    assert got["Ann", "{f}{l}@{domain}"] == "AL@x.example.com" and got["Ann", "{who}"] == "{who}" and got["Ann", "{"] == "{"
    assert got["{f}", "{first}{first}"] == "{f}{f}" and got["Ann", "n299-{last}"] == "n299-Lee"
