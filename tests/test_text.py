"""Edge rules of the text and host expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import hosts as H
from seepage.functions import text as X
from seepage.operators import scan as S


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_valid_domain(spark):
    good = ["example.com", "test.example.com", "a-b.co", "a--b.example.org", "x1.y2.zz", "a" * 63 + ".com"]
    bad = ["invalid..domain", "example", "-a.com", "a-.com", "a.c1", "a_b.com", "", None, "a" * 64 + ".com",
           ".".join(["a" * 60] * 5) + ".com", "*.example.com", "example.com."]
    assert values(spark, X.valid_domain, good) == [True] * len(good)
    assert values(spark, X.valid_domain, bad) == [False] * len(bad)


def test_valid_email(spark):
    good = ["test@example.com", "user@domain.co.uk", "a.b+c%d@x-y.org", "l" * 64 + "@example.com"]
    bad = ["invalid.email", "a@b", "a..b@example.com", ".a@example.com", "a@@example.com", "a b@example.com",
           "l" * 65 + "@example.com", "a@" + "b" * 64 + ".com", None]
    assert values(spark, X.valid_email, good) == [True] * len(good)
    assert values(spark, X.valid_email, bad) == [False] * len(bad)


def test_valid_url(spark):
    good = ["http://example.com", "HTTPS://Example.com:8443/a?b#c", "ftp://u:p@example.com/x", "http://10.0.0.1/",
            "http://localhost:80", "http://example.com?x=1", "http://" + "a" * 63 + ".com/x"]
    bad = ["example.com", "http://", "http://exa mple.com", "mailto:a@b.com", "http://-a.com", "http://256.1.1.1/",
           "http://example.com/a b", "//example.com/x", "http://" + "a" * 64 + ".com/x", None, ""]
    assert values(spark, X.valid_url, good) == [True] * len(good)
    assert values(spark, X.valid_url, bad) == [False] * len(bad)


def test_emails_are_lowered_validated_and_distinct(spark):
    text = "Mail A@Ex.com, a@ex.com; bad..dots@ex.com x@y.c|m and z@w.org."
    assert values(spark, X.emails, [text, "none", None]) == [["a@ex.com", "z@w.org"], [], []]


def test_phones(spark):
    assert values(spark, X.phones, ["+1 555-010-9999 or (555) 010.9999, 5550108888"]) == [
        ["(555) 010-9999", "(555) 010-8888"]
    ]


def test_social_handles_stop_list(spark):
    got = values(spark, X.social_handles, ["twitter.com/Home www.twitter.com/bob https://github.com/x-y facebook.com/a.b"])
    assert got == [{"twitter": ["bob"], "facebook": ["a.b"], "github": ["x-y"]}]


def test_social_handles_are_those_of_the_rules(spark):
    parts = ["https://", "HTTP://", "www.", "Twitter.com/", "github.com/", "facebook.com/", "linkedin.com/in/", "linkedin.com/company/", "a", "B_c", "d-e", "f.g",
             "/", " ", "\n", "é", "login", "https:/", "ww.", "twitter.com"]
    random.seed(5)
    texts = ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(3_000)]
    want = []
    for t in texts:
        found = {name: {h for h in re.findall(p, t) if h.lower() not in R.HANDLE_STOP_LIST} for name, p in R.SOCIAL_RULES}
        want.append({name: sorted(hs) for name, hs in found.items() if hs})
    assert values(spark, lambda c: X.social_handles(c, c), texts) == want and sum(map(len, want)) > 1_000


@pytest.mark.parametrize(
    "value, kind",
    [("", "plaintext"), (None, "plaintext"), ("a" * 32, "md5"), ("A" * 40, "sha1"), ("0" * 64, "sha256"),
     ("$2b$12$" + "x" * 53, "bcrypt"), ("$6$abc", "hashed"), ("z" * 51, "likely_hash"), ("z" * 50, "plaintext")],
)
def test_digest_kind(spark, value, kind):
    assert values(spark, X.digest_kind, [value]) == [kind]


def test_truncate(spark):
    assert values(spark, lambda c: X.truncate(c, 5), ["12345", "123456", "", None]) == ["12345", "12345...", "", None]


def test_mention_count(spark):
    count = lambda c: X.mention_count(c, F.lit("A.com"))
    assert values(spark, count, ["a.com A.COM xa.comx", "aacom", "", None]) == [3, 0, 0, 0]


def test_mentions_target(spark):
    test = lambda c: X.mentions_target("acme.co.uk", c)
    assert values(spark, test, ["ACME inc", "see acmecouk", "ac me", None]) == [True, True, False, False]


def test_clean_name(spark):
    assert values(spark, X.clean_name, [" # gen eral! ", "***", "", "x" * 49, "x" * 50, None]) == [
        "general", None, None, "x" * 49, None, None
    ]


def test_document_links(spark):
    urls = ["https://x.org/orari/1", "https://x.org/a.PDF", "https://x.org/a.pdf?x=1", "https://x.org/"]
    assert values(spark, X.is_document_link, urls) == [True, True, True, False]
    assert values(spark, lambda c: X.is_document_link(c, strict=True), urls) == [False, True, True, False]
    assert values(spark, X.file_type, ["a.tar.gz", "a.DOCX", "a.gz", "apdf"]) == ["tar.gz", "docx", "unknown", "unknown"]


def test_readable_urls(spark):
    urls = ["", None, "#x", "http://a/b.PDF", "http://a/b.pdf?x", "http://a/b.pptx", "http://a/doc"]
    assert values(spark, X.is_readable_url, urls) == [False, False, False, False, True, False, True]


def test_clean_domain(spark):
    urls = [" HTTPS://Ex.com:80/a ", "ex.com/x:1", "http://http://x", "ftp://ex.com"]
    assert values(spark, H.clean_domain, urls) == ["ex.com", "ex.com", "http", "ftp"]


def test_belongs_to(spark):
    test = lambda c: H.belongs_to(c, F.lit("ex.com"))
    assert values(spark, test, ["ex.com", "a.ex.com", "notex.com", "ex.com.au"]) == [True, True, False, False]


def test_host_cuts(spark):
    assert values(spark, H.suffixes, ["a.b.c"]) == [["a.b.c", "b.c", "c"]]
    assert [tuple(x) for x in values(spark, H.splits, ["a.b.c"])[0]] == [("a", "b.c"), ("a.b", "c")]
    assert values(spark, H.cut_prefixes, ["a.b-c.d"]) == [["a", "a.b", "a.b-c", "a.b-c.d"]]


def test_templates(spark):
    df = spark.range(1).select(
        X.fill_template("{f}-{last}@{domain}!", f=F.lit("a"), last=F.lit("b"), domain=F.lit("c.d")).alias("x")
    )
    assert df.first().x == "a-b@c.d!"


SECRETS = {
    "api_key": "api" + "_key: '" + "k" * 24 + "'",
    "aws_access_key": "AK" + "IA" + "ABCDEFGHIJKLMNOP",
    "aws_secret_key": "aws" + "_secret_access_key=" + "s" * 38 + "/+",
    "github_token": "gh" + "p_" + "t" * 36,
    "slack_token": "xo" + "xb-1234567890ab",
    "password": "pass" + 'word = "hunter2hunter2"',
    "private_key": "-----BEGIN " + "EC PRIVATE KEY-----",
}


def test_every_code_rule_and_no_secret_leaves(spark):
    rows = [(i, f"text {v} text") for i, v in enumerate(SECRETS.values())] + [(99, "clean")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in S.scan_kinds(df, ["id"], "text", R.CODE_RULES).collect()}
    assert [got[i].kind for i in range(len(SECRETS))] == list(SECRETS)
    assert 99 not in got
    masked = S.scan_secrets(df, ["id"], "text", R.CODE_RULES, "salt").collect()
    shown = " ".join(repr(r) for r in [*got.values(), *masked])
    for secret in ("k" * 24, "ABCDEFGHIJKLMNOP", "s" * 38, "t" * 36, "hunter2", "1234567890ab"):
        assert secret not in shown


@pytest.mark.parametrize("rules", [R.PASTE_RULES, R.DOCUMENT_RULES, R.CODE_RULES, R.CHAT_RULES])
def test_cheap_tests_lose_no_match(spark, rules):
    texts = [
        "a@b.com +1 (555) 010-9999 10.0.0.1 http://x.y 123-45-6789 4111111111111111 api" + "_key=abc pass" + "wd=xxxxxxxxx",
        "ACCESS-TOKEN: x PWD:y 378282246310005 30569309025904 6011000990139424 AKIA" + "0" * 16 + " aws_access_key_id",
        "redis" + "://x eyJ.eyJ. -----BEGIN RSA" + " PRIVATE KEY----- 5550109999 apikey='" + "a" * 20,
        "xoxb-1-1-a xoxp-1-1-1-a xoxa-1-1-1-a xoxr-1-1-a https://hooks." + "slack.com/services/A/B/c ghp_" + "a" * 36,
        "", "no hit",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for rule in rules:
        plain = df.select(X.matches("text", rule.pattern, rule.group).alias("m"))
        tested = df.select(X.rule_matches("text", F.lower("text"), rule).alias("m"))
        assert plain.collect() == tested.collect(), rule.kind


def test_user_rules(spark):
    rows = spark.createDataFrame([("k1", "a+b"), ("k2", "[0-9]{3}")], "kind string, pattern string")
    assert [r.kind for r in S.rules_from(rows)] == ["k1", "k2"]
    with pytest.raises(ValueError, match="k3"):
        S.rules_from(spark.createDataFrame([("k3", "(")], "kind string, pattern string"))
    many = spark.range(S.MAX_USER_RULES + 1).select(F.concat(F.lit("k"), "id").alias("kind"), F.lit("x").alias("pattern"))
    with pytest.raises(ValueError, match="more than"):
        S.rules_from(many)


def test_redacted(spark):
    text = "mail a@b.com pass" + "word=tops3cret key AK" + "IA" + "Z" * 16
    got = values(spark, X.redacted, [text])[0]
    assert "a@b.com" in got and "tops3cret" not in got and "ZZZZ" not in got


def random_texts(alphabet, n, length):
    import random

    random.seed(11)
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, length))) for _ in range(n)]


def test_email_scan_finds_what_the_pattern_finds(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(["a", "b", "@", "@a.", ".co", "cd", "-", "%", "_", "é", " ", "|"], 30_000, 12)], "t string")
    plain = F.regexp_extract_all("t", F.lit(R.EMAIL), F.lit(0))
    assert df.where(F.size(plain) > 0).count() > 500
    assert df.where(plain != X.matches("t", R.EMAIL)).count() == 0


@pytest.mark.parametrize("mark, pattern", R.CREDENTIAL_PAIRS)
def test_pairs_start_at_runs(spark, mark, pattern):
    df = spark.createDataFrame([(t,) for t in random_texts(f"ab@{mark}{mark} .", 20_000, 16)], "t string")
    plain = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    guarded = F.regexp_extract_all("t", F.lit(rf"(?<![^{mark}\s]){pattern}"), F.lit(0))
    assert df.where(F.size(plain) > 0).count() > 500
    assert df.where(plain != guarded).count() == 0


def test_long_junk_takes_linear_time(spark):
    import time

    junk = spark.range(1).select(F.concat(F.repeat(F.lit("%41.b-"), 50_000), F.lit(" a@b.org ")).alias("t"))
    started = time.time()
    assert junk.select(X.emails("t")).first()[0] == ["a@b.org"]
    assert time.time() - started < 20
