"""Rule sets against texts: one scan, one projection for all rules, no shuffle."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, IllegalArgumentException, SparkRuntimeException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import text as X
from seepage.operators.matching import lookup_join, pattern_hits
from seepage.session import fits, settle

MAX_USER_RULES = 500


def findings(text: str, rules, lowered: str = "_lowered") -> Column:
    """Array of (kind, match_count, sample_matches) with one entry per rule that found something, in rule order.

    Samples are the first three values, masked as the rule says, so no secret
    leaves the expression. ``lowered`` names the column of the text in lower case.
    """
    hits = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.shown).alias("shown"), X.rule_matches(text, lowered, r).alias("hits"))
        for r in rules
    ]

    def entry(f):
        shown = (
            F.when(f["shown"] == "clear", X.shown_samples(f["hits"], "clear"))
            .when(f["shown"] == "redacted", X.shown_samples(f["hits"], "redacted"))
            .otherwise(X.shown_samples(f["hits"], "masked"))
        )
        return F.struct(f["kind"].alias("kind"), F.size(f["hits"]).alias("match_count"), shown.alias("sample_matches"))

    return F.transform(F.filter(F.array(*hits), lambda f: F.size(f["hits"]) > 0), entry)


def _with_lowered(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_lowered", F.lower(F.col(text)))


def with_findings(df: DataFrame, text: str, rules, name: str = "findings") -> DataFrame:
    """Add the findings array of a text."""
    return X.with_once(_with_lowered(df, text), name, findings(text, rules)).drop("_lowered")


def scan_kinds(df: DataFrame, keys, text: str, rules) -> DataFrame:
    """One row per (keys, kind) with the match count and the shown samples.

    The array is built inside the explode: Spark would put a size test on a
    finished column in front of it and search every text twice.
    """
    rows = _with_lowered(df.select(*keys, text), text).select(*keys, F.explode(findings(text, rules)).alias("f"))
    return rows.select(*keys, "f.*")


def scan_secrets(df: DataFrame, keys, text: str, rules, salt: str) -> DataFrame:
    """One row per match: kind, shape, length and keyed fingerprint. The value itself is dropped here."""
    found = F.array(
        *[
            F.struct(F.lit(r.kind).alias("kind"), X.rule_matches(text, "_lowered", r).alias("hits"))
            for r in rules
        ]
    )
    return (
        _with_lowered(df.select(*keys, text), text)
        .select(*keys, F.explode(F.filter(found, lambda f: F.size(f["hits"]) > 0)).alias("f"))
        .select(*keys, F.col("f.kind").alias("kind"), F.posexplode("f.hits").alias("pos", "value"))
        .select(
            *keys, "kind", "pos",
            X.masked("value").alias("masked"),
            F.length("value").alias("length"),
            X.fingerprint("value", salt).alias("fingerprint"),
        )
    )


def rules_from(rows: DataFrame, builtin=()) -> tuple:
    """Built-in rules plus the user's (kind, pattern) rows.

    A rule set is a small hand-written table; more rows than MAX_USER_RULES
    are refused rather than cut. Every pattern is tried on an empty text by the
    engine that will run it, so a bad one fails before the job starts.
    """
    got = rows.select("kind", "pattern").limit(MAX_USER_RULES + 1).collect()
    if len(got) > MAX_USER_RULES:
        raise ValueError(f"more than {MAX_USER_RULES} user rules")
    for r in got:
        try:
            rows.sparkSession.range(1).select(F.regexp_count(F.concat(F.lit(""), F.col("id")), F.lit(r.pattern))).collect()
        except (SparkRuntimeException, IllegalArgumentException, Py4JJavaError, AnalysisException) as e:
            raise ValueError(f"rule {r.kind!r}: {str(e).splitlines()[0]}") from e
    return tuple(builtin) + tuple(R.Rule(r.kind, r.pattern) for r in sorted(got))


def scan_rule_table(df: DataFrame, keys, text: str, rules: DataFrame) -> DataFrame:
    """One row per (keys, kind, pattern) with the match count and masked samples, for a rule table of any number of rows.

    ``rules`` has kind, pattern and hint: a string that every text the pattern
    matches contains, whatever its case, or null. Rules with a hint meet the
    texts that hold it through the n-gram index of ``pattern_hits``, so a text
    is searched for those rules only; nothing is collected. Rules without one
    must be tried on every text; they are one value that tasks receive, and are
    refused beyond the broadcast bounds. An equal rule counts once, and one without a kind or pattern is none. Every pattern
    is tried by the engine that will run it before the job starts. A null text
    has no matches; a row that occurs twice has its matches twice.
    """
    hint = F.nullif(F.lower(F.col("hint")), F.lit(""))
    rules = settle(rules.select("kind", "pattern", hint.alias("hint")).distinct().where("kind IS NOT NULL AND pattern IS NOT NULL"), "rules")
    try:
        rules.agg(F.sum(F.regexp_count(F.substring("kind", 1, 0), F.col("pattern")))).collect()
    except (SparkRuntimeException, IllegalArgumentException, Py4JJavaError) as e:
        raise ValueError(f"a rule's pattern: {str(e).splitlines()[0]}") from e
    names = [f"_own{i}" for i in range(len(keys))]
    texts = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text"))
    hinted = rules.where("hint IS NOT NULL")
    met = pattern_hits(texts, [*names, "_text"], "_text", hinted, "hint")
    tried = [lookup_join(met, hinted, "hint").select(*names, "_text", "kind", "pattern")]
    bare = rules.where("hint IS NULL").select("kind", "pattern")
    if not fits(bare):
        raise ValueError("more rules without a hint than a broadcast may hold")
    listed = bare.agg(F.sort_array(F.collect_list(F.struct("kind", "pattern"))))
    tried.append(texts.withColumn("_r", F.explode(listed.scalar())).select(*names, "_text", "_r.kind", "_r.pattern"))
    hits = F.regexp_extract_all("_text", F.col("pattern"), F.lit(0))
    found = tried[0].unionByName(tried[1]).select(*names, "kind", "pattern", hits.alias("_hits")).where(F.size("_hits") > 0)
    return found.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], "kind", "pattern", F.size("_hits").alias("match_count"),
        X.shown_samples(F.col("_hits"), "masked").alias("sample_matches"))
