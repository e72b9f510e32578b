"""Content risk and exposure summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import text as X
from seepage.operators.scan import with_findings


def _kinds(rules, exposes: str):
    return [r.kind for r in rules if r.exposes == exposes]


def risk_columns(findings: str, mentions: Column, rules=R.PASTE_RULES) -> dict[str, Column]:
    """Score 0..10 and the two flags, from the kinds present in a findings array."""
    kinds = F.transform(F.col(findings), lambda f: f["kind"])
    points = lambda ks: reduce(
        Column.__add__, [F.when(F.array_contains(ks, r.kind), r.weight).otherwise(0) for r in rules]
    )
    mentioned = F.when(mentions > 0, F.least(mentions * 2, F.lit(5))).otherwise(0)
    overlap = lambda names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    return {
        "risk_score": F.least(X.let(kinds, points) + mentioned, F.lit(10)).cast("int"),
        "has_credentials": F.coalesce(overlap(_kinds(rules, "credentials")), F.lit(False)),
        "has_code": F.coalesce(overlap(_kinds(rules, "code")), F.lit(False)),
        "target_mentions": mentions,
    }


def score_content(df: DataFrame, text: str, target: str, rules=R.PASTE_RULES) -> DataFrame:
    """Add findings, score, flags and mention count of the content. Works on batch and streaming frames."""
    scanned = with_findings(df, text, rules, "sensitive_data")
    return scanned.withColumns(risk_columns("sensitive_data", X.mention_count(text, F.lit(target)), rules))


def document_analysis(df: DataFrame, keys, text: str, target: str, rules=R.DOCUMENT_RULES, metadata: str = "metadata") -> DataFrame:
    """One row per document: text_length, sensitive_data (the findings), target_mentions and metadata."""
    scanned = with_findings(df, text, rules, "sensitive_data")
    return scanned.select(
        *keys, F.length(text).alias("text_length"), "sensitive_data",
        X.mention_count(text, F.lit(target)).alias("target_mentions"), F.col(metadata).alias("metadata"),
    )


def tier(score="risk_score") -> Column:
    score = F.col(score)
    return F.when(score >= 8, "high").when(score >= 5, "medium").otherwise("low")


def category() -> Column:
    """Credentials win over code."""
    return F.when(F.col("has_credentials"), "credential_leak").when(F.col("has_code"), "code_exposure").otherwise("paste")


def tallies() -> dict[str, Column]:
    """Counts over scored pastes, for batch and streaming frames alike."""
    count_of = lambda c: F.count_if(c)
    return {
        "total_pastes_found": F.count(F.lit(1)),
        "credential_leaks": count_of(category() == "credential_leak"),
        "code_exposures": count_of(category() == "code_exposure"),
        "high_risk_pastes": count_of(tier() == "high"),
        "medium_risk_pastes": count_of(tier() == "medium"),
        "low_risk_pastes": count_of(tier() == "low"),
    }


def site_counts(at: str) -> list[Column]:
    """The tallies of a site, and when it was last seen with a detection."""
    return [*[c.alias(n) for n, c in tallies().items()], F.max(at).alias("last_checked")]


def exposure_summary(scored: DataFrame, sites_checked: int, site: str = "site") -> DataFrame:
    """Totals over scored pastes, one row; sites are counted by hash aggregates, tallied first and then added up."""
    names = list(tallies())
    per_site = scored.groupBy(F.col(site).alias("site")).agg(*[c.alias(n) for n, c in tallies().items()])
    return totals_of_sites(per_site, names, sites_checked)


def totals_of_sites(per_site: DataFrame, names=None, sites_checked: int = 0) -> DataFrame:
    """One row from the tallies of each site, such as a stream keeps."""
    names = names or list(tallies())
    return per_site.agg(
        F.lit(sites_checked).cast("bigint").alias("total_sites_checked"),
        F.count("site").alias("sites_with_detections"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )


def sites_with_hits(scored: DataFrame, at: str, site: str = "site") -> DataFrame:
    return scored.groupBy(site).agg(
        F.lit("detections_found").alias("status"), F.max(at).alias("last_checked")
    )


def report_long(sections: dict[str, DataFrame], tagged=()) -> DataFrame:
    """All result kinds in one table (section, item, url, detail).

    Each frame brings item, url and detail; those of ``tagged`` bring their
    section too, so that rows of several sections are made in one pass.
    """
    frames = [df.withColumn("section", F.lit(name)) for name, df in sections.items()] + list(tagged)
    texts = [F.col(c).cast("string").alias(c) for c in ("section", "item", "url", "detail")]
    return reduce(DataFrame.unionByName, [df.select(*texts) for df in frames])


def section_totals(report: DataFrame, sections) -> DataFrame:
    """Rows per section, zero for the ones without rows."""
    counted = report.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    listed = report.sparkSession.createDataFrame([(s,) for s in sections], "section string")
    return listed.join(counted, "section", "left").select("section", F.coalesce("n", F.lit(0)).alias("n"))
