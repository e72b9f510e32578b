"""Certificate-log entries: names, expiry, dedupe, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions import hosts as H
from seepage.functions import text as X
from seepage.operators.dedupe import keep_first_or_empty


def is_expired(not_after, as_of) -> Column:
    """Earlier than ``as_of``; never for a missing value or one that is not to the second."""
    not_after = X._col(not_after)
    whole = not_after.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$")
    parsed = F.when(whole, F.try_to_timestamp(not_after, F.lit("yyyy-M-d'T'H:m:s")))
    return F.coalesce(parsed < F.to_timestamp(F.lit(as_of)), F.lit(False))


def alt_names(name_value) -> Column:
    """Valid names of a newline-separated blob. The wildcard is set aside for the test and kept in the name."""
    names = F.transform(F.split(X.or_empty(name_value), "\n"), X.strip)
    return F.filter(names, lambda n: X.valid_domain(H.strip_wildcard(n)))


def parse_certificates(entries: DataFrame, target: str, as_of: str, source: str = "ct_log") -> DataFrame:
    """Log entries as certificate rows with their names, the names of the target, and whether expired."""
    sans = F.col("subject_alt_names")
    of_target = F.filter(F.col("domains"), lambda d: H.belongs_to(H.strip_wildcard(d), F.lit(target)))
    return (
        entries.select(
            "id",
            F.col("entry_timestamp").alias("logged_at"),
            "not_before",
            "not_after",
            X.or_empty("common_name").alias("common_name"),
            X.or_empty("issuer_name").alias("issuer"),
            X.or_empty("serial_number").alias("serial_number"),
            F.lit(source).alias("source"),
            alt_names("name_value").alias("subject_alt_names"),
            is_expired("not_after", as_of).alias("expired"),
        )
        .withColumn("domains", F.array_sort(F.array_union(sans, F.array("common_name"))))
        .withColumn("target_domains", of_target)
    )


def active(certs: DataFrame, include_expired: bool = False) -> DataFrame:
    return certs if include_expired else certs.where(~F.col("expired"))


def limit_entries(entries: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` entries in input order, taken before any expiry filter."""
    return entries.orderBy(*order).limit(n)


def dedupe_certificates(certs: DataFrame) -> DataFrame:
    """First certificate per serial number by id, which tells certificates apart, all of those without one; newest log time first."""
    kept = keep_first_or_empty(certs, "serial_number", ["id"], unique=True)
    return kept.orderBy(F.desc_nulls_last("logged_at"), "id")


def certificates(entries: DataFrame, target: str, as_of: str, include_expired: bool = False,
                 max_certificates: int | None = None, order=("id",)) -> DataFrame:
    """From log entries to deduplicated certificates: limit, expiry filter, one per serial number, names.

    Gives the rows of ``dedupe_certificates(active(parse_certificates(...)))``, but reads the names of kept entries only.
    """
    entries = entries if max_certificates is None else limit_entries(entries, max_certificates, order)
    entries = entries if include_expired else entries.where(~is_expired("not_after", as_of))
    kept = parse_certificates(keep_first_or_empty(entries, "serial_number", ["id"], unique=True), target, as_of)
    return kept.orderBy(F.desc_nulls_last("logged_at"), "id")


def subdomains(certs: DataFrame) -> DataFrame:
    """Distinct valid hosts of the target over all certificates, sorted."""
    name = H.strip_wildcard("name")
    return (
        certs.select(F.explode("target_domains").alias("name"))
        .select(name.alias("subdomain"))
        .where(X.valid_domain("subdomain"))
        .distinct()
        .orderBy("subdomain")
    )


def issuers(certs: DataFrame) -> DataFrame:
    return certs.groupBy("issuer").agg(F.count(F.lit(1)).alias("certificates"))


def stats(certs: DataFrame) -> DataFrame:
    """One row: certificates, issuers, expired ones, distinct hosts of the target.

    Issuers and hosts are counted in one pass over the certificates: each
    certificate gives its issuer and its hosts, and equal ones meet once.
    """
    hosts = F.filter(F.transform("target_domains", H.strip_wildcard), X.valid_domain)
    fact = lambda kind, name, n, expired: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"), expired.cast("long").alias("expired"))
    facts = F.concat(
        F.array(fact("issuer", F.col("issuer"), F.lit(1), F.col("expired").cast("int"))),
        F.transform(hosts, lambda h: fact("host", h, F.lit(0), F.lit(0))))
    met = certs.select(F.explode(facts).alias("f")).select("f.*").groupBy("kind", "name").agg(
        F.sum("n").alias("n"), F.sum("expired").alias("expired"))
    return met.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_certificates"),
        F.count_if(F.col("kind") == "issuer").alias("unique_issuers"),
        F.coalesce(F.sum("expired"), F.lit(0)).alias("expired_certificates"),
        F.count_if(F.col("kind") == "host").alias("total_domains"),
    )


def flat(certs: DataFrame) -> DataFrame:
    """Columns of the CSV export, the names of the target joined by ', '."""
    return certs.select(
        "id", "common_name", "issuer", "not_before", "not_after", "expired",
        F.array_join("target_domains", ", ").alias("domains"), "source",
    )
