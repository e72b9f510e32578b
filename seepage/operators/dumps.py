"""Lines of text dumps: watched addresses and credential pairs, without the secrets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import hosts as H
from seepage.functions import text as X
from seepage.operators.dedupe import keep_first
from seepage.operators.matching import lookup_join

# An address up to where its domain characters end; the match itself ends at the '@', so that what follows can open
# the next address.
_ADDRESS = r"\b(?=([A-Za-z0-9._%+-]+@[A-Za-z0-9._-]+))[A-Za-z0-9._%+-]+@"


def _candidates() -> Column:
    """Every address of the line with every end its domain may have: name, email, watched_domain."""
    found = F.transform(X.matches("line", _ADDRESS, 1), F.lower)
    def cuts(address):
        name, rest = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
        return F.transform(H.cut_prefixes(rest), lambda d: F.struct(F.concat(name, F.lit("@"), d).alias("email"), d.alias("watched_domain")))
    return F.flatten(F.transform(found, cuts))


def dump_emails(lines: DataFrame, watchlist: DataFrame, domain: str = "domain") -> DataFrame:
    """First line per watched address: email, source file, masked line of 200 characters.

    What follows the '@' is cut at every '.' and '-', so that a watched domain
    is found by an equality join wherever a word boundary ends it.
    """
    watched = watchlist.select(F.lower(F.col(domain)).alias("watched_domain")).distinct()
    keyed = (
        lines.where(F.contains("line", F.lit("@")))
        .select("source_file", "line", F.explode(_candidates()).alias("found")).select("source_file", "line", "found.*")
    )
    hits = lookup_join(keyed, watched, "watched_domain")
    firsts = keep_first(hits.where(X.valid_email("email")), ["email"], ["source_file", "line"])
    return firsts.select(
        "email", "watched_domain", "source_file", X.masked(X.truncate("line", 200)).alias("line_content")
    )


def _pairs() -> Column:
    """(email, secret) pairs of the line that the five patterns find."""
    def found(mark, pattern):
        part = lambda m, i: F.split_part(m, F.lit(mark), F.lit(i))
        pair = lambda m: F.struct(part(m, 1).alias("email"), part(m, 2).alias("secret"))
        # A match can only start where a run without the mark and blanks does; saying so keeps long lines linear.
        at_start = rf"(?<![^{mark}\s]){pattern}"
        return F.when(F.contains("line", F.lit(mark)), F.transform(X.matches("line", at_start), pair)).otherwise(
            F.array().cast("array<struct<email:string,secret:string>>")
        )

    # Neither part of a pair holds its mark, so a match splits at it.
    return reduce(F.concat, [found(mark, pattern) for mark, pattern in R.CREDENTIAL_PAIRS])


def credential_pairs(lines: DataFrame, salt: str) -> DataFrame:
    """Every (address, secret) pair of every line, the secret as kind, length and keyed fingerprint only."""
    return (
        lines.where(F.contains("line", F.lit("@")))
        .select("source_file", "line", F.explode(_pairs()).alias("p"))
        .where(X.valid_email("p.email"))
        .select(
            F.lower("p.email").alias("email"),
            X.digest_kind("p.secret").alias("password_hash_type"),
            F.length("p.secret").alias("password_length"),
            X.fingerprint("p.secret", salt).alias("fingerprint"),
            "source_file",
            F.sha2("line", 256).alias("line_order"),
        )
    )


def credential_exposure(lines: DataFrame, target: str, salt: str) -> DataFrame:
    """First occurrence per (address, secret) of the addresses that contain the target."""
    pairs = credential_pairs(lines, salt).where(F.contains("email", F.lit(target.lower())))
    kept = keep_first(pairs, ["email", "fingerprint"], ["source_file", "line_order"])
    return kept.drop("line_order")


def dump_stats(lines: DataFrame, watchlist: DataFrame, target: str, salt: str, domain: str = "domain") -> DataFrame:
    """One long table, from one pass over the lines: files processed, watched addresses and credentials found.

    Counts what ``dump_emails`` and ``credential_exposure`` keep. Every line
    gives its file, its candidate addresses and its pairs; candidates meet the
    watched domains, and equal facts meet once.
    """
    has_mail = F.contains("line", F.lit("@"))
    fact = lambda kind, name, watched: F.struct(
        F.lit(kind).alias("statistic"), name.alias("name"), watched.cast("string").alias("watched_domain"))
    none = F.array().cast("array<struct<statistic:string,name:string,watched_domain:string>>")
    addresses = F.transform(_candidates(), lambda c: fact("emails_found", c["email"], c["watched_domain"]))
    exposed = F.filter(_pairs(), lambda p: X.valid_email(p["email"]) & F.contains(F.lower(p["email"]), F.lit(target.lower())))
    pairs = F.transform(exposed, lambda p: fact(
        "credentials_found", F.concat_ws(" ", F.lower(p["email"]), X.fingerprint(p["secret"], salt)), F.lit(None)))
    facts = lines.select(F.explode(F.concat(
        F.array(fact("files_processed", F.col("source_file"), F.lit(None))),
        F.when(has_mail, addresses).otherwise(none), F.when(has_mail, pairs).otherwise(none))).alias("f")).select("f.*").distinct()
    watched = watchlist.select(F.lower(F.col(domain)).alias("watched_domain"), F.lit(True).alias("listed")).distinct()
    met = lookup_join(facts, watched, "watched_domain", "left")
    address = F.col("statistic") == "emails_found"
    met = met.where(~address | (F.col("listed") & X.valid_email("name"))).select("statistic", "name").distinct()
    found = met.groupBy("statistic").agg(F.count(F.lit(1)).alias("n"))
    names = lines.sparkSession.createDataFrame([(s,) for s in ("files_processed", "emails_found", "credentials_found")], "statistic string")
    return names.join(F.broadcast(found), "statistic", "left").select("statistic", F.coalesce("n", F.lit(0)).alias("n"))


def digest_histogram(credentials: DataFrame) -> DataFrame:
    return credentials.groupBy("password_hash_type").agg(F.count(F.lit(1)).alias("n"))
