"""Flat shapes of nested results for CSV: one row an entry, lists and secrets left out or cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.functions import text as X


def code(repositories: DataFrame, matches: DataFrame) -> DataFrame:
    """(type, name, url, description, details) of repositories (name, url, description) and of code matches
    (file_path, url, repository, content), whose content is redacted and cut to 200 characters."""
    repos = repositories.select(
        F.lit("repository").alias("type"), *[X.or_empty(c).alias(c) for c in ("name", "url", "description")], F.lit("").alias("details"))
    return repos.unionByName(matches.select(
        F.lit("code").alias("type"), X.or_empty("file_path").alias("name"), X.or_empty("url").alias("url"),
        X.or_empty("repository").alias("description"), X.truncate(X.redacted(X.or_empty("content")), 200).alias("details")))


def dump_emails(emails: DataFrame) -> DataFrame:
    return emails.select("email", "source_file")


def dump_credentials(credentials: DataFrame) -> DataFrame:
    """Kind and length of each secret; the secret and its fingerprint stay out."""
    return credentials.select("email", F.col("password_hash_type").alias("password_type"), "password_length", "source_file")


def values(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One column of distinct values, such as addresses or hosts."""
    return rows.select(F.col(column).alias(name)).distinct()
