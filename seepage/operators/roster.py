"""Member rosters and the owner's own mailboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage import rules as R
from seepage.functions import text as X
from seepage.operators.matching import expand_templates

MEMBERS = (
    "struct<members:array<struct<name:string,real_name:string,is_admin:boolean,"
    "profile:struct<email:string,image_72:string>>>>"
)


def roster_users(df: DataFrame, keys, json: str) -> DataFrame:
    """Members of a stored roster answer, missing values as '' or false."""
    return (
        df.select(*keys, F.explode(F.from_json(json, MEMBERS)["members"]).alias("m"))
        .select(
            *keys,
            X.or_empty("m.name").alias("username"),
            X.or_empty("m.real_name").alias("display_name"),
            X.or_empty("m.profile.email").alias("email"),
            X.or_empty("m.profile.image_72").alias("profile_image"),
            F.coalesce("m.is_admin", F.lit(False)).alias("is_admin"),
        )
    )


def roster_variants(roster: DataFrame, templates=R.NAME_TEMPLATES) -> DataFrame:
    """Mailbox spellings of the owner's people (first, last, domain), valid ones, distinct."""
    first, last = F.lower(X.strip("first")), F.lower(X.strip("last"))
    values = {
        "first": first, "last": last, "domain": F.lower("domain"),
        "f": F.substring(first, 1, 1), "l": F.substring(last, 1, 1),
    }
    people = roster.select("first", "last", "domain").distinct()
    return expand_templates(people, templates, "email", **values).where(X.valid_email("email"))


def role_mailboxes(domains: DataFrame, templates=R.ROLE_TEMPLATES) -> DataFrame:
    return expand_templates(
        domains.select("domain").distinct(), templates, "email", domain=F.lower("domain")
    ).where(X.valid_email("email"))


def exposed(variants: DataFrame, observed: DataFrame) -> DataFrame:
    """The spellings that occur among the observed addresses."""
    return variants.join(observed.select("email").distinct(), "email", "left_semi")
