"""Text expressions: normalising, classing, masking and scanning. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage import rules as R

_BLANKS = " \t\n\r\f\x0b"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(_BLANKS))


def or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    Spark moves a later filter on the column below a projection, which would
    compute it twice; it does not move it below an explode. Filters on other
    columns still move down.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def any_of(conditions) -> Column:
    return reduce(Column.__or__, conditions)


def contains_any(c, words) -> Column:
    """Does the text hold one of the words, whatever the case."""
    return let(F.lower(_col(c)), lambda low: any_of([F.contains(low, F.lit(w.lower())) for w in words]))


def truncate(c, limit: int) -> Column:
    """At most ``limit`` characters, then '...' if something was left out."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def normalise_email(c) -> Column:
    return F.lower(strip(c))


# Labels of up to 63 letters and digits with inner hyphens, an alphabetic last one; possessive, so nothing is tried twice.
_DOMAIN = r"(?:(?=[^.]{1,63}\.)[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+\.)+[A-Za-z]{2,63}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{}~-]+"


def _fits(c, pattern: str) -> Column:
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def valid_domain(c) -> Column:
    """Two or more labels of letters, digits and inner hyphens (63 at most, 253 in all), an alphabetic last one."""
    return _fits(c, rf"^(?=.{{1,253}}$){_DOMAIN}$")


def valid_email(c) -> Column:
    """A dot-atom of 64 characters at most, '@' and a valid domain."""
    return _fits(c, rf"^(?=[^@]{{1,64}}@){_ATOM}(?:\.{_ATOM})*@(?=.{{1,253}}$){_DOMAIN}$")


def valid_url(c) -> Column:
    """http, https or ftp, an optional user, a valid domain, IPv4 address or localhost, an optional port, no blanks."""
    host = rf"(?:{_DOMAIN}|{_OCTET}(?:\.{_OCTET}){{3}}|localhost)"
    sized = r"(?=[^/?#:]{1,253}(?:[/?#:]|$))"
    return _fits(c, rf"^(?i:https?|ftp)://(?:[^/?#@\s]*+@)?{sized}{host}(?::\d{{1,5}})?(?:[/?#]\S*)?$")


# The email pattern for texts of any kind. As written it starts anew at every word boundary, which takes quadratic time
# on long runs such as percent-encoded data or 'a.a.a.'; here a run is read once and searched only if an '@' and the
# whole domain part follow it, so that a search always ends in a match. Group 1 is the address, the addresses are the same.
_LOCAL = "[A-Za-z0-9._%+-]"
_AT_DOMAIN = R.EMAIL[R.EMAIL.index("@"):]
_EMAIL_SCAN = rf"(?:(?<!{_LOCAL})|\G)(?={_LOCAL}++{_AT_DOMAIN}){_LOCAL}*?({R.EMAIL})"


def matches(c, pattern: str, group: int = 0) -> Column:
    if (pattern, group) == (R.EMAIL, 0):
        pattern, group = _EMAIL_SCAN, 1
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def emails(c) -> Column:
    """Distinct valid addresses of a text, lower case."""
    c = _col(c)
    found = F.transform(matches(c, R.EMAIL), lambda e: F.lower(e))
    return F.when(
        F.contains(c, F.lit("@")), F.filter(F.array_distinct(found), valid_email)
    ).otherwise(F.array().cast("array<string>"))


def phones(c) -> Column:
    """Distinct phone numbers of a text as ``(aaa) bbb-cccc``."""
    shaped = lambda m: F.regexp_replace(m, F.lit(f"^{R.PHONE}$"), F.lit("($1) $2-$3"))
    found = F.array_distinct(F.transform(matches(c, R.PHONE), shaped))
    return F.when(_col(c).rlike(r"\d{3}[-.\s]?\d{4}"), found).otherwise(F.array().cast("array<string>"))


def addresses(c) -> Column:
    return F.array_distinct(matches(c, R.ADDRESS))


# What the patterns of profiles allow before a host. A handle is the same without it, and without it a search need not try
# both options at every character.
_PROFILE_LEAD = r"(?:https?://)?(?:www\.)?"


def social_handles(*contents) -> Column:
    """Map of platform to the distinct handles found in any of the contents; platforms without one left out."""
    entries = []
    for platform, pattern in R.SOCIAL_RULES:
        found = reduce(F.array_union, [matches(c, pattern.replace(_PROFILE_LEAD, ""), 1) for c in contents])
        kept = F.filter(found, lambda h: (h != "") & ~F.lower(h).isin(*R.HANDLE_STOP_LIST))
        entries.append(F.struct(F.lit(platform).alias("key"), F.array_sort(kept).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def digest_kind(c) -> Column:
    """What a stored secret looks like: a known digest, something hashed, or plain text."""

    def kind(v):
        k = F.when(v == "", "plaintext")
        for name, pattern in R.DIGEST_PATTERNS:
            k = k.when(v.rlike(pattern), name)
        return k.when(v.startswith("$"), "hashed").when(F.length(v) > 50, "likely_hash").otherwise("plaintext")

    return let(or_empty(c), kind)


def masked(c) -> Column:
    """Shape of a value: letters as X and x, digits as n."""
    return F.mask(_col(c))


def fingerprint(c, salt: str) -> Column:
    """Keyed digest that tells equal secrets apart without showing them."""
    return F.sha2(F.concat(F.lit(salt), _col(c)), 256)


def shown_samples(values: Column, shown: str, n: int = 3) -> Column:
    head = F.slice(values, 1, n)
    if shown == "clear":
        return head
    if shown == "redacted":
        return F.transform(head, lambda v: F.lit("***REDACTED***"))
    return F.transform(head, lambda v: F.mask(v))


def rule_matches(c, lowered, rule: R.Rule) -> Column:
    """All values one rule finds. The cheap tests keep the pattern off texts that cannot match."""
    c = _col(c)
    found = matches(c, rule.pattern, rule.group)
    tests = [any_of([F.contains(_col(lowered), F.lit(h)) for h in rule.hints])] if rule.hints else []
    tests += [c.rlike(rule.needs)] if rule.needs else []
    if not tests:
        return found
    return F.when(reduce(Column.__and__, tests), found).otherwise(F.array().cast("array<string>"))


def redacted(c, rules=R.PASTE_RULES) -> Column:
    """The text with every match of the rules that are not shown in clear replaced."""
    c = _col(c)
    for rule in rules:
        if rule.shown != "clear":
            c = F.regexp_replace(c, F.lit(rule.pattern), F.lit("***REDACTED***"))
    return c


def mention_count(c, target) -> Column:
    """Non-overlapping occurrences of the target, whatever the case."""
    target = F.lower(_col(target))
    without = lambda low: F.length(low) - F.length(F.replace(low, target, F.lit("")))
    return F.floor(let(F.lower(or_empty(c)), without) / F.length(target)).cast("int")


def mention_keywords(target: str) -> list[str]:
    """The target, its first label, and the target without dots."""
    return list(dict.fromkeys([target.lower(), target.split(".")[0].lower(), target.replace(".", "").lower()]))


def mentions_target(target: str, *contents) -> Column:
    return contains_any(F.concat_ws(" ", *[or_empty(c) for c in contents]), mention_keywords(target))


def content_id(url, title, date) -> Column:
    return F.md5(F.concat(or_empty(url), or_empty(title), or_empty(date)))


def file_type(url) -> Column:
    """Extension of a document URL, 'unknown' if it has none of the listed ones."""
    alternatives = "|".join(e.replace(".", r"\.") for e in R.DOCUMENT_EXTENSIONS)
    found = F.regexp_extract(F.lower(_col(url)), rf"\.({alternatives})$", 1)
    return F.when(found == "", "unknown").otherwise(found)


def is_document_link(url, strict: bool = False) -> Column:
    """Names a listed extension anywhere in the URL; ``strict`` wants it at the end of the path."""
    if not strict:
        return contains_any(or_empty(url), R.DOCUMENT_EXTENSIONS)
    alternatives = "|".join(e.replace(".", r"\.") for e in R.DOCUMENT_EXTENSIONS)
    return or_empty(url).rlike(rf"(?i)\.({alternatives})($|[?#])")


def is_readable_url(url) -> Column:
    """Not empty, not a page anchor, not an office or PDF file."""
    endings = "|".join(e.replace(".", r"\.") for e in R.SKIPPED_EXTENSIONS)
    return ~or_empty(url).rlike(rf"(?i)^$|^#|({endings})$")


def is_sensitive_title(title) -> Column:
    return contains_any(or_empty(title), R.SENSITIVE_TITLE_WORDS)


def title_risk(title) -> Column:
    title = or_empty(title)
    return (
        F.when(contains_any(title, R.HIGH_RISK_WORDS), "high")
        .when(contains_any(title, R.MEDIUM_RISK_WORDS), "medium")
        .otherwise("low")
    )


def path_issues(title, file_path, repository) -> Column:
    """Messages for paths, titles and repositories that hint at stored secrets."""
    fields = {"title": title, "file_path": file_path, "repository": repository}
    flags = [F.when(contains_any(or_empty(fields[f]), words), F.lit(msg)) for f, words, msg in R.PATH_ISSUES]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def clean_name(c, max_length: int = 50) -> Column:
    """Name of 1 to 49 characters with all but letters, digits, '-' and '_' removed; null if nothing is left."""
    name = strip(c)
    kept = F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "")
    return F.when((F.length(name) > 0) & (F.length(name) < max_length) & (kept != ""), kept)


def effective_content(preview, content, min_length: int = 100) -> Column:
    """The full content where the preview is short and content is stored, else the preview."""
    preview = or_empty(preview)
    return F.when(F.length(preview) < min_length, F.coalesce(F.nullif(_col(content), F.lit("")), preview)).otherwise(
        preview
    )


def repository_of(url) -> Column:
    return F.regexp_extract(_col(url), r"github\.com/([^/]+/[^/]+)", 1)


def file_path_of(url) -> Column:
    return F.regexp_extract(_col(url), r"/blob/[^/]+/(.+)$", 1)


def fill_template(template: str, **values) -> Column:
    """A template such as '{first}.{last}@{domain}' as a concatenation of columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]] if before else [values[name]]
    return F.concat(*parts, F.lit(rest)) if rest else F.concat(*parts)


def fill_templates(template: Column, **values) -> Column:
    """``fill_template`` for a template that is a column; a placeholder without a value stays as it is."""
    known = F.create_map(*[x for name, c in values.items() for x in (F.lit(f"{{{name}}}"), c)])
    pieces = F.split(template, r"(?=\{)|(?<=\})")
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")
