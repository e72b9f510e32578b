"""Fragments of check SQL that several queries share."""

from __future__ import annotations

from seepage import rules as R

STRIPPED = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"trim({c}, {STRIPPED})"


def words(c: str, values) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q(v)})" for v in values) + ")"


def valid_domain(c: str) -> str:
    pattern = r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$"
    return f"(length({c}) <= 253 AND regexp_matches({c}, {q(pattern)}))"


def valid_email(c: str) -> str:
    atom = r"[A-Za-z0-9!#$%&'*+/=?^_`{}~-]+"
    return (
        f"(regexp_matches({c}, {q(rf'^{atom}(\.{atom})*@[^@]+$')}) AND length(split_part({c}, '@', 1)) <= 64"
        f" AND {valid_domain(f'''split_part({c}, '@', 2)''')})"
    )


def valid_url(c: str) -> str:
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    pattern = r"^(?i:https?|ftp)://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::[0-9]{1,5})?(?:[/?#]\S*)?$"
    host = f"regexp_extract({c}, {q(pattern)}, 1)"
    return f"({valid_domain(host)} OR regexp_matches({host}, {q(rf'^{octet}(\.{octet}){{3}}$')}) OR {host} = 'localhost')"


def clean_domain(c: str) -> str:
    return f"split_part(split_part(regexp_replace({strip(f'lower({c})')}, '^https?://', ''), '/', 1), ':', 1)"


def emails(c: str) -> str:
    found = f"list_transform(regexp_extract_all({c}, {q(R.EMAIL)}), lambda e: lower(e))"
    return f"list_filter(list_distinct({found}), lambda e: {valid_email('e')})"


def masked(c: str) -> str:
    upper = f"regexp_replace({c}, '\\p{{Lu}}', 'X', 'g')"
    lower = f"regexp_replace({upper}, '\\p{{Ll}}', 'x', 'g')"
    return f"regexp_replace({lower}, '\\p{{Nd}}', 'n', 'g')"


def samples(c: str, shown: str) -> str:
    if shown == "clear":
        return f"array_to_string({c}[1:3], ' | ')"
    one = "'***REDACTED***'" if shown == "redacted" else masked("v")
    return f"array_to_string(list_transform({c}[1:3], lambda v: {one}), ' | ')"


def scan(table: str, key: str, text: str, rules) -> str:
    """Count and samples per key and kind."""
    return " UNION ALL ".join(
        f"SELECT {key}, {q(r.kind)} AS kind, CAST(len(m) AS INTEGER) AS match_count, {samples('m', r.shown)} AS samples"
        f" FROM (SELECT {key}, regexp_extract_all({text}, {q(r.pattern)}, {r.group}) AS m FROM {table}) WHERE len(m) > 0"
        for r in rules
    )


def secrets(table: str, key: str, text: str, rules, salt: str) -> str:
    """One row per match, the value masked."""
    hits = " UNION ALL ".join(
        f"SELECT {key}, {q(r.kind)} AS kind, unnest(m) AS v, unnest(range(len(m))) AS pos"
        f" FROM (SELECT {key}, regexp_extract_all({text}, {q(r.pattern)}, {r.group}) AS m FROM {table}) WHERE len(m) > 0"
        for r in rules
    )
    return (
        f"SELECT {key}, kind, CAST(pos AS INTEGER) AS pos, {masked('v')} AS masked, CAST(length(v) AS INTEGER) AS length,"
        f" sha256({q(salt)} || v) AS fingerprint FROM ({hits})"
    )


def scored(table: str, keys: str, text: str, target: str, rules) -> str:
    """Score, flags and mentions per row."""
    has = {r.kind: f"(len(regexp_extract_all({text}, {q(r.pattern)})) > 0)" for r in rules}
    weight = " + ".join(f"CASE WHEN {has[r.kind]} THEN {r.weight} ELSE 0 END" for r in rules)
    flag = lambda e: "(" + " OR ".join(has[r.kind] for r in rules if r.exposes == e) + ")"
    mentions = f"CAST((length({text}) - length(replace(lower({text}), {q(target)}, ''))) / {len(target)} AS INTEGER)"
    return (
        f"SELECT *, CAST(least(w + CASE WHEN target_mentions > 0 THEN least(2 * target_mentions, 5) ELSE 0 END, 10) AS INTEGER)"
        f" AS risk_score FROM (SELECT {keys}, {weight} AS w, {flag('credentials')} AS has_credentials,"
        f" {flag('code')} AS has_code, {mentions} AS target_mentions FROM {table})"
    )


def visible(html: str) -> str:
    """Visible text of the regular pages in the test table."""
    bare = rf"regexp_replace({html}, '<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<[^>]*>', '', 'gs')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        bare = f"replace({bare}, '{entity}', '{char}')"
    # A title may be cut within an entity; '&amp' counts without its semicolon.
    return f"regexp_replace({bare}, '&amp;?', '&', 'g')"


def first_per(table: str, key: str, order: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
