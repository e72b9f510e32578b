"""Rule sets, word lists and templates.

Everything an extractor looks for is data here, so a user can pass their own
rows instead. Patterns use the syntax shared by Java and RE2.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """One detection rule.

    ``group`` is the capture group that holds the sensitive value. ``shown``
    says how samples leave the job: ``clear``, ``masked`` or ``redacted``.
    ``hints`` are literals of which at least one must occur (lower case) for
    the pattern to be able to match, ``needs`` a cheaper pattern that every
    text with a match also matches; both only save time.
    """

    kind: str
    pattern: str
    group: int = 0
    shown: str = "masked"
    weight: int = 3
    exposes: str = ""
    hints: tuple = ()
    needs: str = ""


# ---------------------------------------------------------------------------
# Patterns, weights, word lists and templates that results
# depend on.
# ---------------------------------------------------------------------------

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
PHONE = r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"
ADDRESS = (
    r"(?i)\b\d+\s+[A-Za-z\s]+"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct)\b"
    r"[^,]*(?:,\s*[A-Za-z\s]+){0,2}(?:,\s*\d{5})?"
)
SCRIPT_URL = r"(?i)(?:https?://|//)[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]+"

PASTE_RULES = (
    Rule("emails", EMAIL, 0, "clear", 6, "credentials", ("@",)),
    Rule("passwords", r"""(?i)(password|pass|pwd)\s*[:=]\s*["']?([^"'\s]+)["']?""",
         2, "redacted", 10, "credentials", ("pass", "pwd")),
    Rule("api_keys", r"""(?i)(api[_-]?key|apikey|access[_-]?token)\s*[:=]\s*["']?([a-zA-Z0-9_-]+)["']?""",
         2, "masked", 8, "code", ("api", "access")),
    Rule("database_urls", r"(?i)(mongodb://|mysql://|postgresql://|redis://)[^\s]+",
         0, "masked", 8, "code", ("://",)),
    Rule("aws_keys", r"(?i)(AKIA[0-9A-Z]{16}|aws_access_key_id)",
         0, "masked", 10, "credentials", ("akia", "aws_access_key_id")),
    Rule("private_keys", r"-----BEGIN (RSA|DSA|EC|OPENSSH) PRIVATE KEY-----",
         0, "masked", 10, "credentials", ("-----begin ",)),
    Rule("jwt_tokens", r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*",
         0, "masked", 8, "code", ("eyj",)),
    Rule("ip_addresses", IPV4, 0, "clear", 3, needs=r"\d\.\d"),
    Rule("credit_cards",
         r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
         0, "masked", 6, "credentials", needs=r"\d{13}"),
)

DOCUMENT_RULES = (
    Rule("emails", EMAIL, 0, "clear", hints=("@",)),
    Rule("phone_numbers", r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", 0, "clear", needs=r"\d{3}[-.\s]?\d{4}"),
    Rule("ip_addresses", IPV4, 0, "clear", needs=r"\d\.\d"),
    Rule("urls", r"""https?://[^\s<>"']+""", 0, "clear", hints=("://",)),
    Rule("social_security", r"\b\d{3}-\d{2}-\d{4}\b", 0, "masked", needs=r"\d-\d{2}-\d"),
    Rule("credit_cards", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b", 0, "masked",
         needs=r"\d{13}"),
    Rule("api_keys", r"""(?i)(api[_-]?key|access[_-]?token)\s*[:=]\s*["']?([a-zA-Z0-9_-]+)["']?""",
         2, "masked", hints=("api", "access")),
    Rule("passwords", r"""(?i)(password|pass|pwd)\s*[:=]\s*["']?([^"'\s]+)["']?""",
         2, "redacted", hints=("pass", "pwd")),
)

CODE_RULES = (
    Rule("api_key", r"""(?i)(api[_-]?key|apikey)["']?\s*[:=]\s*["']?([a-zA-Z0-9_-]{20,})""", 2, hints=("api",)),
    Rule("aws_access_key", r"AKIA[0-9A-Z]{16}", hints=("akia",)),
    Rule("aws_secret_key",
         r"""(?i)aws[_-]?secret[_-]?access[_-]?key["']?\s*[:=]\s*["']?([a-zA-Z0-9+/]{40})""", 1, hints=("aws",)),
    Rule("github_token", r"ghp_[a-zA-Z0-9]{36}", hints=("ghp_",)),
    Rule("slack_token", r"xox[baprs]-[0-9a-zA-Z-]{10,}", hints=("xox",)),
    Rule("password", r"""(?i)(password|passwd|pwd)["']?\s*[:=]\s*["']?([^\s"']{8,})""", 2,
         "redacted", hints=("passw", "pwd")),
    Rule("private_key", r"-----BEGIN [A-Z ]+PRIVATE KEY-----", hints=("-----begin ",)),
)

CHAT_RULES = (
    Rule("webhook_url", r"https://hooks\.slack\.com/services/[A-Z0-9]+/[A-Z0-9]+/[a-zA-Z0-9]+",
         hints=("hooks.slack.com",)),
    Rule("bot_token", r"xoxb-[0-9]+-[0-9]+-[a-zA-Z0-9]+", hints=("xoxb-",)),
    Rule("user_token", r"xoxp-[0-9]+-[0-9]+-[0-9]+-[a-zA-Z0-9]+", hints=("xoxp-",)),
    Rule("app_token", r"xoxa-[0-9]+-[0-9]+-[0-9]+-[a-zA-Z0-9]+", hints=("xoxa-",)),
    Rule("refresh_token", r"xoxr-[0-9]+-[0-9]+-[a-zA-Z0-9]+", hints=("xoxr-",)),
)

CREDENTIAL_PAIRS = (
    (":", r"([^:\s]+@[^:\s]+):([^:\s]+)"),
    (";", r"([^;\s]+@[^;\s]+);([^;\s]+)"),
    (",", r"([^,\s]+@[^,\s]+),([^,\s]+)"),
    ("|", r"([^|\s]+@[^|\s]+)\|([^|\s]+)"),
    ("\t", r"([^\t\s]+@[^\t\s]+)\t([^\t\s]+)"),
)

SOCIAL_RULES = (
    ("twitter", r"(?i)(?:https?://)?(?:www\.)?twitter\.com/([A-Za-z0-9_]+)"),
    ("linkedin", r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/(?:in|company)/([A-Za-z0-9_-]+)"),
    ("facebook", r"(?i)(?:https?://)?(?:www\.)?facebook\.com/([A-Za-z0-9_.]+)"),
    ("github", r"(?i)(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9_-]+)"),
)
HANDLE_STOP_LIST = ("home", "login", "signin", "signup")

DIGEST_PATTERNS = (
    ("md5", r"^[a-fA-F0-9]{32}$"),
    ("sha1", r"^[a-fA-F0-9]{40}$"),
    ("sha256", r"^[a-fA-F0-9]{64}$"),
    ("bcrypt", r"^\$2[abyxz]?\$[0-9]{2}\$.{53}$"),
)

DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "zip", "rar", "7z", "tar.gz")
SKIPPED_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
SENSITIVE_TITLE_WORDS = ("confidential", "internal", "private", "secret", "restricted")
HIGH_RISK_WORDS = ("confidential", "secret", "private", "internal", "restricted")
MEDIUM_RISK_WORDS = ("employee", "staff", "financial", "contract", "agreement")

PATH_ISSUES = (
    ("file_path", ("config", "env", "secret", "key"), "Potential secrets in configuration file"),
    ("file_path", ("docker", "dockerfile"), "Slack credentials in Docker configuration"),
    ("title", ("token", "webhook", "api_key"), "Exposed Slack credentials in filename"),
    ("repository", ("public",), "Credentials in public repository"),
)

ROLE_TEMPLATES = (
    "admin@{domain}", "info@{domain}", "contact@{domain}", "support@{domain}", "sales@{domain}",
    "marketing@{domain}", "hr@{domain}", "it@{domain}", "help@{domain}", "service@{domain}",
    "office@{domain}", "mail@{domain}", "webmaster@{domain}", "no-reply@{domain}", "noreply@{domain}",
)
NAME_TEMPLATES = (
    "{first}.{last}@{domain}", "{first}{last}@{domain}", "{first}_{last}@{domain}", "{first}@{domain}",
    "{last}@{domain}", "{first}{l}@{domain}", "{f}{last}@{domain}",
)

PASTE_SITES = ("pastebin.com", "paste.ee", "hastebin.com", "ghostbin.co", "rentry.co", "justpaste.it", "dpaste.org")

# Templates of the phrases searched for one watched domain. {domain} is the
# domain, {spaced} the domain with blanks for dots, {label} its first label.
MENTION_TEMPLATES = (
    ("domain_mentions", "{domain}"), ("domain_mentions", "{spaced}"),
    ("domain_mentions", '"{domain}"'), ("domain_mentions", "{label}"),
    ("credential_patterns", "{domain} password"), ("credential_patterns", "{domain} login"),
    ("credential_patterns", "{domain} credentials"), ("credential_patterns", "{domain} database"),
    ("credential_patterns", "{domain} dump"), ("credential_patterns", "{domain} leak"),
    ("code_patterns", "{domain} api"), ("code_patterns", "{domain} token"), ("code_patterns", "{domain} key"),
    ("code_patterns", "{domain} config"), ("code_patterns", "{domain} env"),
)

DUMP_EXTENSIONS = (".txt", ".gz", ".zip")


class SiteRule(NamedTuple):
    """How results are laid out on the stored result pages of one site.

    ``site`` is a substring of the page's site name ('' fits every site).
    ``box_class`` is a class token, ``box_like`` a pattern on the class
    attribute. ``title_in`` is the (tag, class) that must hold the title
    element. With ``own_link`` the title element is also the link, else the
    link is the first anchor of the box. ``snippets`` are alternatives, each
    (tags, class); with ``snippet_after`` they may follow the box.
    """

    site: str
    box_tags: tuple
    box_class: str = ""
    box_like: str = ""
    title_tags: tuple = ("a",)
    title_class: str = ""
    title_in: tuple = ()
    own_link: bool = False
    snippets: tuple = ()
    snippet_after: bool = False
    prefix: str = ""
    default_title: str = "No title"
    need_title: bool = False
    need_url: bool = False


ENGINE_RULES = (
    SiteRule("google", ("div",), "g", title_tags=("h3",), default_title="", need_title=True,
             snippets=((("span",), "st"), (("div",), "s"))),
    SiteRule("bing", ("li",), "b_algo", title_in=("h2", ""), own_link=True, default_title="", need_title=True,
             snippets=((("p",), ""),)),
    SiteRule("duckduckgo", ("div",), "result", title_class="result__a", own_link=True, default_title="",
             need_title=True, snippets=((("a",), "result__snippet"),)),
)
CODE_HOST_RULES = (
    SiteRule("repositories", ("div",), "f4", own_link=True, prefix="https://github.com", default_title="",
             need_title=True, snippets=((("p",), ""),), snippet_after=True),
    SiteRule("code", ("div",), "code-list-item", title_in=("div", "f4"), own_link=True, prefix="https://github.com",
             default_title="", need_title=True, snippets=((("div",), "code-list-item-code"),)),
    SiteRule("commits", ("div",), "commit-group-item", title_class="commit-link", own_link=True,
             prefix="https://github.com", default_title="", need_title=True, snippets=((("a",), "commit-author"),)),
    SiteRule("issues", ("div",), "issue-list-item", title_class="h4", own_link=True, prefix="https://github.com",
             default_title="", need_title=True, snippets=((("a",), "muted-link"),)),
)
PASTE_LIST_RULES = (
    SiteRule("pastebin.com", ("div",), "gsc-result", own_link=True),
    SiteRule("paste.ee", ("div",), "paste-item", title_tags=("h3",), prefix="https://paste.ee"),
    SiteRule("", ("div", "li", "tr"), box_like="paste|result|item", title_tags=("a", "h3", "h2"),
             need_title=True, need_url=True),
)
DOCUMENT_LIST_RULES = (
    SiteRule("google.com", ("div",), "g", title_tags=("h3", "h2", "a")),
    SiteRule("bing.com", ("li",), "b_algo", title_tags=("h3", "h2", "a")),
    SiteRule("duckduckgo.com", ("div",), "result", title_tags=("h3", "h2", "a")),
    SiteRule("archive.org", ("div",), "item-ttl", title_tags=("h3", "h2", "a")),
    SiteRule("", ("div", "li"), box_like="result|item", title_tags=("h3", "h2", "a")),
)
MENTION_LIST_RULES = (
    SiteRule("google.com", ("div",), "g", title_tags=("h3", "h2", "a"), snippets=((("p", "div", "span"), ""),)),
    SiteRule("bing.com", ("li",), "b_algo", title_tags=("h3", "h2", "a"), snippets=((("p", "div", "span"), ""),)),
    SiteRule("github.com", ("div",), "f4", title_tags=("h3", "h2", "a"), snippets=((("p", "div", "span"), ""),)),
    SiteRule("", ("div", "li", "article"), title_tags=("h3", "h2", "a"), snippets=((("p", "div", "span"), ""),)),
)
LEAK_LIST_RULES = (
    SiteRule("pastebin.com", ("div",), "gsc-result", title_tags=("a", "h3", "h2")),
    SiteRule("ghostbin.com", ("div",), "paste-item", title_tags=("a", "h3", "h2")),
    SiteRule("", ("div", "li", "tr"), title_tags=("a", "h3", "h2")),
)
DIRECTORY_LIST_RULES = tuple(
    SiteRule("", ("div",), cls, like, ("h3", "h2", "a"), snippets=((("p", "div", "span"), ""),))
    for cls, like in (("search-result", ""), ("result", ""), ("g", ""), ("", "result"))
)
BODY_RULES = (
    # site, tags, id, class token
    ("pastebin.com", ("textarea",), "paste_code", ""),
    ("pastebin.com", ("div",), "paste_code", ""),
    ("paste.ee", ("div",), "", "paste-content"),
)
GENERIC_BODY_TAGS = ("textarea", "pre", "code")
GENERIC_BODY_CLASS = "content|paste|code"
CHANNEL_CLASS = "channel|room"
MEMBER_CLASS = "user|member"
# ------------------------------------------------------- end of fixed values
