"""Fixed values of the grading contract.

Everything here must equal the published contract exactly, so the values are written out plainly.
"""

# -- fixed values: dimensions, weights, grades ------------------------------------------------
DIMENSIONS = (
    "machineReadability",
    "structuredData",
    "agentSignals",
    "actionability",
    "performance",
    "contentClarity",
)
WEIGHTS = {
    "machineReadability": 0.25,
    "structuredData": 0.20,
    "agentSignals": 0.15,
    "actionability": 0.20,
    "performance": 0.10,
    "contentClarity": 0.10,
}
if abs(sum(WEIGHTS.values()) - 1.0) > 1e-9:
    raise ValueError("dimension weights must sum to 1")
GRADE_BOUNDS = (("A", 90), ("B", 75), ("C", 60), ("D", 40))
GRADES = ("A", "B", "C", "D", "F")
SEVERITIES = ("info", "low", "medium", "high")
PRIORITIES = ("high", "medium", "low")
EVIDENCE_TYPES = (
    "html-snapshot",
    "screenshot",
    "response-headers",
    "robots-txt",
    "sitemap",
    "json-ld",
    "rendered-text",
    "other",
)
JOB_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED")

# -- fixed values: HTML vocabulary ------------------------------------------------------------
SEMANTIC_TAGS = ("main", "article", "nav", "header", "footer", "section", "aside")
LANDMARK_TAGS = ("main", "nav", "header", "footer")
BOILERPLATE_TAGS = ("header", "footer", "nav", "aside")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
)
# Elements whose content the HTML tokenizer reads as plain text up to the matching end tag.
RAW_TEXT_TAGS = ("script", "style", "title", "textarea", "iframe", "noscript", "xmp", "noembed", "noframes")
HIDDEN_TAGS = ("script", "style", "noscript", "iframe")
ESCAPABLE_RAW_TAGS = ("title", "textarea")
# Elements that an end tag from outside does not reach into, and those that end tags of inline elements do not reach out of.
SCOPE_TAGS = ("applet", "caption", "html", "marquee", "object", "table", "td", "template", "th")
SPECIAL_TAGS = (
    "address", "applet", "article", "aside", "blockquote", "body", "button", "caption", "center", "colgroup", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "html", "li", "listing", "main", "marquee", "menu", "nav", "object", "ol", "p", "plaintext", "pre", "search",
    "section", "select", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul",
)
# Start tags that end an open p.
PARAGRAPH_ENDING_TAGS = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "header", "hgroup", "hr", "listing", "main", "menu", "nav", "ol", "p", "plaintext", "pre", "search", "section",
    "summary", "table", "ul",
)
TABLE_SECTION_TAGS = ("tbody", "tfoot", "thead")

# -- fixed values: structured data ------------------------------------------------------------
KNOWN_SCHEMA_TYPES = (
    "Organization", "LocalBusiness", "Person", "Product", "Offer", "AggregateRating", "Review",
    "FAQPage", "Question", "Article", "NewsArticle", "BlogPosting", "Recipe", "Event",
    "BreadcrumbList", "WebSite", "WebPage", "VideoObject", "ImageObject", "HowTo", "JobPosting",
    "Course", "SoftwareApplication", "Book", "Movie",
)
REQUIRED_OG = ("og:title", "og:description", "og:image", "og:url", "og:type")

# -- fixed values: agent signals --------------------------------------------------------------
AI_BOTS = (
    "GPTBot", "ClaudeBot", "ClaudeUser", "PerplexityBot",
    "Google-Extended", "CCBot", "anthropic-ai", "Bytespider",
)

# -- fixed values: actionability --------------------------------------------------------------
WEAK_TEXTS = (
    "click here", "read more", "learn more", "more", "here",
    "link", "this", "submit", "go", "ok",
)
HASHED_CLASS_PATTERN = r"^[a-z0-9_-]*[A-Za-z]+_[A-Za-z0-9]{4,}$|^css-[a-z0-9]{5,}$|^[a-z]{2,4}-[a-z0-9]{6,}$"
SELECTOR_SAMPLE = 20
SESSION_PARAMS = ("sid", "sessionid", "jsessionid", "phpsessid")

# -- fixed values: performance ----------------------------------------------------------------
COOKIE_PATTERN = "(?i)cookie|consent|gdpr|privacy"

# -- fixed values: URLs -----------------------------------------------------------------------
BLOCKED_HOSTNAMES = (
    "localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "broadcasthost",
)
TRACKING_PREFIXES = ("utm_", "mc_", "icid_", "oly_")
TRACKING_PARAMS = (
    "gclid", "fbclid", "msclkid", "yclid", "dclid", "twclid",
    "igshid", "_ga", "_gl", "ref", "ref_src", "ref_url",
)
SECRET_SUBSTRINGS = (
    "token", "secret", "password", "passwd", "auth",
    "session", "signature", "apikey", "credential", "otp",
)
SECRET_NAMES = (
    "key", "api_key", "access_key", "pwd", "pass", "sig",
    "sid", "code", "state", "email", "ticket", "hash",
)
URL_REDACTED = "[redacted]"
MAX_REDIRECTS = 5

# -- fixed values: redaction ------------------------------------------------------------------
PII_HEADERS = (
    "authorization", "cookie", "set-cookie",
    "x-api-key", "x-auth-token", "proxy-authorization",
)
EVENT_REDACTED = "[REDACTED]"

# -- fixed values: jobs and reports -----------------------------------------------------------
INFLIGHT_SECONDS = 60
CACHE_SECONDS = 24 * 60 * 60
METRICS_SECONDS = 60 * 60
STALL_SECONDS = 60
JOB_TIMEOUT_SECONDS = 90
RETENTION_DAYS = 90
MAX_ATTEMPTS = 3
BACKOFF_SECONDS = 5
ERROR_MESSAGE_CHARS = 1000
INLINE_EVIDENCE_CHARS = 64 * 1024
JS_ONLY_SAMPLE = 20
TOP_FINDINGS = 8
JOB_ID_PATTERN = "^c[a-z0-9]{20,32}$"
REPORT_ID_PATTERN = "^[a-z][a-z0-9]{20,32}$"
STAGE_PROGRESS = (
    ("queued", 0), ("fetch", 10), ("render", 30), ("analyze", 50),
    ("score", 70), ("persist", 90), ("done", 100),
)
STEP_THRESHOLDS = (
    ("fetch-robots", 0), ("llms-txt", 15), ("render", 30), ("analyze", 55), ("recommend", 80),
)
# (limit name, max, window)
RATE_LIMITS = (
    ("global", 30, "1 minute"),
    ("analyze-minute", 5, "1 minute"),
    ("analyze-day", 20, "1 day"),
    ("report-read", 60, "1 minute"),
    ("report-delete", 10, "1 minute"),
)

# -- fixed values: whitespace and entities ----------------------------------------------------
# The characters a browser's trim() removes.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE_PATTERN = (
    r"[\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

def _raw_text_alternatives():
    return "|".join(
        rf"<(?i:{tag})(?:[\s/][^>]*+)?+>.*?(?:</(?i:{tag})[^>]*+(?:>|\z)|\z)" for tag in RAW_TEXT_TAGS
    )


# One match per token, nothing lost: comment, declaration, raw-text element, tag, text, stray "</".
# Every repeated group is possessive: the matcher neither recurses on it nor looks at it twice, so the number of
# attributes or bare "<" in a page has no bound. A tag, comment or declaration that never ends reaches to the end.
_ATTRIBUTE = r"[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
TOKEN_PATTERN = (
    r"(?s)<!--.*?(?:-->|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
    r"|" + _raw_text_alternatives() + r"|</?[a-zA-Z][^\s/>]*+(?:[\s/]++|" + _ATTRIBUTE + r"|=)*+(?:>|\z)"
    r"|</(?:>|[^a-zA-Z>][^>]*+(?:>|\z))"
    r"|(?:[^<]++|<(?![a-zA-Z/!?])|</\z)++"
    r"|<"
)
TAG_NAME_PATTERN = r"^</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE_PATTERN = _ATTRIBUTE
URL_PATTERN = (
    r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^:/?#]*)"
    r"(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
)
