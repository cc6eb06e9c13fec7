"""URL scalar functions as Spark column expressions (no Python UDFs).

Parsing follows RFC 3986 appendix B with the path semantics of Python's
``urlparse``: netloc keeps userinfo and port, and ``;params`` of the last
path segment are dropped. Spark's ``parse_url`` is not used: it fails or
returns NULL on URLs with spaces and keeps ``;params``.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_PATTERN = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
PARAMS_PATTERN = r";[^/]*$"

# ---- fixed values that must equal the reference's rules ---------------------
# Date patterns removed from URL paths, applied in this order.
DATE_PATTERNS = [
    r"\d{4}[/-]\d{2}[/-]\d{2}",
    r"\d{2}[/-]\d{2}[/-]\d{4}",
    r"\d{4}[/-]\d{2}\b",
    r"\b(20[0-2]\d|19[9]\d)\b",
    r"[/-](0[1-9]|1[0-2])[/-]",
]
# Found in every text that one of DATE_PATTERNS is found in.
MAYBE_DATE = r"\d{2}[/-]\d{2}|20[0-2]\d|199\d|[/-](?:0[1-9]|1[0-2])[/-]"
# Structure flags.
HAS_DATES = r"\d{4}[/-]\d{2}[/-]\d{2}|\d{2}[/-]\d{2}[/-]\d{4}"
HAS_YEAR = r"\b20\d{2}\b|\b19\d{2}\b"
HAS_MONTH = r"\b(01|02|03|04|05|06|07|08|09|10|11|12)\b"
HAS_FILE_EXTENSION = r"\.[a-z]{2,4}$"
SEMANTIC_WORDS = [
    "article", "story", "news", "post", "blog", "page",
    "politics", "business", "sports", "tech", "entertainment", "world", "health", "science",
    "breaking", "latest", "update", "analysis", "opinion", "review",
]
CATEGORY_FIRST_SEGMENTS = [
    "news", "sports", "politics", "business", "tech", "entertainment", "world", "health", "science",
    "breaking", "latest", "featured", "trending",
    "articles", "stories", "posts", "blogs",
]
# URL audit rules, first match wins; anything else is 'other'.
DEFAULT_RULES = OrderedDict([
    ("date_based", r"/\d{4}/\d{2}/\d{2}/"),
    ("numeric_id", r"/\d+($|/)"),
    ("slug_only", r"(?i)/[a-z0-9-]+\.(?:html?|php)$"),
])
# ------------------------------------------------------------------------------

# Small public-suffix table for registered hosts (P8). Coverage is limited to
# common generic and a few country suffixes; callers may pass their own list.
PUBLIC_SUFFIXES = ["com", "net", "org", "edu", "gov", "info", "io", "co", "news", "biz",
                   "uk", "co.uk", "org.uk", "br", "com.br", "org.br", "de", "fr", "es", "it",
                   "pt", "ca", "au", "com.au", "in", "us", "eu", "jp", "co.jp", "ru", "nl"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _u(pattern: str) -> str:
    """Python's \\d, \\w and \\b are Unicode-aware; Java's need (?U)."""
    return "(?U)" + pattern


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), URL_PATTERN, 1))


def url_netloc(url) -> Column:
    return F.regexp_extract(_c(url), URL_PATTERN, 2)


def url_path(url) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(url), URL_PATTERN, 3), PARAMS_PATTERN, "")


def netloc_path(url) -> Column:
    return F.concat(url_netloc(url), url_path(url))


def clean_path(path) -> Column:
    """'/', '-' and '\\' become spaces."""
    return F.regexp_replace(_c(path), r"[/\-\\]", " ")


def has_word_char(text) -> Column:
    return _c(text).rlike(_u(r"\w"))


def domain_or_unknown(url) -> Column:
    n = url_netloc(url)
    return F.when(n.isNull() | (n == ""), F.lit("unknown")).otherwise(n)


def url_host(url) -> Column:
    """Host without userinfo and port, lower case ('' when absent)."""
    n = url_netloc(url)
    return F.lower(F.regexp_replace(F.regexp_replace(n, r"^.*@", ""), r":[0-9]*$", ""))


def quote_regex(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def registered_host(url, suffixes=None) -> Column:
    """Host when it ends in a listed public suffix with at least one label
    before it; NULL otherwise (no host, IP address, unknown suffix)."""
    alts = "|".join(quote_regex(x) for x in (suffixes or PUBLIC_SUFFIXES))
    host = url_host(url)
    ok = (host.rlike(r"^.+\.(?:" + alts + ")$") & ~host.rlike("^(?:" + alts + ")$")
          & ~host.rlike(r"^[0-9.]+$"))
    return F.when(ok, host)


def path_segments(path) -> Column:
    """Non-empty path segments in order (maximal runs of non-'/' characters)."""
    return F.regexp_extract_all(_c(path), F.lit("[^/]+"), 0)


def candidate_slugs(path) -> Column:
    """Segments in path order, whitespace-trimmed, without all-digit ones,
    longer than 2 characters."""
    trimmed = F.transform(F.split(_c(path), "/"),
                          lambda s: F.regexp_replace(s, _u(r"^\s+|\s+$"), ""))
    return F.filter(trimmed, lambda s: (F.length(s) > 2) & ~s.rlike(_u(r"^\d+$")))


def first_section(url) -> Column:
    return F.split_part(F.split_part(_c(url), F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2))


def after_tld_text(url, rewrite_br: bool = False) -> Column:
    u = _c(url)
    if rewrite_br:
        u = F.replace(u, F.lit(".com.br"), F.lit(".com"))
    part = F.split_part(u, F.lit(".com/"), F.lit(2))
    return F.replace(F.replace(part, F.lit("/"), F.lit(" ")), F.lit("-"), F.lit(" "))


def entry_slug(url) -> Column:
    tail = F.substring_index(_c(url), "entry/", -1)
    return F.replace(F.split_part(tail, F.lit("_"), F.lit(1)), F.lit("-"), F.lit(" "))


SEGMENT_START = r"(?<=^|/)"
SEGMENT_END = r"(?=/|$)"


def url_skeleton(path) -> Column:
    """All-digit segments -> {num}, then hex runs of 8+ -> {id}, empty
    segments dropped, '/' prefix. Segment-anchored regexes, no per-element
    lambda."""
    p = F.regexp_replace(_c(path), _u(SEGMENT_START + r"\d+" + SEGMENT_END), "{num}")
    p = F.regexp_replace(p, SEGMENT_START + r"[0-9a-fA-F]{8,}" + SEGMENT_END, "{id}")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "^/|/$", "")
    return F.concat(F.lit("/"), p)


def maybe_date(text) -> Column:
    """Whether a date pattern may be found in the text; without it strip_dates drops '/' and '-' only."""
    return F.coalesce(_c(text).rlike(_u(MAYBE_DATE)), F.lit(False))


def strip_dates(path, replacement: str = "") -> Column:
    whole = p = _c(path)
    for pat in DATE_PATTERNS:
        p = F.regexp_replace(p, _u(pat), replacement)
    # most texts hold nothing that a date pattern could match: one search instead of five
    p = F.when(whole.rlike(_u(MAYBE_DATE)), p).otherwise(whole)
    p = F.regexp_replace(p, r"([/-])\1+", "$1")
    return F.regexp_replace(p, r"[/-]+$", "")


def _count_matches(col: Column, negated_class: str) -> Column:
    return F.length(F.regexp_replace(col, negated_class, ""))


def structure_columns(path, segs=None) -> dict[str, Column]:
    """All structure flags, lengths and the URL type of one path.
    Pass column names (or columns) already projected for ``path`` and its
    ``segs`` so the regexes run once per row."""
    p = _c(path)
    segs = path_segments(p) if segs is None else _c(segs)
    n_seg = F.size(segs)
    digits = _count_matches(p, _u(r"\D"))
    alpha = _count_matches(p, r"[^a-zA-Z]")
    semantic_re = _u(r"\b(" + "|".join(SEMANTIC_WORDS) + r")\b")
    cols = OrderedDict()
    cols["has_numbers"] = p.rlike(_u(r"\d"))
    cols["has_dates"] = p.rlike(_u(HAS_DATES))
    cols["has_year"] = p.rlike(_u(HAS_YEAR))
    cols["has_month"] = p.rlike(_u(HAS_MONTH))
    cols["has_underscores"] = p.contains("_")
    cols["has_hyphens"] = p.contains("-")
    cols["has_file_extension"] = p.rlike(HAS_FILE_EXTENSION)
    cols["is_id_heavy"] = (digits + alpha > 0) & (digits * 2 > digits + alpha)
    cols["is_semantic"] = F.lower(p).rlike(semantic_re)
    cols["has_category_indicators"] = (n_seg >= 2) & F.coalesce(
        F.lower(F.get(segs, 0)).isin(CATEGORY_FIRST_SEGMENTS), F.lit(False))
    cols["path_length"] = F.length(p).cast("long")
    cols["num_segments"] = n_seg.cast("long")
    # segment characters are exactly the non-'/' characters of the path
    cols["avg_segment_length"] = F.when(n_seg == 0, F.lit(0.0)).otherwise(
        F.length(F.regexp_replace(p, "/", "")) / n_seg)
    c = cols
    cols["url_type"] = (
        F.when(c["is_id_heavy"] & ~c["is_semantic"], "id_based")
         .when(c["is_semantic"] & c["has_category_indicators"], "semantic_structured")
         .when(c["is_semantic"], "semantic_unstructured")
         .when(c["has_dates"] | c["has_year"], "date_based")
         .when((n_seg <= 2) & (c["path_length"] < 50), "simple")
         .otherwise("mixed"))
    return cols


def rule_label(path, rules: "OrderedDict[str, str] | None" = None) -> Column:
    """Name of the first rule whose regex is found in the path, else 'other'."""
    rules = rules or DEFAULT_RULES
    expr = None
    for name, pat in rules.items():
        cond = _c(path).rlike(_u(pat))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("other"))


def depth_columns(path, segs=None) -> dict[str, Column]:
    """Path depth and the composition of the segments before the last one."""
    p = _c(path)
    segs = path_segments(p) if segs is None else _c(segs)
    d = F.size(segs)
    last = F.try_element_at(segs, F.lit(-1))
    n_num_all = F.size(F.regexp_extract_all(p, F.lit(_u(SEGMENT_START + r"\d+" + SEGMENT_END)), 0))
    last_num = F.coalesce(last.rlike(_u(r"^\d+$")), F.lit(False))
    n_other = F.greatest(d - 1, F.lit(0))
    n_num = n_num_all - F.when(last_num, 1).otherwise(0)
    return OrderedDict([
        ("depth", d.cast("long")),
        ("other_segments", n_other.cast("long")),
        ("other_numeric_segments", n_num.cast("long")),
        ("other_text_segments", (n_other - n_num).cast("long")),
        ("last_has_number", F.coalesce(last.rlike(_u(r"\d")), F.lit(False))),
    ])
