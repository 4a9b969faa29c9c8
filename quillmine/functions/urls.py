"""URL helpers as Column expressions, built on the RFC 3986 split.

``parse_url`` is not used: it returns null for URLs with blanks, bars or no scheme,
and such URLs occur in pages people pin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions.text import contains_any, or_else, strip, text_of, web_strip

# groups: 2 scheme, 3 //authority, 4 authority, 5 path, 6 ?query, 8 #fragment
URL_PARTS = r"(?s)^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
# Fixed value: schemes whose path keeps an empty authority
SLASHED_SCHEMES = ("http", "https", "file", "ftp")


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, group)


def path_without_params(url: Column) -> Column:
    """The path, without the ``;params`` of its last segment."""
    return F.regexp_replace(url_part(url, 5), r";[^/]*$", "")


def canonical_url(url: Column) -> Column:
    raw = strip(text_of(url))
    scheme = F.lower(url_part(raw, 2))
    host = F.lower(url_part(raw, 4))
    path = F.lower(F.rtrim(F.regexp_replace(path_without_params(raw), "/+", "/"), F.lit("/")))
    path = or_else(path, F.lit("/"))
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    rest = (
        F.when(host != "", F.concat(F.lit("//"), host, rooted))
        .when(scheme.isin(*SLASHED_SCHEMES) & path.startswith("/"), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    full = F.when(scheme != "", F.concat(scheme, F.lit(":"), rest)).otherwise(rest)
    return F.when(raw == "", F.lit("")).otherwise(full)


def loose_url(url: Column) -> Column:
    """URL without query, fragment and trailing slashes; the path keeps its case."""
    text = web_strip(url)
    # Only a real URL loses its query; other strings just lose trailing slashes.
    is_url = F.regexp_like(text, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]"))
    bare = F.concat(
        F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)),
        F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1),
    )
    return F.rtrim(F.when(is_url, bare).otherwise(text), F.lit("/"))


def hostname(url: Column) -> Column:
    """Lower-cased host without user or port, else the string itself."""
    host = F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1
    )
    return or_else(F.lower(host), url)


def last_path_part(url: Column) -> Column:
    path = F.rtrim(path_without_params(url), F.lit("/"))
    return F.regexp_extract(path, r"([^/]*)$", 1)


def fallback_title(url: Column) -> Column:
    raw = strip(text_of(url))
    return F.when(raw == "", F.lit("Untitled page")).otherwise(
        or_else(last_path_part(raw), url_part(raw, 4), raw)
    )


def source_type(url: Column) -> Column:
    """Issue trackers are tested before wikis."""
    low = F.lower(strip(text_of(url)))
    return (
        F.when(contains_any(low, ("/browse/", "jira.", "atlassian.net/browse/")), "jira")
        .when(
            contains_any(low, ("confluence", "atlassian.net/wiki", "/pages/viewpage.action", "wiki.")),
            "confluence",
        )
        .otherwise("generic")
    )


def page_type(url: Column) -> Column:
    """Wikis are tested before issue trackers, as the page cleaner does it."""
    return (
        F.when(
            contains_any(url, ("atlassian.net/wiki", "confluence.com", "/pages/viewpage.action"))
            | F.regexp_like(url, F.lit(r"(?i)wiki\.")),
            "confluence",
        )
        .when(
            contains_any(url, ("atlassian.net/browse", "jira.com"))
            | F.regexp_like(url, F.lit(r"(?i)jira\."))
            | F.regexp_like(url, F.lit(r"(?i)/browse/[A-Z]+-[0-9]+")),
            "jira",
        )
        .otherwise("generic")
    )


def any_pattern(col: Column, patterns: Sequence[str]) -> Column:
    return F.regexp_like(col, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def link_type(
    url: Column, patterns: Mapping[str, Sequence[str]] = rules.LINK_TYPE_PATTERNS
) -> Column:
    kind = F.lit("generic")
    for name, group in reversed(list(patterns.items())):
        kind = F.when(any_pattern(url, group), F.lit(name)).otherwise(kind)
    return kind


def scan_scope(url: Column, patterns: Sequence[str] = rules.LINK_SCAN_PATTERNS) -> Column:
    return any_pattern(url, patterns)
