"""URL expressions over columns that already hold raw links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signpost.functions.text import _col, blank, let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_ORIGIN = r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)"


def url_host(url: Column | str) -> Column:
    """Lower-case authority without a leading ``www.``; user and port are kept."""
    authority = F.regexp_extract(blank(url), _AUTHORITY, 1)
    return F.regexp_replace(F.lower(authority), r"^www\.", "")


def strip_fragment(url: Column | str) -> Column:
    """Drop the fragment and trailing slashes of an absolute URL."""
    return F.rtrim(F.get(F.split(_col(url), "#"), F.lit(0)), F.lit("/"))


def _collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    closed = F.when(path.rlike(r"/\.{1,2}$") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/")))
    return F.when(F.contains(path, F.lit("/.")), F.coalesce(closed, joined)).otherwise(path)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """RFC 3986 resolution of ``href`` against an absolute http(s) ``base``."""
    base, href = blank(base), blank(href)
    origin = F.regexp_extract(base, _ORIGIN, 1)
    path = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    no_fragment = F.get(F.split(base, "#"), F.lit(0))
    no_query = F.get(F.split(no_fragment, r"\?"), F.lit(0))
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_rest = F.substr(href, F.length(href_path) + F.lit(1))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))

    def on_origin(absolute_path: Column) -> Column:
        return F.concat(origin, let(absolute_path, _collapse_dots), href_rest)

    return (
        F.when(href == "", base)
        .when(base == "", href)
        .when(href.rlike(_SCHEME), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, _SCHEME, 0), href))
        .when(F.startswith(href, F.lit("/")), on_origin(href_path))
        .when(F.startswith(href, F.lit("?")), F.concat(no_query, href))
        .when(F.startswith(href, F.lit("#")), F.concat(no_fragment, href))
        .otherwise(on_origin(F.concat(folder, href_path)))
    )


def canonical_url(base: Column | str, href: Column | str) -> Column:
    return strip_fragment(resolve_url(base, href))


def is_http_url(url: Column | str) -> Column:
    """Well-formed absolute http(s) URL; the empty string is not one."""
    url = blank(url)
    return url.rlike(r"(?i)^https?://[^/?#\s]+[^\s]*$") & (F.length(url) <= 2083)


def display_url(url: Column | str) -> Column:
    """Validated URL as it is shown: scheme and host in lower case, a bare host gets its slash."""
    url = _col(url)
    origin = F.regexp_extract(url, _ORIGIN, 1)
    rest = F.substr(url, F.length(origin) + F.lit(1))
    return F.concat(F.lower(origin), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))
