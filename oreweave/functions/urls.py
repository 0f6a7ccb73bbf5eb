"""URL expressions. URLs are split by the RFC 3986 pattern, so malformed ones never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 4)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def canonical(url: Column) -> Column:
    """Query, fragment and one trailing slash of a non-empty path are dropped."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(path(bare).isin("", "/"), bare).otherwise(F.regexp_replace(bare, "/$", ""))


def drop_param(url: Column, name: str) -> Column:
    """URL without one query parameter; the order of the others is kept."""
    kept = F.array_join(
        F.filter(F.split(query(url), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name)), "&"
    )
    base = F.regexp_replace(url, r"[?#].*$", "")
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), fragment)


def _resolve_dots(path_text: Column) -> Column:
    segments = F.split(path_text, "/", -1)
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(resolved, "/")
    ends_in_dots = F.rlike(path_text, F.lit(r"/\.{1,2}$")) & ~F.endswith(joined, F.lit("/"))
    return F.when(ends_in_dots, F.concat(joined, F.lit("/"))).otherwise(joined)


def join(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base``."""
    root = origin(base)
    base_path = path(base)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    href_path = F.regexp_replace(href, r"[?#].*$", "")
    base_query = query(base)
    with_query = F.when(base_query != "", F.concat(F.lit("?"), base_query)).otherwise(F.lit(""))
    dotted = F.contains(href, F.lit("."))

    def clean(p: Column) -> Column:
        return F.when(dotted & F.rlike(p, F.lit(r"(^|/)\.{1,2}(/|$)")), _resolve_dots(p)).otherwise(p)

    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .when(F.startswith(href, F.lit("#")), F.concat(root, base_path, with_query, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, base_path, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, clean(href_path), tail))
        .otherwise(F.concat(root, clean(F.concat(folder, href_path)), tail))
    )


def to_https(url: Column, site: str) -> Column:
    return F.regexp_replace(url, f"^http://{site}", f"https://{site}")


def page_number(url: Column) -> Column:
    """Value of ``page`` or ``PAGEN_n``, or null."""
    digits = F.regexp_extract(url, r"[?&](?:page|PAGEN_\d+)=(\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def search_url(base: str, params: list[tuple[str, Column]]) -> Column:
    pairs = [F.concat(F.lit(f"{name}="), F.url_encode(value)) for name, value in params]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *pairs))


def path_id(url: Column, marker: str) -> Column:
    """Digits after ``/<marker>/``, or null."""
    found = F.regexp_extract(url, f"/{marker}/(\\d+)/", 1)
    return F.when(found != "", found)


def title_from_slug(url: Column) -> Column:
    """Readable title from the last part of an edition URL."""
    url_path = path(url)
    after_content = F.element_at(F.split(url_path, "/content/", -1), -1)
    last = F.element_at(F.split(F.regexp_replace(url_path, "/+$", ""), "/", -1), -1)
    slug = F.when(F.contains(url_path, F.lit("/content/")), after_content).otherwise(last)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.try_url_decode(slug), "[-_]+", " "), r"\s+", " "))
    text = F.substring(text, 1, 500)
    return F.when(text == "", "PAN Journals article").otherwise(text)


def normalize_doi(value: Column) -> Column:
    """DOI without its prefixes, lower case; null when nothing is left."""
    doi = F.trim(value)
    doi = F.regexp_replace(doi, "^https://doi\\.org/", "")
    doi = F.regexp_replace(doi, "^http://doi\\.org/", "")
    doi = F.lower(F.regexp_replace(doi, "^doi:", ""))
    return F.when(doi != "", doi)


def html_unescape(text: Column) -> Column:
    """The entities that occur in link attributes."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#38;", "&"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text
