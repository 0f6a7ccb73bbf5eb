"""Links, pagination and crawl state of web pages that are already stored."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave.functions import text as T
from oreweave.functions import urls as U
from oreweave.operators.dedupe import keep_first
from oreweave.session import ensure_checkpoint_dir

INVISIBLE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
ANCHOR = r"(?is)<a\s[^>]*>.*?</a>|<a\s[^>]*>"
NEXT_CLASSES = ["next", "pagination-next", "forward", "pager-next", "btn-next"]
NEXT_TEXTS = ["следующая", "next", ">", "»", "далее"]


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, INVISIBLE, "")


def attribute(tag: Column, name: str) -> Column:
    return U.html_unescape(
        F.coalesce(
            F.nullif(F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")),
            F.nullif(F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*'([^']*)'", 1), F.lit("")),
            F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*([^\s\"'<>=`][^\s\"'<>`]*)", 1),
        )
    )


def anchor_hrefs(html: Column) -> Column:
    tags = F.regexp_extract_all(visible(html), F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h != "")


def href_candidates(html: Column, raw_pattern: str) -> Column:
    """Link texts of a page; each fallback is used only when all tiers before it are empty.

    Anchors of the visible markup, any ``href``, ``onclick``/``data-url``/``data-href``, then
    raw URLs matching ``raw_pattern``.
    """
    any_href = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"'>]*)[\"']"), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*([^\s\"'<>=`][^\s\"'<>`]*)"), F.lit(1)),
    )
    data = F.regexp_extract_all(html, F.lit(r"(?i)(?:onclick|data-url|data-href)\s*=\s*[\"']([^\"'>]*)[\"']"), F.lit(1))
    raw = F.regexp_extract_all(html, F.lit(raw_pattern), F.lit(0))

    def filled(links: Column) -> Column:
        kept = F.array_distinct(F.filter(links, lambda h: h != ""))
        return F.when(F.size(kept) > 0, kept)

    empty = F.array().cast("array<string>")
    return F.coalesce(filled(anchor_hrefs(html)), filled(any_href), filled(data), filled(raw), empty)


def page_links(
    pages: DataFrame,
    keys: Sequence[str],
    same_site: bool = True,
    include: str | None = None,
    exclude: str | None = None,
    drop_param: str | None = None,
    raw_pattern: str = r"https?://[^\s\"<>]+",
) -> DataFrame:
    """Absolute links of every page, first occurrence of each, in page order.

    pages: ``keys``, url, html. ``include`` and ``exclude`` are URL patterns; ``drop_param``
    names a query parameter that does not identify a link.
    """
    rows = pages.select(*keys, "url", F.posexplode(href_candidates(F.col("html"), raw_pattern)).alias("position", "href"))
    rows = rows.where(~F.rlike("href", F.lit(r"(?i)^(javascript:|mailto:|#)")))
    linked = rows.withColumn("link", U.join(F.col("url"), F.col("href")))
    if same_site:
        linked = linked.where(F.startswith(F.col("link"), U.origin(F.col("url"))))
    if include:
        linked = linked.where(F.rlike("link", F.lit(include)))
    if exclude:
        linked = linked.where(~F.rlike("link", F.lit(exclude)))
    if drop_param:
        linked = linked.withColumn("link", U.drop_param(F.col("link"), drop_param))
    return keep_first(linked.select(*keys, "url", "position", "link"), [*keys, "link"], [F.asc("position")])


def section_links(pages: DataFrame, keys: Sequence[str], pattern: str = r"^(/[a-z]+/\d+)/?$") -> DataFrame:
    """Distinct section URLs ``/name/number`` other than the page itself."""
    rows = pages.select(*keys, "url", F.explode(anchor_hrefs(F.col("html"))).alias("href"))
    absolute = U.canonical(U.join(F.col("url"), F.col("href")))
    section = F.regexp_extract(U.path(F.col("_link")), pattern, 1)
    return (
        rows.withColumn("_link", absolute)
        .where(U.origin(F.col("_link")) == U.origin(F.col("url")))
        .where(section != "")
        .select(*keys, F.concat(U.origin(F.col("url")), section).alias("link"), U.canonical(F.col("url")).alias("_self"))
        .where(F.col("link") != F.col("_self"))
        .select(*keys, "link")
        .distinct()
    )


def next_page(html: Column, url: Column) -> Column:
    """URL of the next result page or null.

    The smallest page number above the current one wins; then class, text, ``rel``,
    ``data-page``, list membership and ``aria-label`` hints, in that order.
    """
    current = F.coalesce(U.page_number(url), F.lit(1))
    site = U.origin(url)
    tags = F.regexp_extract_all(visible(html), F.lit(ANCHOR), F.lit(0))

    def link_of(tag: Column) -> Column:
        return F.struct(
            U.join(url, attribute(tag, "href")).alias("link"),
            attribute(tag, "href").alias("href"),
            F.lower(attribute(tag, "class")).alias("cls"),
            F.lower(T.strip_tags(tag)).alias("text"),
            F.lower(attribute(tag, "rel")).alias("rel"),
            attribute(tag, "data-page").try_cast("bigint").alias("data_page"),
            F.lower(attribute(tag, "aria-label")).alias("aria"),
        )

    own = F.filter(F.transform(tags, link_of), lambda a: (a["href"] != "") & F.startswith(a["link"], site))
    listing = F.filter(own, lambda a: ~F.rlike(U.path(a["link"]), F.lit("^/catalog/")))
    numbered = F.filter(
        F.transform(listing, lambda a: F.struct(U.page_number(a["link"]).alias("n"), a["link"].alias("link"))),
        lambda p: p["n"] > current,
    )
    ordered = F.transform(numbered, lambda p, i: F.struct(p["n"].alias("n"), i.alias("i"), p["link"].alias("link")))
    smallest = F.array_min(ordered)["link"]

    def first(links: Column, test) -> Column:
        return F.get(F.filter(links, test), F.lit(0))["link"]

    by_data = F.transform(
        F.filter(own, lambda a: a["data_page"] > current),
        lambda a, i: F.struct(a["data_page"].alias("n"), i.alias("i"), a["link"].alias("link")),
    )
    return F.coalesce(
        smallest,
        first(listing, lambda a: T.any_contains(a["cls"], NEXT_CLASSES)),
        first(listing, lambda a: T.any_contains(a["text"], NEXT_TEXTS)),
        first(own, lambda a: F.array_contains(F.split(a["rel"], r"\s+"), "next")),
        F.array_min(by_data)["link"],
        first(own, lambda a: T.any_contains(a["aria"], ["next", "след"])),
    )


def nearest_article_links(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PDF links with the last article link before them on the same page.

    pages: ``keys``, url, html. A page is one row, so the window never outgrows it.
    """
    tags = F.regexp_extract_all(visible(F.col("html")), F.lit(ANCHOR), F.lit(0))
    rows = pages.repartition(*keys).select(*keys, "url", F.posexplode(tags).alias("position", "_tag")).select(
        *keys,
        "position",
        U.join(F.col("url"), attribute(F.col("_tag"), "href")).alias("href"),
        attribute(F.col("_tag"), "title").alias("title_attr"),
        T.strip_tags(F.col("_tag")).alias("label"),
    )
    is_article = (
        F.contains("href", F.lit("/dlibra/publication/")) & F.contains("href", F.lit("/content"))
        & (F.col("label") != "") & (F.col("label") != "Go to article")
    )
    so_far = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    article = F.last(F.when(is_article, F.struct("href", "label")), ignorenulls=True).over(so_far)
    pdf = F.contains("href", F.lit("/Content/")) & F.contains("href", F.lit("handler=pdf"))
    found = rows.withColumn("_article", article).withColumn("_is_article", is_article).where(pdf & ~F.col("_is_article"))
    first = keep_first(found, [*keys, "href"], [F.asc("position")])
    file_name = F.element_at(F.split(U.path(F.col("href")), "/", -1), -1)
    return first.select(
        *keys,
        "position",
        F.coalesce("_article.label", F.nullif("title_attr", F.lit("")), file_name).alias("title"),
        F.coalesce("_article.href", F.lit("")).alias("article_url"),
        F.col("href").alias("pdf_url"),
        U.path_id(F.col("href"), "Content").alias("content_id"),
    )


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """``<loc>`` entries of sitemap files (``sitemap_url, xml``)."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1))
    return sitemaps.select("sitemap_url", F.posexplode(locs).alias("position", "loc"))


def sitemap_articles(content: DataFrame, editions: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Edition URLs matching a query, joined to the first PDF of the same content id.

    content, editions: ``sitemap_url, position, loc``.
    """
    pdfs = keep_first(
        content.where(F.contains(F.lower("loc"), F.lit(".pdf")))
        .withColumn("content_id", U.path_id(F.col("loc"), "Content"))
        .where(F.col("content_id").isNotNull()),
        ["content_id"],
        [F.asc("sitemap_url"), F.asc("position")],
    ).select("content_id", F.col("loc").alias("pdf_url"))
    matched = (
        editions.withColumn("query", matching_query(F.col("loc"), queries))
        .withColumn("content_id", U.path_id(F.col("loc"), "edition"))
        .where(F.col("query").isNotNull() & F.col("content_id").isNotNull())
    )
    first = keep_first(matched, ["content_id"], [F.asc("sitemap_url"), F.asc("position")])
    return first.join(pdfs, "content_id").select(
        "query", "content_id", U.title_from_slug(F.col("loc")).alias("title"), F.col("loc").alias("article_url"), "pdf_url"
    )


def matching_query(url: Column, queries: Sequence[str]) -> Column:
    """The first query whose normalised words occur in the normalised URL."""
    hay = T.search_key(F.try_url_decode(url))
    needles = F.array(*[F.struct(F.lit(q).alias("q"), T.search_key(F.lit(q)).alias("key")) for q in queries])
    return F.get(F.filter(needles, lambda n: (n["key"] != "") & F.contains(hay, n["key"])), F.lit(0))["q"]


# Fixed link formats of the issue archive.
ISSUE_TEXT = r"Volume\s+(\d+)\s+Issue\s+(\d+)[A-Za-z]?/(\d{4})"
ISSUE_PDF = r"/files/archiwum/Vol\d+_\d{4}/(\d+)\.pdf$"


def issue_links(pages: DataFrame, text_pattern: str = ISSUE_TEXT) -> DataFrame:
    """Volume, issue and year of the archive menu links (``url, html`` pages)."""
    tags = F.regexp_extract_all(visible(F.col("html")), F.lit(ANCHOR), F.lit(0))
    rows = pages.select("url", F.posexplode(tags).alias("position", "_tag")).withColumn("_text", T.strip_tags(F.col("_tag")))
    parts = [F.regexp_extract("_text", text_pattern, i).try_cast("int") for i in (1, 2, 3)]
    found = rows.select(
        parts[0].alias("volume"), parts[1].alias("issue"), parts[2].alias("year"),
        U.join(F.col("url"), attribute(F.col("_tag"), "href")).alias("issue_url"), "position",
    ).where(F.col("volume").isNotNull() & F.col("year").isNotNull())
    return keep_first(found, ["issue_url"], [F.asc("position")]).drop("position")


def issue_articles(
    issues: DataFrame, issue_pages: DataFrame, volume: int | None = None, year: int | None = None, pattern: str = ISSUE_PDF
) -> DataFrame:
    """PDF links of the issue pages (``url, html``) with the numbers of their issue."""
    if volume is not None:
        issues = issues.where(F.col("volume") == volume)
    if year is not None:
        issues = issues.where(F.col("year") == year)
    links = issue_pages.select("url", F.posexplode(anchor_hrefs(F.col("html"))).alias("position", "href")).where(
        F.rlike("href", F.lit(pattern))
    )
    rows = issues.join(links, issues["issue_url"] == links["url"]).select(
        "volume", "issue", "year",
        F.regexp_extract("href", pattern, 1).cast("int").alias("number"),
        U.join(F.col("url"), F.col("href")).alias("pdf_url"), "position",
    )
    return keep_first(rows, ["pdf_url"], [F.asc("position")]).drop("position").orderBy("volume", "year", "number", "pdf_url")


def crawl(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Breadth-first reach of the seeds: ``node`` and the round it was first seen in.

    edges: ``src``, ``dst``. Each round joins only the newest nodes with the edges and drops
    what was seen before. Rounds are checkpointed, so the plan stays short and a lost executor
    never restarts the crawl. It ends when a round finds nothing new; ``max_rounds`` and
    ``max_pages`` are limits for callers that want one (the latter ends with the round that
    reaches it).
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct().checkpoint()
    frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    visited = frontier
    total = frontier.count()
    for depth in itertools.count(1):
        if max_rounds is not None and depth > max_rounds:
            break
        reached = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        fresh = frontier.count()
        if not fresh:
            break
        visited = visited.unionByName(frontier)
        total += fresh
        if max_pages is not None and total >= max_pages:
            break
    return visited


def new_links(found: DataFrame, known: DataFrame, drop_param: str = "name") -> DataFrame:
    """Links not harvested before, compared without the parameter that does not identify them."""
    fresh = found.withColumn("_key", U.drop_param(F.col("link"), drop_param))
    old = known.select(U.drop_param(F.col("link"), drop_param).alias("_key"))
    return fresh.join(old, "_key", "left_anti").drop("_key")


def doi_links(payloads: DataFrame, resolver: str = "https://doi.org/") -> DataFrame:
    """Works with a DOI out of search payloads (JSON ``payload`` with a ``results`` array)."""
    schema = (
        "results ARRAY<STRUCT<doi: STRING, title: STRING, year: INT, journal: STRING, score: DOUBLE>>"
    )
    works = payloads.select(F.inline(F.from_json("payload", schema)["results"]))
    return works.where(F.coalesce("doi", F.lit("")) != "").select(
        "doi", "title", "year", "journal", "score", F.concat(F.lit(resolver), "doi").alias("url")
    )
