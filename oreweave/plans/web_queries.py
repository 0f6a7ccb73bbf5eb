"""Link and crawl queries over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.functions import text as T
from oreweave.functions import urls as U
from oreweave.operators import links as L
from oreweave.operators.dedupe import keep_first
from oreweave.plans.registry import query, sql_text
from oreweave.sources.files import page_text
from oreweave.tables import table

_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"
_HREFS = f"list_transform(regexp_extract_all({_VISIBLE}, '(?is)<a\\s[^>]*>'), lambda t: regexp_extract(t, '(?is)\\shref\\s*=\\s*\"([^\"]*)\"', 1))"


@query("page_links", f"""
  WITH hrefs AS (SELECT page_id, {_ORIGIN} AS origin, unnest({_HREFS}) AS href FROM pages)
  SELECT DISTINCT page_id, origin || href AS link FROM hrefs WHERE href LIKE '/%' AND href NOT LIKE '%.'
""")
def page_links(spark, sf_dir):
    """Same-site links of every page without those ending in a dot."""
    found = L.page_links(table(spark, sf_dir, "pages"), ["page_id"], exclude=r"\.$", drop_param="utm_source")
    return found.select("page_id", "link")


_BARE_HTML = r"""regexp_replace(html, '(?i)href="([^"\s''`=<>]+)"', 'href=\1', 'g')"""


@query("page_links_unquoted", f"""
  WITH bare AS (SELECT page_id, url, {_BARE_HTML} AS html FROM pages),
  hrefs AS (SELECT page_id, {_ORIGIN} AS origin,
    unnest(list_transform(regexp_extract_all({_VISIBLE}, '(?is)<a\\s[^>]*>'), lambda t: regexp_extract(t, '(?is)\\shref\\s*=\\s*"?([^"\\s>]*)', 1))) AS href FROM bare)
  SELECT DISTINCT page_id, origin || href AS link FROM hrefs WHERE href LIKE '/%' AND href NOT LIKE '%.'
""")
def page_links_unquoted(spark, sf_dir):
    """The same links when the attributes of a page stand without quotes."""
    html = F.regexp_replace("html", r"(?i)href=\"([^\"\s'`=<>]+)\"", "href=$1")
    bare = table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))
    return L.page_links(bare, ["page_id"], exclude=r"\.$", drop_param="utm_source").select("page_id", "link")


_CANONICAL = "CASE WHEN regexp_extract(bare, '^[^:/?#]+://[^/]*(.*)$', 1) IN ('', '/') THEN bare ELSE regexp_replace(bare, '/$', '') END"


@query("url_canonical", f"""
  SELECT page_id, {_CANONICAL} AS canonical, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
    nullif(regexp_extract(url, '[?&](?:page|PAGEN_\\d+)=(\\d+)', 1), '')::BIGINT AS page_number
  FROM (SELECT *, regexp_replace(url, '[?#].*$', '') AS bare FROM pages)
""")
def url_canonical(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.canonical(url).alias("canonical"), U.host(url).alias("host"), U.page_number(url).alias("page_number")
    )


_DROPPED = """regexp_replace(url, '[?#].*$', '') ||
  CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || regexp_extract(url, '(#.*)$', 1)"""


@query("url_dedupe", f"""
  WITH keyed AS (
    SELECT page_id, url, {_DROPPED} AS link_key FROM (
      SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] <> 'ref'), '&') AS kept FROM pages))
  SELECT DISTINCT ON (link_key) link_key, page_id, url FROM keyed ORDER BY link_key, page_id
""")
def url_dedupe(spark, sf_dir):
    """First page of every URL, compared without the ``ref`` parameter."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.drop_param(F.col("url"), "ref").alias("link_key"))
    return keep_first(rows, ["link_key"], [F.asc("page_id")])


@query("next_page", f"""
  WITH links AS (SELECT page_id, url, {_ORIGIN} AS origin, {_HREFS} AS hrefs FROM pages),
  numbers AS (
    SELECT page_id, origin, coalesce(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '')::BIGINT, 1) AS current, unnest(list_transform(hrefs, lambda h: length(h))) AS n
    FROM links)
  SELECT p.page_id, CASE WHEN m.n IS NOT NULL THEN m.origin || '/results?page=' || m.n END AS next_url
  FROM pages p LEFT JOIN (SELECT page_id, origin, min(n) AS n FROM numbers WHERE n > current AND n >= 6 GROUP BY ALL) m USING (page_id)
""")
def next_pages(spark, sf_dir):
    """Pagination of result lists whose page numbers come from the links of the page."""
    numbers = F.filter(F.transform(L.anchor_hrefs(F.col("html")), lambda h: F.length(h)), lambda n: n >= 6)
    listing = F.concat(
        F.lit("<ul>"),
        F.array_join(F.transform(numbers, lambda n: F.concat(F.lit('<li><a href="/results?page='), n, F.lit('">p</a></li>'))), ""),
        F.lit("</ul>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url", listing.alias("html"))
    return pages.select("page_id", L.next_page(F.col("html"), F.col("url")).alias("next_url"))


_QUERIES = ["th", "casino win", "therwh", "tion"]
_KEY = "trim(regexp_replace(lower(url), '[^a-zа-я0-9]+', ' ', 'g'))"


@query("query_match", f"""
  SELECT page_id, {_KEY} AS search_key, CASE {' '.join(f"WHEN contains({_KEY}, {sql_text(q)}) THEN {sql_text(q)}" for q in _QUERIES)} END AS matched FROM pages
""")
def query_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.search_key(F.col("url")).alias("search_key"), L.matching_query(F.col("url"), _QUERIES).alias("matched")
    )


@query("filenames", r"""
  SELECT page_id, CASE WHEN name = '' THEN 'document' ELSE name END AS file_name FROM (
    SELECT page_id, substring(regexp_replace(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_.\-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 180) AS name FROM pages)
""")
def filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_filename(F.col("url")).alias("file_name"))


@query("sitemap_join", """
  WITH editions AS (SELECT page_id, 'http://site/edition/' || page_id || '/content/' || regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS loc FROM pages),
  pdfs AS (SELECT page_id % 200 AS cid, min(page_id) AS first_page FROM pages GROUP BY 1)
  SELECT e.page_id::VARCHAR AS content_id, 'http://site/Content/' || e.page_id || '/f' || first_page || '.pdf' AS pdf_url
  FROM editions e JOIN pdfs ON cid = e.page_id WHERE contains(trim(regexp_replace(lower(loc), '[^a-zа-я0-9]+', ' ', 'g')), 'th')
""")
def sitemap_join(spark, sf_dir):
    """Edition entries of a sitemap joined to the first PDF with the same content id."""
    pages = table(spark, sf_dir, "pages")
    editions = pages.select(
        F.lit("s1").alias("sitemap_url"), F.col("page_id").alias("position"),
        F.concat(F.lit("http://site/edition/"), "page_id", F.lit("/content/"), U.host(F.col("url"))).alias("loc"),
    )
    content = pages.select(
        F.lit("s2").alias("sitemap_url"), F.col("page_id").alias("position"),
        F.concat(F.lit("http://site/Content/"), F.pmod("page_id", F.lit(200)), F.lit("/f"), "page_id", F.lit(".pdf")).alias("loc"),
    )
    return L.sitemap_articles(content, editions, ["th"]).select("content_id", "pdf_url")


@query("new_links", """
  SELECT page_id, url AS link FROM pages WHERE page_id % 2 = 0
    AND regexp_replace(url, '[?#].*$', '') NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 2 = 1)
""")
def fresh_links(spark, sf_dir):
    bare = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("link"), F.col("url").alias("full"))
    found = bare.where(F.col("page_id") % 2 == 0)
    known = bare.where(F.col("page_id") % 2 == 1)
    return L.new_links(found, known).select("page_id", F.col("full").alias("link"))


@query("crawl_frontier", """
  WITH RECURSIVE edges AS (
    SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
    UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
  ), reach(node, depth) USING KEY (node) AS (
    SELECT 's0' AS node, 0 AS depth
    UNION
    SELECT dst, min(reach.depth) + 1 FROM reach JOIN edges ON src = node
    WHERE NOT EXISTS (SELECT 1 FROM recurring.reach r WHERE r.node = dst) GROUP BY dst
  )
  SELECT node, depth FROM reach
""")
def crawl_frontier(spark, sf_dir):
    """Breadth-first reach over the whole supplier-part link graph."""
    lines = table(spark, sf_dir, "lineitem")
    supplier, part = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    edges = lines.select(supplier.alias("src"), part.alias("dst")).unionByName(lines.select(part.alias("src"), supplier.alias("dst")))
    seeds = spark.range(1).select(F.lit("s0").alias("node"))
    return L.crawl(edges, seeds)


_LATIN = "".join(chr(b) for b in range(0x80, 0x100) if b != 0x98)
_CYRILLIC = "".join(bytes([b]).decode("cp1251") for b in range(0x80, 0x100) if b != 0x98)


@query("page_decode", f"""
  SELECT page_id, CASE WHEN page_id % 3 = 2 AND latin THEN translate('<meta charset="windows-1251">' || html || 'é', {sql_text(_LATIN)}, {sql_text(_CYRILLIC)})
    ELSE html || 'é' END AS html
  FROM (SELECT *, regexp_full_match(html, '(?s)[\\x00-\\xFF]*') AS latin FROM pages)
""")
def page_decode(spark, sf_dir):
    """Pages stored as bytes: UTF-8 and Latin-1 by their content type, cp1251 by their markup."""
    latin = F.rlike("html", F.lit("(?s)^[\\x00-\\xFF]*$"))
    turn = F.when(latin, F.col("page_id") % 3).otherwise(0)
    html = F.concat(F.when(turn == 2, '<meta charset="windows-1251">').otherwise(""), "html", F.lit("é"))
    content = F.when(turn == 0, F.encode(html, "UTF-8")).otherwise(F.encode(html, "ISO-8859-1"))
    kind = F.when(turn == 0, "text/html; charset=UTF-8").when(turn == 1, "text/html; charset=ISO-8859-1")
    return table(spark, sf_dir, "pages").select("page_id", page_text(content, kind).alias("html"))
