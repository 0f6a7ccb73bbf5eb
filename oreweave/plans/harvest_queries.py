"""Harvest jobs over stored pages: documents of a language are the answers to the query of that name."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.operators.scans import numbering
from oreweave.plans import crawl as C
from oreweave.plans import harvest as H
from oreweave.plans.registry import query
from oreweave.session import shared_workdir, stored
from oreweave.sources.files import described_images
from oreweave.tables import table

PAGES = 3  # pages of the longest query


def _pages(spark, sf_dir):
    """Stored pages, the queries in order and the size of a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("query"), F.md5(F.coalesce("text", F.lit(""))).alias("work"))
    counts = docs.groupBy("query").agg(F.count("*").alias("n")).orderBy("query").collect()  # one row per query of the harvest
    size = max([-(-r["n"] // PAGES) for r in counts], default=1)
    placed = numbering(docs, ["query"], ["doc_id"], F.floor(F.col("doc_id") / 4096), "_n").withColumn("_n", F.col("_n") - 1)
    page = F.floor(F.col("_n") / size).cast("int")
    totals = spark.createDataFrame(counts, "query string, n long") if counts else spark.createDataFrame([], "query string, n long")
    rows = placed.join(totals, "query").select(
        "query", F.when(page == 0, "*").otherwise(page.cast("string")).alias("cursor"), (F.col("_n") % size).cast("int").alias("position"),
        F.to_json(F.struct(F.col("work").alias("id"))).alias("payload"),
        F.when((page + 1) * size < F.col("n"), (page + 1).cast("string")).alias("next_cursor"),
    )
    return stored(rows), [r["query"] for r in counts], size


_WORKS = f"""
  SELECT query, page, position, work_id, row_number() OVER (PARTITION BY work_id ORDER BY page, query, position) AS n FROM (
    SELECT query, work_id, rn // size AS page, rn % size AS position FROM (
      SELECT coalesce(lang, 'none') AS query, md5(coalesce(text, '')) AS work_id,
        row_number() OVER (PARTITION BY coalesce(lang, 'none') ORDER BY doc_id) - 1 AS rn FROM documents
    ), (SELECT ceil(max(n) / {PAGES}.0)::BIGINT AS size FROM (SELECT count(*) AS n FROM documents GROUP BY coalesce(lang, 'none')))
  )
"""


@query("harvest_job", f"""
  SELECT query, (max(page) + 1)::INTEGER AS pages, count(*) FILTER (n = 1) AS taken, 'last_page' AS reason, count(*) FILTER (n > 1) AS skipped
  FROM ({_WORKS}) GROUP BY query
""")
def harvest_job(spark, sf_dir):
    """A whole harvest: every query to its last page, each work once."""
    rows, names, size = _pages(spark, sf_dir)
    harvest = H.Harvest(spark, shared_workdir(spark, "harvest"), names, H.Limits(page_size=size))
    state = harvest.run(H.stored_pages(rows))
    asked = rows.groupBy("query").agg(F.count("*").alias("n"))
    return state.join(asked, "query").select("query", "pages", "taken", "reason", (F.col("n") - F.col("taken")).alias("skipped"))


@query("export_resume", f"SELECT query, (page + 1)::INTEGER AS round, position::INTEGER AS position, work_id FROM ({_WORKS}) WHERE n = 1")
def export_resume(spark, sf_dir):
    """Works of a harvest that was stopped after its first round and taken up by another object."""
    rows, names, size = _pages(spark, sf_dir)
    folder = shared_workdir(spark, "harvest")
    H.Harvest(spark, folder, names, H.Limits(page_size=size)).run(H.stored_pages(rows), max_rounds=1)
    harvest = H.Harvest(spark, folder, names, H.Limits(page_size=size))
    harvest.run(H.stored_pages(rows))
    return harvest.works().select("query", "round", "position", "work_id")


FANOUT = 32  # links of a page


@query("crawl_job", f"""
  WITH RECURSIVE reach AS (
    SELECT 0::BIGINT AS k, 0 AS depth
    UNION ALL
    SELECT p_partkey, depth + 1 FROM reach JOIN part ON (p_partkey - 1) // {FANOUT} = k AND p_partkey > 0 WHERE k % 7 <> 3
  )
  SELECT 'https://parts.example.org/part/' || k AS url, CASE WHEN k % 7 = 3 THEN 2 ELSE 1 END AS attempts, k % 77 <> 3 AS fetched,
    CASE WHEN k % 77 <> 3 THEN 'https://parts.example.org/files/' || k || '.pdf' END AS link
  FROM reach
""")
def crawl_job(spark, sf_dir):
    """A whole link harvest: the parts as linked pages, of which some answer at the second attempt and some never."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k)
    anchor = F.concat(F.lit('<a href="/part/'), k, F.lit('">next</a>'))
    below = parts.where(k > 0).groupBy(F.floor((k - 1) / FANOUT).alias("k")).agg(F.concat_ws("", F.collect_list(anchor)).alias("anchors"))
    site = parts.join(below, F.col("k") == k, "left").select(
        F.concat(F.lit("https://parts.example.org/part/"), k).alias("url"),
        F.concat(F.coalesce("anchors", F.lit("")), F.lit('<a href="/files/'), k, F.lit('.pdf">file</a>')).alias("html"),
        F.when(k % 77 == 3, 9).when(k % 7 == 3, 1).otherwise(0).alias("failures"),
    )
    crawl = C.Crawl(spark, shared_workdir(spark, "crawl"), ["https://parts.example.org/part/0"])
    done = crawl.run(C.stored_site(stored(site)))
    return done.join(crawl.links().select("link", F.col("page_url").alias("url")), "url", "left").select("url", "attempts", "fetched", "link")


@query("image_descriptions", """
  SELECT 'scan-' || doc_id AS path, CASE WHEN text IS NULL THEN 'name' WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)
    THEN 'cache' ELSE 'provider' END AS origin,
    CASE WHEN text IS NULL THEN 'Изображение: scan-' || doc_id ELSE 'image of ' || octet_length(encode(text)) || ' bytes' END AS description
  FROM documents
""")
def image_descriptions(spark, sf_dir):
    """Descriptions of all files after an earlier run over those of one language; equal contents are asked for once."""
    docs = table(spark, sf_dir, "documents")
    images = docs.select("lang", F.concat(F.lit("scan-"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    folder = shared_workdir(spark, "vision")

    def describe(content: bytes) -> str:
        return f"image of {len(content)} bytes"

    described_images(images.where("lang = 'en'"), folder, "stand-in", "size", describe)
    return described_images(images, folder, "stand-in", "size", describe).select("path", "origin", "description")
