"""Crawls of linked pages, in rounds that can be taken up again.

A round fetches the pages found by the round before in one Spark job, keeps them, and takes the
file links and the section links out of them. Pages that fail are put off and tried again at the
end, when no new page is left, a given number of times. Each step is a table below one folder:
`pages`, then `links`, `found` and last `nodes` (pages to fetch next), so a crawl that was
stopped goes on after the last whole step and asks for no page twice.

Defined results: a link belongs to the earliest round that meets it, in it to the page with the
smallest URL, then to its first place there. Repeated and null seeds count once or not at all; no
seeds give an empty crawl. Where a page limit cuts a round, pages come in the order of their URLs.
Sections of pages that answered only when tried again are followed with `follow_retried` only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.functions import urls as U
from oreweave.operators import links as L
from oreweave.operators.dedupe import keep_first
from oreweave.sinks.rounds import Rounds
from oreweave.sources import providers

PAGE = "url string, attempt int, html string, error string"
NODE = "url string, depth int"
LINK = "link string, page_url string, position int, round int"
Fetch = Callable[[DataFrame], DataFrame]  # url, attempt -> PAGE rows


@dataclass
class Limits:
    """Zero means no limit; `retries` is the number of passes over pages that failed."""

    pages: int = 0
    links: int = 0
    retries: int = 1
    follow_retried: bool = False


@dataclass
class Crawl(Rounds):
    """A crawl below one folder. `files` and `sections` are the patterns of file and section links."""

    seeds: Sequence[str] = ()
    limits: Limits = field(default_factory=Limits)
    files: str = r"(?i)\.pdf(?:[?#]|$)"
    sections: str = r"^(/[a-z]+/\d+)/?$"
    known: DataFrame | None = None  # links of earlier exports, column link

    LAST = "nodes"

    def run(self, fetch: Fetch, max_rounds: int | None = None) -> DataFrame:
        """Rounds until nothing is left to ask (or `max_rounds` of this call); returns `outcomes`."""
        if not self._done("nodes", 0):
            seeds = self.spark.createDataFrame([(s,) for s in self.seeds if s], "url string")
            self._write("nodes", 0, seeds.select(U.canonical(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct(), NODE)
        number = self.rounds()
        last = None if max_rounds is None else number + max_rounds
        while number != last:
            asked = self._ask(number)
            if asked is None:
                break
            number += 1
            self._round(number, asked, fetch)
        return self.outcomes()

    def pages(self) -> DataFrame:
        """Every answer, with its attempt."""
        return self._read_all("pages", range(1, self.rounds() + 1), PAGE)

    def links(self) -> DataFrame:
        """File links, each once."""
        return self._read_all("links", range(1, self.rounds() + 1), LINK)

    def outcomes(self) -> DataFrame:
        """One row per page asked for: url, attempts, fetched."""
        return self.pages().groupBy("url").agg(F.max("attempt").alias("attempts"), F.max(F.col("error").isNull()).alias("fetched"))

    def _ask(self, number: int) -> DataFrame | None:
        """Pages of the next round with their attempt: new ones, or at the end those that failed."""
        if self.limits.links and self.links().count() >= self.limits.links:
            return None
        if self._done("pages", number + 1):  # fetched before the crawl was stopped
            return self._read("pages", number + 1, PAGE).select("url", "attempt")
        fresh = self._read("nodes", number, NODE).select("url", F.lit(1).alias("attempt"))
        if self.limits.pages:
            room = self.limits.pages - self.pages().where("attempt = 1").count()
            fresh = fresh.orderBy("url").limit(max(room, 0))
        if fresh.limit(1).count():
            return fresh
        failed = self.outcomes().where(~F.col("fetched") & (F.col("attempts") <= self.limits.retries))
        again = failed.select("url", (F.col("attempts") + 1).alias("attempt"))
        return again if again.limit(1).count() else None

    def _round(self, number: int, asked: DataFrame, fetch: Fetch) -> None:
        page = self._read("pages", number, PAGE) if self._done("pages", number) else self._write("pages", number, fetch(asked), PAGE)
        good = page.where("error is null and html is not null")
        if not self._done("links", number):
            rows = L.page_links(good.select(F.col("url").alias("page_url"), "url", "html"), ["page_url"], same_site=False, include=self.files)
            first = keep_first(rows, ["link"], [F.asc("page_url"), F.asc("position")]).select("link", "page_url", "position", F.lit(number).alias("round"))
            earlier = self._read_all("links", range(1, number), LINK)
            fresh = first.join(earlier, "link", "left_anti")
            if self.known is not None:
                fresh = L.new_links(fresh, self.known)
            if self.limits.links:
                fresh = fresh.orderBy("page_url", "position").limit(self.limits.links - earlier.count())
            self._write("links", number, fresh.select("link", "page_url", "position", "round"), LINK)
        followed = good if self.limits.follow_retried else good.where("attempt = 1")
        depths = self._read_all("nodes", range(number), NODE)
        if not self._done("found", number):
            parents = followed.join(depths, "url").select("url", "html", "depth")
            rows = L.section_links(parents, ["depth"], self.sections)
            rows = rows.groupBy(F.col("link").alias("url")).agg((F.min("depth") + 1).cast("int").alias("depth"))
            self._write("found", number, rows, NODE)
        found = self._read("found", number, NODE)
        seen = depths.join(found, "url", "left_semi").select("url")  # all nodes are scanned; only those met again go on
        self._write("nodes", number, found.join(seen, "url", "left_anti"), NODE)


def fetched(function: str, options: dict[str, str] | None = None) -> Fetch:
    """Pages from `module:function` (options, url -> markup; a RuntimeError is a failed page)."""
    settings = dict(options or {})

    def pages(asked: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fetch = providers.load_function(function)
            for frame in frames:
                rows = []
                for url, attempt in zip(frame["url"], frame["attempt"].tolist()):
                    try:
                        rows.append((url, attempt, fetch(settings, url), None))
                    except RuntimeError as exc:
                        rows.append((url, attempt, None, str(exc)))
                yield pd.DataFrame(rows, columns=["url", "attempt", "html", "error"])

        return asked.repartition("url").mapInPandas(run, PAGE)

    return pages


def stored_site(site: DataFrame) -> Fetch:
    """Pages from a table (`url, html, failures`); a page fails that many times before it answers."""

    def pages(asked: DataFrame) -> DataFrame:
        rows = asked.join(site.select("url", "html", "failures"), "url", "left")
        bad = F.when(F.col("html").isNull(), "not found").when(F.col("attempt") <= F.col("failures"), "no answer")
        return rows.select("url", "attempt", F.when(bad.isNull(), F.col("html")).alias("html"), bad.alias("error"))

    return pages


def harvest_links(
    spark: SparkSession, out: str, seeds: Sequence[str], fetch: Fetch, limits: Limits | None = None,
    known: DataFrame | None = None, max_rounds: int | None = None, **patterns: str,
) -> dict:
    """A whole link harvest below `out`: crawl, links as text lines, manifest. A second call goes on."""
    crawl = Crawl(spark, f"{out.rstrip('/')}/crawl", seeds, limits or Limits(), known=known, **patterns)
    done = crawl.run(fetch, max_rounds).agg(
        F.count("*").alias("pages"), F.count_if("fetched").alias("fetched"), F.count_if(F.col("attempts") > 1).alias("retried"),
        F.count_if(~F.col("fetched")).alias("failed"),
    ).first()
    links = crawl.links()
    links.orderBy("round", "page_url", "position").select(F.col("link").alias("value")).write.mode("overwrite").text(f"{out.rstrip('/')}/links")
    running = crawl._ask(crawl.rounds()) is not None
    manifest = {
        "status": "running" if running else "completed_degraded" if done["failed"] else "completed", **done.asDict(),
        "rounds": crawl.rounds(), "links_written": links.count(), "limits": vars(crawl.limits), "seeds": list(seeds),
    }
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}/manifest")
    return manifest
