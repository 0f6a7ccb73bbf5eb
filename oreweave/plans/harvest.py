"""Harvests of paged providers, in rounds that can be taken up again.

A literature harvest asks every query that is still open for its next page in one Spark job per
round. The pages of a round are written before anything else happens with them; then its new
works, then the state of the queries (cursor, pages, stale pages, works taken). A harvest that
was stopped goes on after the last written step, so no page is fetched twice. A query ends with
its last page, an empty page, an error, its cap, its page limit or a number of stale pages (pages
without a new work); the whole harvest ends with all its queries or with the total cap.

A work belongs to the query that reaches it in the earliest round, then to the first of the
queries. Works of earlier exports are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreweave.functions.urls import normalize_doi
from oreweave.session import stored
from oreweave.sinks import exports
from oreweave.sinks.rounds import Rounds
from oreweave.sources import jsonl, providers

PAGE = "query string, round int, position int, payload string, next_cursor string, error string"
STATE = "query string, query_index int, cursor string, pages int, stale int, taken long, reason string, error string"
WORK = "query string, query_index int, round int, position int, work_id string, payload string"
Pages = Callable[[DataFrame, int], DataFrame]  # open queries (query, cursor, size) and the round -> PAGE rows


@dataclass
class Limits:
    """Zero means no limit."""

    per_query: int = 0
    total: int = 0
    pages: int = 0
    stale_pages: int = 0
    page_size: int = 200


@dataclass
class Harvest(Rounds):
    """A harvest below one folder: `pages`, `works` and `state`, each by round."""

    queries: Sequence[str] = ()
    limits: Limits = field(default_factory=Limits)
    seen: DataFrame | None = None  # work_id of earlier exports
    taken: dict[str, int] = field(default_factory=dict)  # works of a query in earlier exports

    def works(self, rounds: int | None = None) -> DataFrame:
        """New works of all rounds, or of the first ones."""
        return self._read_all("works", range(1, 1 + (self.rounds() if rounds is None else rounds)), WORK)

    def state(self) -> DataFrame:
        """The queries after the last round."""
        number = self.rounds()
        if number:
            return self._read("state", number, STATE)
        rows = [(q, i, "*", 0, 0, self.taken.get(q, 0), self._full(self.taken.get(q, 0)), None) for i, q in enumerate(self.queries)]
        return self.spark.createDataFrame(rows, STATE)

    def _full(self, taken: int) -> str | None:
        return "limit_per_query" if self.limits.per_query and taken >= self.limits.per_query else None

    def run(self, pages: Pages, max_rounds: int | None = None) -> DataFrame:
        """Rounds until no query is open (or `max_rounds` of this call); returns the state."""
        number, last = self.rounds(), None if max_rounds is None else self.rounds() + max_rounds
        while number != last and self._open(number) is not None:
            number += 1
            self._round(number, pages)
        return self.state()

    def _open(self, number: int) -> DataFrame | None:
        """Open queries with the size of their next page; None if nothing is left to ask."""
        limits, room = self.limits, None
        if limits.total:
            room = limits.total - self.works(number).count()
            if room <= 0:
                return None
        size = F.lit(limits.page_size)
        if limits.per_query:
            size = F.least(size, (limits.per_query - F.col("taken")).cast("int"))
        if room is not None:
            size = F.least(size, F.lit(room))
        some = self.state().where("reason is null").select("query", "query_index", "cursor", size.alias("size"))
        return some if some.limit(1).count() else None

    def _round(self, number: int, pages: Pages) -> None:
        state = self.state()
        if self._done("pages", number):  # fetched before the harvest was stopped
            page = self._read("pages", number, PAGE)
        else:
            page = self._write("pages", number, pages(self._open(number - 1), number), PAGE)
        works = self._write("works", number, self._new_works(page, state, number), WORK)
        found = page.groupBy("query").agg(
            F.count("payload").alias("_works"), F.max("next_cursor").alias("_next"), F.max("error").alias("_error"),
        )
        fresh = works.groupBy("query").agg(F.count("*").alias("_fresh"))
        both = state.where("reason is null").join(found, "query", "left").join(fresh, "query", "left")
        none = F.coalesce("_fresh", F.lit(0)) == 0
        both = both.withColumns({
            "_pages": F.col("pages") + F.when(F.col("_error").isNull(), 1).otherwise(0), "_stale": F.when(none, F.col("stale") + 1).otherwise(0),
            "_taken": F.col("taken") + F.coalesce("_fresh", F.lit(0)), "_works": F.coalesce("_works", F.lit(0)),
        })
        limits = self.limits
        reason = F.when(F.col("_error").isNotNull(), "fetch_error").when(F.col("_works") == 0, "empty_page")
        for limit, column, name in ((limits.per_query, "_taken", "limit_per_query"), (limits.stale_pages, "_stale", "max_stale_pages"), (limits.pages, "_pages", "max_pages_per_query")):
            if limit:
                reason = reason.when(F.col(column) >= limit, name)
        reason = reason.when(F.col("_next").isNull(), "last_page")
        moved = both.select(
            "query", "query_index", F.coalesce("_next", "cursor").alias("cursor"), F.col("_pages").alias("pages"), F.col("_stale").cast("int").alias("stale"),
            F.col("_taken").alias("taken"), reason.alias("reason"), F.col("_error").alias("error"),
        )
        self._write("state", number, state.where("reason is not null").unionByName(moved).coalesce(1), STATE)

    def _new_works(self, page: DataFrame, state: DataFrame, number: int) -> DataFrame:
        """Works of a round's pages that nothing has found before, within the caps."""
        record = F.from_json("payload", "id STRING, doi STRING")
        rows = page.where("payload is not null").select("query", "position", F.coalesce(record["id"], record["doi"]).alias("work_id"), "payload")
        rows = rows.where(F.col("work_id") != "").join(state.select("query", "query_index", "taken"), "query")
        known = self.works(number - 1).select("work_id")
        if self.seen is not None:
            known = known.unionByName(self.seen.select(F.col("work_id").cast("string")))
        order = [F.asc("query_index"), F.asc("position")]
        first = F.row_number().over(Window.partitionBy("work_id").orderBy(*order))
        rows = rows.withColumn("_n", first).where("_n = 1").join(known, "work_id", "left_anti")
        if self.limits.per_query:
            place = F.row_number().over(Window.partitionBy("query").orderBy("position"))
            rows = rows.withColumn("_n", place).where(F.col("_n") + F.col("taken") <= self.limits.per_query)
        if self.limits.total:  # at most one page per query is ranked here
            room = self.limits.total - self.works(number - 1).count()
            rows = rows.orderBy(*order).limit(max(room, 0))
        return rows.select("query", "query_index", F.lit(number).alias("round"), "position", "work_id", "payload")

    def skipped(self) -> int:
        """Works of all pages that were no new ones."""
        rounds = self.rounds()
        paths = [self._path("pages", n + 1) for n in range(rounds)]
        return self.spark.read.schema(PAGE).parquet(*paths).where("payload is not null").count() - self.works(rounds).count() if paths else 0


def fetched_pages(options: dict[str, str]) -> Pages:
    """Pages from the provider's own cursor function (`fetch`: module:function), one task per open query."""

    def pages(open_queries: DataFrame, number: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fetch = providers.load_function(options.get("fetch", "oreweave.sources.providers:fetch_openalex"))
            for frame in frames:
                for query, cursor, size in zip(frame["query"], frame["cursor"], frame["size"].tolist()):
                    try:
                        works, after = fetch(options, query, cursor, size)
                        rows = [(query, number, i, json.dumps(w, ensure_ascii=False, sort_keys=True), after, None) for i, w in enumerate(works)]
                    except RuntimeError as exc:
                        rows = [(query, number, 0, None, None, str(exc))]
                    yield pd.DataFrame(rows, columns=["query", "round", "position", "payload", "next_cursor", "error"])

        asked = open_queries.select("query", "cursor", "size").repartition("query")
        return asked.mapInPandas(run, PAGE)

    return pages


def stored_pages(table: DataFrame) -> Pages:
    """Pages from a table of them (`query, cursor, position, payload, next_cursor`)."""

    def pages(open_queries: DataFrame, number: int) -> DataFrame:
        found = table.join(open_queries.select("query", "cursor"), ["query", "cursor"])
        return found.select("query", F.lit(number).alias("round"), "position", "payload", "next_cursor", F.lit(None).cast("string").alias("error"))

    return pages


def open_access(works: DataFrame, fetch: str, options: dict[str, str] | None = None) -> DataFrame:
    """Open-access lookups (`doi, unpaywall, error`) of the distinct DOIs of works, each asked for once."""
    settings = dict(options or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = providers.load_function(fetch)
        for frame in frames:
            rows = []
            for doi in frame["doi"]:
                try:
                    rows.append((doi, json.dumps(ask(settings, doi), ensure_ascii=False), None))
                except RuntimeError as exc:
                    rows.append((doi, None, str(exc)))
            yield pd.DataFrame(rows, columns=["doi", "unpaywall", "error"])

    dois = works.select(F.col("doi")).where("doi is not null").distinct().repartition("doi")
    return stored(dois.mapInPandas(run, "doi string, unpaywall string, error string"))


def export_literature(
    spark: SparkSession, out: str, queries: Sequence[str], pages: Pages, limits: Limits | None = None, resume_from: Sequence[str] = (),
    lookup: str | None = None, options: dict[str, str] | None = None, ledger=None, run_name: str = "literature", max_rounds: int | None = None,
) -> dict:
    """A whole literature export below `out`: harvest, records as JSON lines, manifest, ledger run.

    A call for a folder that holds an unfinished harvest goes on with it. `resume_from` names
    JSON-lines exports whose works are passed over and count towards the caps of their queries.
    """
    seen, taken = None, {}
    for path in resume_from:
        key = F.coalesce(F.col("record.openalex.id"), F.col("record.openalex.doi"))
        more = jsonl.seen_keys(spark, path, "openalex STRUCT<id: STRING, doi: STRING>", key).select(F.col("key").alias("work_id"))
        seen = more if seen is None else seen.unionByName(more)
        for r in jsonl.query_counts(spark, path).collect():
            taken[r["query"]] = taken.get(r["query"], 0) + r["records"]
    harvest = Harvest(spark, f"{out.rstrip('/')}/harvest", queries, limits or Limits(), seen, taken)
    state = harvest.run(pages, max_rounds)
    rounds = harvest.rounds()
    works = harvest.works(rounds).withColumn("doi", normalize_doi(F.from_json("payload", "doi STRING")["doi"]))
    lookups = open_access(works, lookup, options) if lookup else spark.createDataFrame([], "doi string, unpaywall string, error string")
    records = providers.with_unpaywall(works, lookups.where("error is null"))
    line = F.concat(
        F.lit('{"query": '), F.to_json(F.array("query")).substr(F.lit(2), F.length(F.to_json(F.array("query"))) - 2), F.lit(', "openalex": '), F.col("payload"),
        F.lit(', "unpaywall": '), F.coalesce("unpaywall", F.lit("null")), F.lit("}"),
    )
    records.orderBy("round", "query_index", "position").select(line.alias("value")).write.mode("overwrite").text(f"{out.rstrip('/')}/records")
    rows = state.orderBy("query_index").collect()
    open_, failed = sum(r["reason"] is None for r in rows), sum(r["reason"] == "fetch_error" for r in rows)
    full = bool(limits and limits.total and works.count() >= limits.total)
    manifest = {
        "status": "running" if open_ and not full else "completed_degraded" if failed else "completed",
        "queries": [{k: r[k] for k in ("query", "pages", "taken", "reason", "error")} for r in rows],
        "rounds": rounds, "records_written": works.count(), "skipped_existing": harvest.skipped(), "failed_queries": failed,
        "unpaywall_checked": lookups.count(), "limits": vars(limits or Limits()), "resume_from": list(resume_from), "run_id": None,
    }
    if ledger is not None and manifest["status"] != "running" and works.limit(1).count():
        from oreweave.plans.pipeline import ingest_records

        run_id = manifest["run_id"] = ingest_records(spark, ledger, works.select("payload"), "openalex", run_name)
        ledger.append("artifacts", spark.createDataFrame(
            [(f"{run_id}:export", run_id, "openalex", "openalex_export", "failed" if failed else "completed", out, json.dumps({k: manifest[k] for k in ("records_written", "skipped_existing", "unpaywall_checked")}))],
            "id string, run_id string, kind string, stage string, status string, path string, metadata string",
        ))
        if failed:
            ledger.set_status(run_id, "completed_degraded")
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}/manifest")
    return manifest


def export_offsets(
    spark: SparkSession, out: str, options: dict[str, str], schema: str, key: str, resume: bool = True, ledger=None, source_type: str = "oqmd", run_name: str = "offsets",
) -> dict:
    """A whole export of an offset-paged provider: pages in parallel, failing ranges halved, new keys appended, manifest.

    `schema` reads `key` out of a record. A second call appends only keys that are not there yet.
    """
    providers.register(spark)
    pages = stored(spark.read.format("offset_pages").options(**options).load())
    good, bad = providers.split_failures(pages)
    record = F.from_json("payload", schema)
    rows = good.select(F.col("page_start"), F.col("position"), record[key].cast("string").alias("key"), "payload").where("key is not null")
    first = F.row_number().over(Window.partitionBy("key").orderBy("page_start", "position"))
    rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    folder = f"{out.rstrip('/')}/records"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = jsonl.seen_keys(spark, folder, schema, F.col(f"record.{key}").cast("string")) if resume and there else spark.createDataFrame([], "key string")
    known = stored(known)
    fresh = stored(rows.join(known, "key", "left_anti"))
    skipped = rows.join(known, "key", "left_semi")
    fresh.orderBy("page_start", "position").select(F.col("payload").alias("value")).write.mode("append" if resume else "overwrite").text(folder)
    row = exports.export_manifest(fresh, skipped, bad, "completed", options=options).first().asDict()
    row["failed_offsets"] = [r["offset"] for r in bad.orderBy("offset").limit(1000).collect()]  # the manifest lists so many, all are counted
    row["run_id"] = None
    if ledger is not None and row["records_written"]:
        from oreweave.plans.pipeline import ingest_records

        row["run_id"] = ingest_records(spark, ledger, fresh.select("payload"), source_type, run_name)
        if row["failed_pages"]:
            ledger.set_status(row["run_id"], "completed_degraded")
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}/manifest")
    return row
