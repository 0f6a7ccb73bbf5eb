"""The corpus ledger: parquet tables cut by run and by hashed bucket, written copy on write.

A row lies in the bucket of its file (tables that files own) or of its id. A write collects which
buckets it touches, writes their new content to a folder of its own (`commit=...`), and then puts
down the next manifest of each run: a small file that names the live folders of every bucket. So
one changed file rewrites one bucket per table, a job that dies before its manifest leaves the old
version in place and can be repeated, and a plan that is still reading keeps its files until
`vacuum` removes versions that are no longer named. Each run has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreweave.functions.hashing import iso_seconds, sha256, stable_id
from oreweave.operators.dedupe import keep_first
from oreweave.operators.scans import numbering
from oreweave.session import stored

# Table schemas (text timestamps, JSON kept as text).
SCHEMAS = {
    "ingest_runs": "id STRING, run_id STRING, name STRING, root_path STRING, status STRING, options STRING, created_at STRING, updated_at STRING",
    "ingest_jobs": "id STRING, run_id STRING, source_file_id STRING, stage STRING, status STRING, attempts INT, payload STRING, error STRING, created_at STRING, updated_at STRING",
    "source_files": "id STRING, run_id STRING, path STRING, relative_path STRING, source_type STRING, sha256 STRING, bytes BIGINT, status STRING, metadata STRING, created_at STRING, updated_at STRING",
    "document_texts": "id STRING, run_id STRING, source_file_id STRING, title STRING, text STRING, text_quality STRING, metadata STRING, created_at STRING, updated_at STRING",
    "document_chunks": "id STRING, run_id STRING, source_file_id STRING, document_id STRING, chunk_index INT, text STRING, metadata STRING, created_at STRING",
    "structured_records": "id STRING, run_id STRING, source_file_id STRING, record_type STRING, record_index INT, payload STRING, provenance STRING, created_at STRING",
    "entities": "id STRING, run_id STRING, entity_type STRING, name STRING, normalized STRING, metadata STRING, created_at STRING",
    "relations": "id STRING, run_id STRING, source STRING, relation STRING, target STRING, evidence_text STRING, source_ref STRING, confidence DOUBLE, created_at STRING",
    "artifacts": "id STRING, run_id STRING, source_file_id STRING, kind STRING, stage STRING, status STRING, path STRING, content STRING, metadata STRING, created_at STRING",
    "llm_calls": "id STRING, run_id STRING, provider STRING, model STRING, purpose STRING, status STRING, prompt_chars INT, response_chars INT, error STRING, created_at STRING",
    "document_sections": "id STRING, run_id STRING, source_file_id STRING, section_index INT, section_type STRING, title STRING, text STRING, page_start INT, page_end INT, provenance STRING, metadata STRING, created_at STRING, updated_at STRING",
    "document_assets": "id STRING, run_id STRING, source_file_id STRING, asset_index INT, asset_type STRING, label STRING, caption STRING, content STRING, path STRING, page INT, provenance STRING, metadata STRING, created_at STRING, updated_at STRING",
    "kg_entities": "id STRING, run_id STRING, entity_type STRING, name STRING, normalized STRING, canonical_id STRING, description STRING, confidence DOUBLE, source_count BIGINT, first_source_file_id STRING, metadata STRING, created_at STRING, updated_at STRING",
    "kg_entity_aliases": "id STRING, run_id STRING, entity_id STRING, alias STRING, normalized_alias STRING, created_at STRING",
    "kg_relations": "id STRING, run_id STRING, subject_entity_id STRING, predicate STRING, object_entity_id STRING, object_value STRING, evidence_text STRING, evidence_chunk_id STRING, source_file_id STRING, confidence DOUBLE, extractor STRING, created_at STRING",
    "kg_embeddings": "id STRING, run_id STRING, target_type STRING, target_id STRING, model STRING, dimensions INT, embedding ARRAY<DOUBLE>, payload STRING, created_at STRING",
    "kg_sync_status": "id STRING, run_id STRING, target STRING, status STRING, counts STRING, error STRING, updated_at STRING",
}
RUN_TABLES = [
    "source_files", "document_texts", "document_chunks", "structured_records", "artifacts", "llm_calls", "entities",
    "relations", "document_sections", "document_assets", "kg_entities", "kg_relations", "kg_embeddings",
]
SUMMARY_NAMES = {
    "source_files": "source_files", "document_texts": "documents", "document_chunks": "chunks",
    "structured_records": "structured_records", "entities": "entities", "relations": "relations",
    "document_sections": "document_sections", "document_assets": "document_assets", "kg_entities": "kg_entities",
    "kg_relations": "kg_relations", "kg_embeddings": "kg_embeddings",
}


#: Tables whose rows belong to a file: their bucket is that of the file, the others' that of the id.
FILE_TABLES = {"document_texts", "document_chunks", "structured_records", "document_sections", "document_assets", "artifacts", "ingest_jobs"}
BUCKET_ROWS = 50_000  # rows a bucket is meant to have
OVERFULL = 4  # times that many rows on average: the next write deals the run anew


class Ledger:
    """Tables below one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows

    # storage -------------------------------------------------------------------------------

    def path(self, table: str) -> str:
        if table not in SCHEMAS:
            raise KeyError(f"unknown ledger table: {table}")
        return f"{self.root}/{table}"

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _names(self, path: str) -> list[str]:
        fs, hadoop = self._files(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._files(path)
        return fs.exists(hadoop)

    def _drop(self, path: str) -> None:
        fs, hadoop = self._files(path)
        fs.delete(hadoop, True)

    def _folder(self, table: str, commit: str, run_id: str, bucket: int) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
        return f"{self.path(table)}/commit={commit}/run_id={escaped}/bucket={bucket}"

    # manifests -----------------------------------------------------------------------------

    def _manifests(self, table: str, run_id: str) -> str:
        return f"{self.path(table)}/_manifests/{quote(run_id, safe='')}"

    def versions(self, table: str, run_id: str) -> list[str]:
        return [n for n in self._names(self._manifests(table, run_id)) if n.endswith(".json")]

    def run_ids(self, table: str) -> list[str]:
        return [unquote(n) for n in self._names(f"{self.path(table)}/_manifests")]

    def manifest(self, table: str, run_id: str, version: str | None = None) -> dict:
        """version, buckets (their number), rows (at most so many) and live: the commits of each bucket."""
        names = [version] if version else self.versions(table, run_id)
        if not names:
            return {"version": 0, "buckets": 0, "rows": 0, "live": {}}
        fs, hadoop = self._files(f"{self._manifests(table, run_id)}/{names[-1]}")
        stream = fs.open(hadoop)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        found = json.loads(text)
        found["live"] = {int(b): commits for b, commits in found["live"].items()}
        return found

    def _publish(self, table: str, run_id: str, manifest: dict) -> None:
        """The next manifest of a run appears whole: written aside, then renamed."""
        folder = self._manifests(table, run_id)
        version = manifest["version"] + 1
        fs, aside = self._files(f"{folder}/.{uuid.uuid4().hex}")
        target = self._files(f"{folder}/{version:010d}.json")[1]
        stream = fs.create(aside)
        stream.write(json.dumps({**manifest, "version": version}).encode())
        stream.close()
        if fs.exists(target) or not fs.rename(aside, target):
            raise RuntimeError(f"{table}: run {run_id} was written by another job meanwhile")

    def _live(self, table: str, only: dict[str, set[int] | None]) -> DataFrame:
        """Rows of the given buckets (None: all) of runs."""
        paths = [
            self._folder(table, commit, run_id, bucket)
            for run_id, buckets in only.items()
            for bucket, commits in sorted(self.manifest(table, run_id)["live"].items())
            if buckets is None or bucket in buckets
            for commit in commits
        ]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        reader = self.spark.read.schema(SCHEMAS[table]).option("basePath", self.path(table))
        return reader.parquet(*paths).select(*[f.name for f in self._columns(table)])

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """The live rows of a table, or of one run of it."""
        self.path(table)
        return self._live(table, {r: None for r in ([run_id] if run_id is not None else self.run_ids(table))})

    def vacuum(self, keep: int = 2) -> int:
        """Remove what none of the last `keep` manifests of a run names; returns the number of folders removed."""
        gone = 0
        for table in SCHEMAS:
            named = set()
            for run_id in self.run_ids(table):
                versions = self.versions(table, run_id)
                for version in versions[:-keep]:
                    self._drop(f"{self._manifests(table, run_id)}/{version}")
                for version in versions[-keep:]:
                    live = self.manifest(table, run_id, version)["live"]
                    named |= {self._folder(table, c, run_id, b) for b, commits in live.items() for c in commits}
            for commit in self._names(self.path(table)):
                runs = self._names(f"{self.path(table)}/{commit}") if commit.startswith("commit=") else []
                folders = [f"{self.path(table)}/{commit}/{r}/{b}" for r in runs for b in self._names(f"{self.path(table)}/{commit}/{r}")]
                old = [f for f in folders if "/bucket=" in f and f not in named]
                for folder in old:
                    self._drop(folder)
                gone += len(old)
                if runs and not any(f in named for f in folders):
                    self._drop(f"{self.path(table)}/{commit}")
        return gone

    # shaping and dealing -------------------------------------------------------------------

    def _columns(self, table: str):
        return self.spark.createDataFrame([], SCHEMAS[table]).schema.fields

    def _shape(self, table: str, df: DataFrame) -> DataFrame:
        """Ledger columns in order; missing ones are null, timestamps default to now."""
        now = iso_seconds()
        columns = []
        for f in self._columns(table):
            if f.name in df.columns:
                columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
            elif f.name in ("created_at", "updated_at"):
                columns.append(now.alias(f.name))
            else:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        return df.select(*columns)

    @staticmethod
    def bucket_key(table: str) -> str:
        return "source_file_id" if table in FILE_TABLES else "id"

    def _plan(self, table: str, rows: dict[str, int], anew: bool = False, deal: bool = True) -> dict[str, dict]:
        """Manifests that a write of so many rows per run goes on from; `anew`, and overfull runs
        where the write may `deal` their rows again, get new buckets."""
        out = {}
        for run_id, count in rows.items():
            old = self.manifest(table, run_id)
            full = deal and not anew and old["rows"] > OVERFULL * self.bucket_rows * old["buckets"]
            before = 0 if anew else self._live(table, {run_id: None}).count() if full else old["rows"]  # updates were added up as new rows
            total = before + count
            fresh = anew or not old["live"] or full
            buckets = max(1, -(-total // self.bucket_rows)) if fresh else old["buckets"]
            out[run_id] = {**old, "buckets": buckets, "rows": total, "fresh": fresh}
        return out

    def _bucket(self, table: str, plan: dict[str, dict], key: str | None = None) -> Column:
        code = F.xxhash64(F.coalesce(F.col(key or self.bucket_key(table)), F.lit("")))
        counts = {p["buckets"] for p in plan.values()}
        if counts <= {1}:
            return F.lit(0)
        if len(counts) == 1:
            return F.pmod(code, F.lit(counts.pop())).cast("int")
        buckets = F.create_map(*[F.lit(v) for run_id, p in plan.items() for v in (run_id, p["buckets"])])
        return F.pmod(code, F.element_at(buckets, F.col("run_id"))).cast("int")

    def _touched(self, table: str, plan: dict[str, dict], rows: DataFrame) -> dict[str, set[int] | None]:
        """Buckets that rows (with run_id and the bucket key) fall in; None where the whole run is dealt anew."""
        out: dict[str, set[int] | None] = {r: None if p["fresh"] else ({0} if p["buckets"] == 1 else set()) for r, p in plan.items()}
        if any(found == set() for found in out.values()):
            for r in rows.select("run_id", self._bucket(table, plan).alias("bucket")).distinct().collect():
                if out[r["run_id"]] is not None:
                    out[r["run_id"]].add(r["bucket"])
        return out

    def _commit(self, table: str, content: DataFrame, plan: dict[str, dict], touched: dict[str, set[int] | None], add: bool = False) -> None:
        """Write the new content of the touched buckets, then let the manifests name it."""
        commit = uuid.uuid4().hex
        dealt = content.withColumn("bucket", self._bucket(table, plan)).hint("rebalance", "run_id", "bucket")
        dealt.write.partitionBy("run_id", "bucket").parquet(f"{self.path(table)}/commit={commit}")
        for run_id, p in plan.items():
            buckets = touched[run_id]
            live = {} if buckets is None else dict(p["live"])
            for bucket in range(p["buckets"]) if buckets is None else sorted(buckets):
                before = live.pop(bucket, [])
                before = before if add else []
                now = [commit] if self._exists(self._folder(table, commit, run_id, bucket)) else []
                if before or now:
                    live[bucket] = [*before, *now]
            rows = p["rows"] if live else 0
            self._publish(table, run_id, {"version": p["version"], "buckets": p["buckets"], "rows": rows, "live": live})

    def _counted(self, rows: DataFrame) -> dict[str, int]:
        return {r["run_id"]: r["n"] for r in rows.groupBy("run_id").agg(F.count("*").alias("n")).collect()}

    # writes --------------------------------------------------------------------------------

    def append(self, table: str, df: DataFrame) -> None:
        """Log rows: artifacts, provider calls. Nothing is read; the buckets get one more folder each."""
        fresh = stored(self._shape(table, df))
        plan = self._plan(table, self._counted(fresh), deal=False)
        self._commit(table, fresh, plan, self._touched(table, plan, fresh), add=True)

    def upsert(self, table: str, df: DataFrame, keys: Sequence[str] = ("id",)) -> None:
        """Insert or update by key: the new row wins, ``created_at`` of the old row stays.

        In tables that files own a key must not change its file: only the buckets of the new
        rows are looked at."""
        fresh = stored(self._shape(table, df))  # the input is computed once
        plan = self._plan(table, self._counted(fresh))
        touched = self._touched(table, plan, fresh)
        both = self._live(table, touched).withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        if "created_at" in both.columns:
            first = F.min("created_at").over(Window.partitionBy(*keys))
            both = both.withColumn("created_at", first)
        order = [F.desc("_new")] + ([F.desc("updated_at")] if "updated_at" in both.columns else [])
        self._commit(table, keep_first(both, list(keys), order).drop("_new"), plan, touched)

    def replace(self, table: str, df: DataFrame, scope: DataFrame, keys: Sequence[str] = ("run_id", "source_file_id")) -> None:
        """Replace all rows of the scope keys with ``df``; a scope key without rows is cleared.

        Keys that hold the bucket key touch its buckets only, others (such as run and type) the runs' all."""
        fresh = stored(self._shape(table, df))
        wanted = stored(scope.select(*keys).distinct())
        rows = {**{r["run_id"]: 0 for r in wanted.select("run_id").distinct().collect()}, **self._counted(fresh)}
        plan = self._plan(table, rows)
        own = self.bucket_key(table)
        if own in keys:
            touched = self._touched(table, plan, wanted.select("run_id", own).unionByName(fresh.select("run_id", own)))
        else:
            touched = dict.fromkeys(plan)
        kept = self._live(table, touched).join(wanted, list(keys), "left_anti")
        self._commit(table, kept.unionByName(fresh), plan, touched)

    def replace_run(self, table: str, df: DataFrame, run_id: str) -> None:
        """Replace one run of a derived table."""
        fresh = stored(self._shape(table, df).where(F.col("run_id") == run_id))
        plan = self._plan(table, {run_id: fresh.count()}, anew=True)
        self._commit(table, fresh, plan, {run_id: None})

    # runs ----------------------------------------------------------------------------------

    def create_run(self, name: str, root_path: str, options: str = "{}") -> str:
        row = self.spark.range(1).select(
            stable_id(F.lit(name), F.lit(root_path), F.lit(uuid.uuid4().hex)).alias("id"),
            F.lit(name).alias("name"),
            F.lit(root_path).alias("root_path"),
            F.lit("pending").alias("status"),
            F.lit(options).alias("options"),
        )
        run_id = row.first()["id"]
        self.upsert("ingest_runs", row.withColumn("id", F.lit(run_id)).withColumn("run_id", F.lit(run_id)))
        return run_id

    def latest_run_id(self) -> str:
        """Most recent run; the id breaks ties of the second-resolution timestamp."""
        row = self.read("ingest_runs").orderBy(F.desc("created_at"), F.desc("id")).limit(1).collect()
        if not row:
            raise RuntimeError("No corpus ingest runs found")
        return row[0]["id"]

    def resolve_run(self, run_id: str = "latest") -> str:
        return self.latest_run_id() if run_id == "latest" else run_id

    def set_status(self, run_id: str, status: str) -> None:
        self.upsert("ingest_runs", self.read("ingest_runs", run_id).withColumn("status", F.lit(status)).drop("updated_at"))

    def set_sync_status(self, run_id: str, target: str, status: str, counts: str = "{}", error: str | None = None) -> None:
        row = self.spark.range(1).select(
            stable_id(F.lit(run_id), F.lit(target)).alias("id"), F.lit(run_id).alias("run_id"), F.lit(target).alias("target"),
            F.lit(status).alias("status"), F.lit(counts).alias("counts"), F.lit(error).cast("string").alias("error"),
        )
        self.upsert("kg_sync_status", row)

    def run_status(self, run_id: str) -> dict:
        """Counts of every table, job matrix and sync states of a run."""
        run = self.read("ingest_runs", run_id).collect()
        if not run:
            raise RuntimeError(f"Run not found: {run_id}")
        counts = {r["table"]: r["rows"] for r in table_counts(self, run_id).collect()}
        jobs = job_matrix(self.read("ingest_jobs", run_id)).orderBy("stage", "status").collect()
        sync = self.read("kg_sync_status", run_id).orderBy("target").collect()
        return {
            "run": run[0].asDict(),
            **{name: counts.get(name, 0) for name in RUN_TABLES},
            "jobs": [r.asDict() for r in jobs],
            "kg_sync_status": [r.asDict() for r in sync],
        }


# Row builders ------------------------------------------------------------------------------


def source_file_rows(files: DataFrame, run_id: str) -> DataFrame:
    """Ledger rows of scanned files (``path, relative_path, source_type, content, length, modified``)."""
    return files.select(
        stable_id(F.lit(run_id), F.col("relative_path")).alias("id"),
        F.lit(run_id).alias("run_id"),
        "path",
        "relative_path",
        "source_type",
        sha256(F.col("content")).alias("sha256"),
        F.col("length").alias("bytes"),
        F.lit("queued").alias("status"),
        F.to_json(F.struct(F.unix_micros("modified").alias("modified"))).alias("metadata"),
    )


def external_source_rows(records: DataFrame, run_id: str, source_type: str) -> DataFrame:
    """Ledger rows of provider records (``source_key, title, payload``)."""
    kind = F.lit(source_type)
    payload = F.encode("payload", "UTF-8")
    return records.select(
        stable_id(F.lit(run_id), kind, F.col("source_key")).alias("id"),
        F.lit(run_id).alias("run_id"),
        F.concat(kind, F.lit("://"), "source_key").alias("path"),
        F.concat(kind, F.lit("/"), "source_key").alias("relative_path"),
        kind.alias("source_type"),
        sha256(payload).alias("sha256"),
        F.octet_length(payload).cast("bigint").alias("bytes"),
        F.lit("extracted").alias("status"),
        F.to_json(F.struct("title", "source_key", F.lit(True).alias("external"))).alias("metadata"),
    )


def record_rows(records: DataFrame, existing: DataFrame | None = None, block: Column | None = None) -> DataFrame:
    """Structured records numbered per file after the rows already there.

    records: run_id, source_file_id, record_type, payload, position (order inside the file).
    ``block`` cuts a file with very many records into pieces that grow with the order, so its
    numbering is spread over tasks; by default a record type is one piece.
    """
    keys = ["run_id", "source_file_id"]
    pieces = F.struct("record_type", (F.lit(0) if block is None else block).alias("piece"))
    numbered = numbering(records, keys, ["record_type", "position"], pieces, "_n")
    if existing is not None:
        offsets = existing.groupBy(*keys).agg(F.count("*").alias("_offset"))
        numbered = numbered.join(offsets, keys, "left").withColumn("_n", F.col("_n") + F.coalesce("_offset", F.lit(0)))
    return numbered.select(
        stable_id(
            F.col("run_id"), F.col("source_file_id"), F.col("record_type"), F.col("_n"), F.col("payload")
        ).alias("id"),
        *keys,
        "record_type",
        F.col("_n").cast("int").alias("record_index"),
        "payload",
        F.to_json(F.struct("source_file_id")).alias("provenance"),
    )


# Reports -----------------------------------------------------------------------------------


def counts_by_run(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, table, rows) of many tables: one union, one aggregation, no join chain."""
    parts = [df.select("run_id", F.lit(name).alias("table")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("run_id", "table").agg(F.count("*").alias("rows"))


def table_counts(ledger: Ledger, run_id: str | None = None) -> DataFrame:
    return counts_by_run({name: ledger.read(name, run_id) for name in RUN_TABLES})


def run_summary(runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Runs with one count column per table; missing counts are 0."""
    counts = counts_by_run(tables).groupBy("run_id").agg(
        *[F.sum(F.when(F.col("table") == name, F.col("rows"))).alias(name) for name in tables]
    )
    return runs.join(counts, "run_id", "left").select(
        *runs.columns, *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in tables]
    )


def document_overview(files: DataFrame, texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with their text length and chunk count; chunks are counted before the join."""
    counted = chunks.groupBy("run_id", "source_file_id").agg(F.count("*").alias("chunk_count"))
    lengths = texts.select("source_file_id", "title", F.length("text").cast("bigint").alias("text_chars"))
    return (
        files.join(lengths, "source_file_id", "left")
        .join(counted, ["run_id", "source_file_id"], "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint")))
    )


def quality_issues(files: DataFrame, texts: DataFrame, by_substring: bool = False) -> DataFrame:
    """Documents that need OCR or are shorter than 200 characters.

    The flag is read from the quality JSON; ``by_substring`` keeps the older loose test.
    """
    flagged = F.coalesce(F.from_json("text_quality", "ocr_required BOOLEAN")["ocr_required"], F.lit(False))
    loose = F.contains("text_quality", F.lit("ocr_required")) & F.contains("text_quality", F.lit("true"))
    issue = loose if by_substring else flagged
    return (
        files.join(texts, "source_file_id")
        .withColumn("ocr_required", issue)
        .where(F.col("ocr_required") | (F.length("text") < 200))
    )


def job_matrix(jobs: DataFrame, keys: Sequence[Column | str] = ("stage", "status")) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.count("*").alias("count"))


def latest_status(statuses: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    return keep_first(statuses, list(keys), list(newest))


def final_status(jobs: DataFrame, artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Run status after all jobs: degraded when a job failed or an artifact was skipped or failed."""
    bad = (
        jobs.select("run_id", (F.col("status") == "failed").cast("int").alias("bad"))
        .unionByName(artifacts.select("run_id", F.col("status").isin("skipped", "failed").cast("int").alias("bad")))
        .groupBy("run_id")
        .agg(F.sum("bad").alias("bad"))
    )
    status = F.when(F.coalesce("bad", F.lit(0)) > 0, "completed_degraded").otherwise("completed")
    return runs.join(bad, "run_id", "left").select("run_id", status.alias("status"))


def runs_with_chunks(runs: DataFrame, texts: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Runs that have chunks, with their document, chunk and embedding counts."""
    summary = run_summary(runs, {"documents": texts, "chunks": chunks, "kg_embeddings": embeddings})
    return summary.where(F.col("chunks") > 0)


def list_runs(runs: DataFrame, chunks: DataFrame, embeddings: DataFrame, sync: DataFrame) -> DataFrame:
    """Run list of the research API: counts and whether the vector index is ready."""
    latest = latest_status(
        sync.where(F.col("target") == "vectors").select("run_id", F.col("status").alias("sync_status"), "updated_at", "id"),
        ["run_id"], [F.desc("updated_at"), F.desc("id")],
    )
    counted = run_summary(runs, {"chunks": chunks, "embeddings": embeddings}).where(F.col("chunks") > 0)
    return (
        counted.join(latest.select("run_id", "sync_status"), "run_id", "left")
        .select("run_id", "name", "chunks", "embeddings", (F.coalesce("sync_status", F.lit("")) == "completed").alias("vectors_ready"))
        .orderBy(F.desc("chunks"), "run_id")
    )
