"""End-to-end jobs over the ledger: ingest, graph build, search, hypothesis run.

Each stage reads ledger tables, writes ledger tables and keeps nothing in memory, so a lost
executor repeats tasks and a lost driver repeats the stage.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import records as Rec
from oreweave.functions import text as T
from oreweave.functions.hashing import stable_id
from oreweave.operators import entities as E
from oreweave.operators import hypotheses as H
from oreweave.operators import ranking
from oreweave.operators import relations as R
from oreweave.operators.chunking import chunk_documents
from oreweave.operators.dedupe import keep_first
from oreweave.operators.embeddings import build_embeddings, embedding_targets
from oreweave.operators.graph import ledger_graph, relation_names, tailings_graph
from oreweave.operators.layout import assets_from_records, enriched_text, fallback_sections, formula_records, merge_assets, table_records
from oreweave.operators.retrieval import GraphVectorRetriever, HybridRetriever, graph_hits, lexical_search, top_k
from oreweave.operators.research import TextProvider, noisy_json
from oreweave.sinks import exports
from oreweave.sinks.ledger import Ledger, external_source_rows, final_status, record_rows, source_file_rows
from oreweave.session import stored as stored_table
from oreweave.sources import files as Src
from oreweave.sources import ocr as Ocr
from oreweave.sources import tei as Tei
from oreweave.sources.jsonl import knowledge_base
from oreweave.streaming.incremental import drain

STAGES = ["sections", "assets", "entities", "relations", "embeddings", "sync"]


# Ingest ------------------------------------------------------------------------------------


def _tag(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))


def _workbook_records(ledger: Ledger, files: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structured records of the workbooks, the sentence text of each, and what could not be read."""
    rows = stored_table(Src.workbook_rows(files))
    errors = rows.where(F.col("error").isNotNull()).select("path", F.col("error").alias("workbook_error"))
    rows = rows.where(F.col("error").isNull()).drop("error")
    kinds = zip(("summaries", "size_classes", "extractability"), ("summary", "size_class", "extractable"), Src.tailings_workbooks(rows))
    ids = files.select(F.col("path").alias("filename"), stable_id(F.lit(run_id), F.col("relative_path")).alias("source_file_id"))
    parts = []
    for i, (record_type, sentence, table) in enumerate(kinds):
        payload = F.to_json(F.struct(*table.columns))
        parts.append(
            table.join(ids, "filename").select(
                F.lit(run_id).alias("run_id"), "source_file_id", F.lit(record_type).alias("record_type"), payload.alias("payload"),
                F.struct(F.lit(i).alias("kind"), "sheet_name", "row_number").alias("position"),
                Rec.tailings_sentence(sentence).alias("sentence"),
            )
        )
    records = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # the text of one workbook: bounded by the file it was read from
    texts = records.groupBy("source_file_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "sentence"))), lambda r: r["sentence"]), "\n"
        ).alias("workbook_text")
    )
    return records.drop("sentence"), texts, errors


def _layout_records(docs: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Formula and table records of layout texts, and the lists the enriched text needs."""
    keys = ["run_id", "source_file_id"]
    formulas = formula_records(docs, keys)
    tables = table_records(docs, keys)
    columns = {"formulas": ["page", "line", "kind", "text", "normalized", "confidence"],
               "tables": ["page", "start_line", "end_line", "row_count", "column_count", "rows", "raw_lines", "confidence"]}

    def rows(df: DataFrame, kind: str, line: str) -> DataFrame:
        return df.select(
            *keys, F.lit(f"{prefix}_{kind}").alias("record_type"), F.to_json(F.struct(*columns[kind])).alias("payload"),
            F.struct(F.lit(0).alias("kind"), F.col("page").cast("string").alias("sheet_name"), F.col(line).cast("int").alias("row_number")).alias("position"),
        )

    records = rows(formulas, "formulas", "line").unionByName(rows(tables, "tables", "start_line"))
    listed_formulas = formulas.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "line", "kind", "text"))).alias("formulas"))
    listed_tables = tables.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("page", "start_line", "row_count", "column_count", "rows"))).alias("tables")
    )
    return records, listed_formulas.join(listed_tables, keys, "full_outer")


def _chunk_metadata() -> Column:
    """The metadata of the document with the place of the chunk in it."""
    own = F.from_json("metadata", "map<string,string>")
    place = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    kept = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: k != "chunk_index")
    return F.to_json(F.map_concat(kept, place))


def chunk_run(ledger: Ledger, run_id: str, files: DataFrame | None = None) -> None:
    """Chunk the stored texts of a run, or of the given source files."""
    texts = ledger.read("document_texts", run_id)
    if files is not None:
        texts = texts.join(files.select("source_file_id"), "source_file_id", "left_semi")
    pieces = chunk_documents(texts, ["run_id", "source_file_id", "metadata"])
    rows = pieces.select(
        F.concat_ws(":chunk:", "source_file_id", F.col("chunk_index").cast("string")).alias("id"),
        "run_id", "source_file_id", F.col("source_file_id").alias("document_id"), "chunk_index",
        F.col("chunk_text").alias("text"), _chunk_metadata().alias("metadata"),
    )
    ledger.replace("document_chunks", rows, texts.select("run_id", "source_file_id"))


def promote_run(ledger: Ledger, run_id: str) -> str:
    """Domain entities and relations of a run and its final status."""
    kb = knowledge_base(ledger, run_id)
    found = E.domain_entities(kb["chunks"].select("document_id", "source_file_id", "chunk_index", "text"), ["source_file_id", "chunk_index"])
    entities = found.select(
        stable_id(F.lit(run_id), F.col("entity_type"), F.col("normalized")).alias("id"), F.lit(run_id).alias("run_id"), "entity_type",
        "name", "normalized", F.to_json(F.struct("first_document_id")).alias("metadata"),
    )
    ledger.replace_run("entities", entities, run_id)
    relations = R.loss_relations(kb["size_classes"]).unionByName(R.recovery_relations(kb["extractability"]))
    ledger.replace_run("relations", relations.select(
        stable_id(F.lit(run_id), F.col("source"), F.col("relation"), F.col("target"), F.col("evidence_text")).alias("id"),
        F.lit(run_id).alias("run_id"), "source", "relation", "target", "evidence_text", "confidence",
    ), run_id)
    runs = ledger.read("ingest_runs", run_id)
    status = final_status(ledger.read("ingest_jobs", run_id), ledger.read("artifacts", run_id), runs).first()["status"]
    ledger.set_status(run_id, status)
    return status


def ingest_folder(
    spark: SparkSession, ledger: Ledger, root: str, name: str | None = None, ocr: str = "auto", engines: Sequence[Ocr.Engine] = (Ocr.tesseract,)
) -> str:
    """Scan a folder, parse and store its files, chunk them; returns the run id."""
    run_id = ledger.create_run(name or root.rstrip("/").rsplit("/", 1)[-1], root, json.dumps({"ocr": ocr}))
    ledger.set_status(run_id, "running")
    ingest_files(ledger, run_id, Src.scan_folder(spark, root), ocr, engines)
    promote_run(ledger, run_id)
    return run_id


def ingest_files(ledger: Ledger, run_id: str, files: DataFrame, ocr: str = "auto", engines: Sequence[Ocr.Engine] = (Ocr.tesseract,)) -> None:
    """Parse, store and chunk scanned files of a run; what the ledger holds of these files is replaced.

    A file is `queued` until all its tables are written, so a job that dies takes it again.
    """
    file_id = stable_id(F.lit(run_id), F.col("relative_path")).alias("source_file_id")
    sources = stored_table(source_file_rows(files, run_id))
    ledger.upsert("source_files", sources)

    records, workbook_texts, workbook_errors = _workbook_records(ledger, files, run_id)
    # parsed once; every ledger write below reads the stored rows
    parsed = stored_table(Src.parse_files(files)).join(files.select("path", "relative_path", "source_type", file_id), "path")
    parsed = parsed.join(workbook_errors, "path", "left")
    parsed = parsed.withColumn("parse_error", F.coalesce("parse_error", "workbook_error")).drop("workbook_error")
    base = _tag(parsed, run_id).join(workbook_texts, "source_file_id", "left").withColumn(
        "text", F.coalesce("workbook_text", "parsed_text")
    )
    pdf_records, lists = _layout_records(base.where(F.col("source_type") == "pdf").select("run_id", "source_file_id", "text"), "pdf")
    listed = base.join(lists, ["run_id", "source_file_id"], "left")
    is_pdf = F.col("source_type") == "pdf"
    empty_f = F.array().cast("array<struct<page:int,line:int,kind:string,text:string>>")
    empty_t = F.array().cast("array<struct<page:int,start_line:int,row_count:int,column_count:int,rows:array<array<string>>>>")
    enriched = enriched_text(F.col("text"), F.coalesce("formulas", empty_f), F.coalesce("tables", empty_t))
    ocr_required = F.coalesce(F.from_json("metadata", "ocr_required BOOLEAN")["ocr_required"], F.lit(False))
    texts = listed.select(
        F.col("source_file_id").alias("id"), "run_id", "source_file_id",
        F.element_at(F.split("path", "/"), -1).alias("title"),
        F.when(is_pdf, enriched).otherwise(F.col("text")).alias("text"),
        F.to_json(F.struct(F.length("text").alias("text_chars"), ocr_required.alias("ocr_required"), F.col("source_type").alias("extractor"))).alias("text_quality"),
        "metadata",
    )
    ledger.upsert("document_texts", texts)
    all_records = records.unionByName(pdf_records)
    ledger.replace("structured_records", record_rows(all_records), _tag(parsed.select("source_file_id"), run_id))

    # one job row per file and stage; a parser error marks its extract job failed
    failed = F.col("parse_error").isNotNull()
    jobs = _tag(parsed, run_id).select(
        stable_id(F.lit(run_id), F.lit("extract"), F.col("source_file_id")).alias("id"), "run_id", "source_file_id",
        F.lit("extract").alias("stage"), F.when(failed, "failed").otherwise("completed").alias("status"),
        F.lit("{}").alias("payload"), F.col("parse_error").alias("error"),
    )
    chunk_jobs = jobs.withColumn("stage", F.lit("chunk_index")).withColumn("status", F.lit("completed")).withColumn(
        "id", stable_id(F.lit(run_id), F.lit("chunk_index"), F.col("source_file_id"))
    ).withColumn("error", F.lit(None).cast("string"))
    tried = ledger.read("ingest_jobs", run_id).select("id", F.col("attempts").alias("tried"))
    jobs = jobs.unionByName(chunk_jobs).join(tried, "id", "left")
    ledger.upsert("ingest_jobs", jobs.withColumn("attempts", F.coalesce("tried", F.lit(0)) + 1).drop("tried"))
    own = sources.select(F.col("id").alias("source_file_id"))
    chunk_run(ledger, run_id, own)
    if ocr != "off":
        need_ocr = F.coalesce(F.from_json("text_quality", "ocr_required BOOLEAN")["ocr_required"], F.lit(False))
        required = ledger.read("document_texts", run_id).where(need_ocr).join(own, "source_file_id", "left_semi")
        images = files.where(F.col("source_type").isin("pdf", "image")).select("path", "content", file_id)
        wanted = images if ocr == "always" else images.join(required.select("source_file_id"), "source_file_id", "left_semi")
        results = stored_table(Ocr.recognise(wanted, engines))
        ledger.append("artifacts", _tag(results, run_id).select(
            stable_id(F.lit(run_id), F.lit("ocr"), F.col("source_file_id")).alias("id"), "run_id", "source_file_id", F.lit("ocr").alias("kind"),
            F.lit("ocr").alias("stage"), "status", F.col("text").alias("content"), "metadata",
        ))
        if results.where(F.col("status") == "completed").limit(1).count():
            apply_ocr(ledger, run_id, results)
    ledger.upsert("source_files", sources.withColumn("status", F.lit("extracted")).drop("updated_at"))


# Incremental ingest ------------------------------------------------------------------------


def folder_changes(listing: DataFrame, known: DataFrame, jobs: DataFrame, max_attempts: int = 1) -> DataFrame:
    """What a folder's listing (``path, relative_path, length, modified``) says against the ledger.

    change: ``new``, ``changed`` (size or time differ), ``unfinished`` (an earlier job died, or the
    file came back), ``retry`` (its parser failed fewer than ``max_attempts`` times), ``gone`` or
    ``same``. Files' contents are not looked at.
    """
    state = known.select(
        "relative_path", F.col("id").alias("source_file_id"), F.col("bytes").alias("_bytes"), F.col("status").alias("_status"),
        F.from_json("metadata", "modified BIGINT")["modified"].alias("_modified"),
    )
    failed = jobs.where((F.col("stage") == "extract") & (F.col("status") == "failed") & (F.col("attempts") < max_attempts))
    state = state.join(failed.select("source_file_id", F.lit(True).alias("_failed")), "source_file_id", "left")
    both = listing.join(state, "relative_path", "full_outer")
    here = F.col("path").isNotNull()
    return both.select(
        "relative_path", "path", "modified", "source_file_id",
        F.when(~here & (F.col("_status") == "missing"), "same").when(~here, "gone").when(F.col("source_file_id").isNull(), "new")
        .when(F.col("_status") != "extracted", "unfinished")
        .when((F.col("length") != F.col("_bytes")) | ~F.unix_micros("modified").eqNullSafe(F.col("_modified")), "changed")
        .when(F.coalesce("_failed", F.lit(False)), "retry").otherwise("same").alias("change"),
    )


def refresh_folder(
    spark: SparkSession, ledger: Ledger, root: str, run_id: str, ocr: str = "auto",
    engines: Sequence[Ocr.Engine] = (Ocr.tesseract,), max_attempts: int = 1,
) -> dict[str, int]:
    """Bring a run up to date with its folder: only new and changed files are parsed; returns counts by kind.

    The listing is compared with the ledger by size and time without opening a file. Of what
    differs the contents are hashed; a file whose bytes are the ones the ledger knows is only
    ``touched``. Rows of files that went are removed, their source row stays as ``missing``.
    """
    changes = stored_table(folder_changes(
        Src.scan_folder(spark, root).drop("content"), ledger.read("source_files", run_id), ledger.read("ingest_jobs", run_id), max_attempts
    ))
    found = changes.groupBy("change").agg(F.count("*").alias("n"), F.min("modified").alias("since")).collect()
    counts = {kind: 0 for kind in ("new", "changed", "unfinished", "retry", "gone", "same", "touched")} | {r["change"]: r["n"] for r in found}
    since = min((r["since"] for r in found if r["change"] not in ("gone", "same")), default=None)
    if since is not None:
        wanted = changes.where(~F.col("change").isin("gone", "same")).select("relative_path", "change")
        # the time filter reaches the file format: older files are not opened
        recent = Src.scan_folder(spark, root).where(F.col("modified") >= F.lit(since))
        hashed = stored_table(source_file_rows(recent.join(wanted, "relative_path", "left_semi"), run_id))
        old = ledger.read("source_files", run_id).select("relative_path", F.col("sha256").alias("_sha"))
        equal = hashed.join(wanted.where(F.col("change") == "changed"), "relative_path", "left_semi").join(old, "relative_path")
        equal = stored_table(equal.where(F.col("sha256") == F.col("_sha")).drop("_sha"))
        counts["touched"] = equal.count()
        counts["changed"] -= counts["touched"]
        if counts["touched"]:
            ledger.upsert("source_files", equal.withColumn("status", F.lit("extracted")))
        if hashed.count() > counts["touched"]:
            differ = hashed.join(equal, "relative_path", "left_anti").select("relative_path")
            ingest_files(ledger, run_id, recent.join(differ, "relative_path", "left_semi"), ocr, engines)
    if counts["gone"]:
        gone = _tag(changes.where(F.col("change") == "gone").select("source_file_id"), run_id)
        for table in ("document_texts", "document_chunks", "structured_records", "document_sections", "document_assets"):
            ledger.replace(table, ledger.read(table, run_id).limit(0), gone)
        lost = ledger.read("source_files", run_id).join(gone.select(F.col("source_file_id").alias("id")), "id", "left_semi")
        ledger.upsert("source_files", lost.withColumn("status", F.lit("missing")).drop("updated_at"))
    if any(counts[kind] for kind in ("new", "changed", "unfinished", "retry", "gone")):
        promote_run(ledger, run_id)
    return counts


def drain_folder(spark: SparkSession, ledger: Ledger, root: str, run_id: str, **options) -> list[dict[str, int]]:
    """Passes of `refresh_folder` until one finds nothing to do: files that arrive meanwhile are taken too."""
    passes = []
    while not passes or any(n for kind, n in passes[-1].items() if kind not in ("same", "touched")):
        passes.append(refresh_folder(spark, ledger, root, run_id, **options))
    return passes


def stream_folder(
    spark: SparkSession, ledger: Ledger, root: str, run_id: str, checkpoint: str, ocr: str = "auto",
    engines: Sequence[Ocr.Engine] = (Ocr.tesseract,), max_files: int | None = None,
) -> None:
    """The folder as a stream of new paths, drained in micro-batches; a restart goes on where it ended.

    Batches that a lost driver repeats parse nothing twice: files that the ledger holds with the
    same bytes are passed over. A stream sees each path once; changed files are for `refresh_folder`.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        files = Src.scanned(batch, root)
        hashed = stored_table(source_file_rows(files, run_id).select("relative_path", "sha256"))
        held = ledger.read("source_files", run_id).where(F.col("status") == "extracted")
        fresh = stored_table(hashed.join(held, ["relative_path", "sha256"], "left_anti"))
        if fresh.limit(1).count():
            ingest_files(ledger, run_id, files.join(fresh, "relative_path", "left_semi"), ocr, engines)

    drain(reader.load(root), write, checkpoint)
    promote_run(ledger, run_id)


def apply_ocr(ledger: Ledger, run_id: str, results: DataFrame) -> None:
    """Store OCR results (``source_file_id, text, status, metadata``): merged text, records, new chunks.

    An engine that answers ``skipped`` is left to the next one, so results of several engines
    may be given; the first completed result of a file counts.
    """
    usable = results.where((F.col("status") == "completed") & (T.py_strip(F.col("text")) != "")).withColumnRenamed("text", "ocr_text")
    best = usable.groupBy("source_file_id").agg(F.min_by("ocr_text", F.coalesce("engine_order", F.lit(0))).alias("ocr_text"))
    old = ledger.read("document_texts", run_id).join(best, "source_file_id")
    merged = T.merge_ocr_text(F.col("text"), F.col("ocr_text"))
    rows = old.select(
        "id", "run_id", "source_file_id", "title", merged.alias("text"),
        F.to_json(F.struct(F.length(merged).alias("text_chars"), F.lit(False).alias("ocr_required"), F.lit("ocr").alias("extractor"))).alias("text_quality"),
        F.to_json(F.struct(F.lit(False).alias("ocr_required"), F.lit("completed").alias("ocr_status"), F.length("ocr_text").alias("ocr_chars"))).alias("metadata"),
        "created_at",
    )
    ledger.upsert("document_texts", rows)
    found, _ = _layout_records(_tag(best.select("source_file_id", F.col("ocr_text").alias("text")), run_id), "pdf_ocr")
    existing = ledger.read("structured_records", run_id)
    ledger.upsert("structured_records", record_rows(found, existing))
    chunk_run(ledger, run_id, best)


def ingest_records(spark: SparkSession, ledger: Ledger, payloads: DataFrame, source_type: str, name: str) -> str:
    """Store provider payloads (one JSON ``payload`` per row) as sources, texts, records and chunks."""
    builders = {
        "openalex": ("openalex_work", Rec.WORK, lambda r, raw: (F.coalesce(r["id"], r["doi"], stable_id(raw)), F.coalesce(r["title"], r["display_name"], F.lit("Untitled")), Rec.search_text(Rec.normalized_work(r)))),
        "oqmd": ("oqmd_formationenergy", Rec.OQMD, lambda r, raw: (Rec.oqmd_key(r, raw), F.concat(F.lit("OQMD "), Rec.oqmd_key(r, raw), F.lit(": "), F.coalesce(r["composition"], r["name"], Rec.oqmd_key(r, raw))), Rec.oqmd_text(r, Rec.oqmd_key(r, raw), raw))),
        "materials_project": ("materials_project_summary", Rec.MATERIAL, lambda r, raw: (F.coalesce(r["material_id"], stable_id(raw)), F.concat(F.lit("Materials Project "), F.coalesce(r["material_id"], F.lit("unknown")), F.lit(": "), F.coalesce(r["formula_pretty"], r["formula"], r["material_id"])), Rec.material_text(r, raw))),
    }
    record_type, schema, build = builders[source_type]
    run_id = ledger.create_run(name, f"external/{source_type}", json.dumps({"source": source_type}))
    ledger.set_status(run_id, "running")
    raw = F.col("payload")
    parsed = payloads.select("payload", F.from_json("payload", schema).alias("r"))
    key, title, text = build(F.col("r"), raw)
    rows = parsed.select("payload", key.alias("source_key"), title.alias("title"), text.alias("text"))
    rows = keep_first(rows, ["source_key"], [F.asc("payload")])  # repeated rows of a record count once
    ledger.upsert("source_files", external_source_rows(rows, run_id, source_type))
    stored = rows.withColumn("source_file_id", stable_id(F.lit(run_id), F.lit(source_type), F.col("source_key")))
    ledger.upsert("document_texts", _tag(stored, run_id).select(
        F.col("source_file_id").alias("id"), "run_id", "source_file_id", "title", "text",
        F.to_json(F.struct(F.length("text").alias("text_chars"), F.lit(False).alias("ocr_required"), F.lit(source_type).alias("extractor"))).alias("text_quality"),
        F.to_json(F.struct("source_key")).alias("metadata"),
    ))
    records = _tag(stored, run_id).select("run_id", "source_file_id", F.lit(record_type).alias("record_type"), "payload", F.lit(0).alias("position"))
    ledger.replace("structured_records", record_rows(records), records.select("run_id", "source_file_id"))
    chunk_run(ledger, run_id)
    promote_run(ledger, run_id)
    return run_id


# Knowledge graph ---------------------------------------------------------------------------


def parse_stages(value: str) -> list[str]:
    stages = [s.strip() for s in value.split(",") if s.strip()] or list(STAGES)
    unknown = sorted(set(stages) - set(STAGES))
    if unknown:
        raise ValueError(f"Unknown KG stages: {', '.join(unknown)}")
    return stages


def _contexts(ledger: Ledger, run_id: str) -> DataFrame:
    chunks = ledger.read("document_chunks", run_id).withColumnRenamed("id", "chunk_id")
    sections = ledger.read("document_sections", run_id).withColumnRenamed("id", "section_id")
    return E.context_rows(chunks, sections)


def build_graph(
    ledger: Ledger, run_id: str, stages: Sequence[str] = tuple(STAGES), catalog: E.Catalog = K.TERM_CATALOG,
    tei: DataFrame | None = None,
) -> dict[str, int]:
    """Build the graph tables of a run stage by stage; returns the row counts.

    ``tei`` holds structured article XML (``source_file_id, tei``); documents without it get
    text sections and record assets.
    """
    counts: dict[str, int] = {}
    texts = ledger.read("document_texts", run_id)
    scope = texts.select("run_id", "source_file_id")
    if "sections" in stages or "assets" in stages:
        sections = fallback_sections(texts, ["run_id", "source_file_id"], "title")
        assets = assets_from_records(ledger.read("structured_records", run_id))
        if tei is not None:
            parsed = stored_table(Tei.parse_tei(tei.where(F.col("tei").isNotNull())))
            sections = Tei.sections_with_fallback(_tag(Tei.tei_sections(parsed), run_id), sections)
            marked = _tag(Tei.tei_assets(parsed).drop("asset_index"), run_id).withColumn("record_type", F.lit("grobid_tei"))
            assets = merge_assets(marked, assets)
        ledger.replace("document_sections", sections.select(
            stable_id(F.col("run_id"), F.col("source_file_id"), F.lit("section"), F.col("section_index"), F.col("title"), F.col("text")).alias("id"),
            "run_id", "source_file_id", "section_index", "section_type", "title", "text",
            F.to_json(F.struct("source_file_id", "extractor")).alias("provenance"), F.lit("{}").alias("metadata"),
        ), scope)
        in_file = Window.partitionBy("run_id", "source_file_id").orderBy("asset_type", "label", "content", "metadata")
        numbered = assets.drop("asset_index").withColumn("asset_index", F.row_number().over(in_file) - 1)
        ledger.replace("document_assets", numbered.select(
            stable_id(F.col("run_id"), F.col("source_file_id"), F.lit("asset"), F.col("asset_index"), F.col("asset_type"), F.col("label"), F.col("content")).alias("id"),
            "*", F.to_json(F.struct("source_file_id", "record_type")).alias("provenance"),
        ), scope)
        counts["sections"] = ledger.read("document_sections", run_id).count()
        counts["assets"] = ledger.read("document_assets", run_id).count()
    records = ledger.read("structured_records", run_id)
    if "entities" in stages:
        mentions = E.entity_mentions(_contexts(ledger, run_id), catalog)
        entities = E.aggregate_entities(mentions, E.record_entities(records))
        ledger.replace_run("kg_entities", entities.withColumnRenamed("entity_id", "id"), run_id)
        aliases = E.entity_aliases(mentions)
        ledger.replace_run("kg_entity_aliases", aliases.withColumn("id", stable_id(F.col("entity_id"), F.col("alias"))), run_id)
        counts["entities"] = ledger.read("kg_entities", run_id).count()
    stored = ledger.read("kg_entities", run_id).withColumnRenamed("id", "entity_id")
    if "relations" in stages:
        relations = R.build_relations(_contexts(ledger, run_id), stored, records)
        ledger.replace_run("kg_relations", relations.withColumnRenamed("relation_id", "id"), run_id)
        counts["relations"] = ledger.read("kg_relations", run_id).count()
    if "embeddings" in stages:
        chunks = ledger.read("document_chunks", run_id).withColumnRenamed("id", "chunk_id")
        vectors = build_embeddings(embedding_targets(texts, chunks, stored))
        ledger.replace_run("kg_embeddings", vectors.select(
            F.col("embedding_id").alias("id"), "run_id", "target_type", "target_id", "model", "dimensions", "embedding",
            F.to_json(F.struct("text_preview")).alias("payload"),
        ), run_id)
        counts["embeddings"] = ledger.read("kg_embeddings", run_id).count()
    if "sync" in stages:
        counts.update(sync_exports(ledger, run_id))
    ledger.set_sync_status(run_id, "kg_worker", "completed", json.dumps(counts))
    return counts


def sync_exports(ledger: Ledger, run_id: str) -> dict[str, int]:
    """Graph tables and vector points below ``exports/`` of the ledger folder."""
    sections = ledger.read("document_sections", run_id).withColumnRenamed("id", "section_id")
    chunks = ledger.read("document_chunks", run_id).withColumnRenamed("id", "chunk_id")
    entities = ledger.read("kg_entities", run_id).withColumnRenamed("id", "entity_id")
    nodes, edges = ledger_graph(ledger.read("document_texts", run_id), sections, chunks, entities, ledger.read("kg_relations", run_id))
    base = f"{ledger.root}/exports/run={run_id}"
    nodes.write.mode("overwrite").parquet(f"{base}/nodes")
    edges.write.mode("overwrite").parquet(f"{base}/edges")
    exports.write_vector_points(ledger.read("kg_embeddings", run_id), f"{base}/vectors")
    counts = {
        "nodes": ledger.spark.read.parquet(f"{base}/nodes").count(),
        "edges": ledger.spark.read.parquet(f"{base}/edges").count(),
    }
    for target in ("graph", "vectors"):
        ledger.set_sync_status(run_id, target, "completed", json.dumps(counts))
    return counts


def build_all(ledger: Ledger, stages: Sequence[str] = tuple(STAGES), dry_run: bool = False) -> dict[str, dict | str]:
    """Build every run that has chunks; a run that fails is recorded and does not stop the others."""
    chunks = ledger.read("document_chunks").select("run_id").distinct()
    runs = ledger.read("ingest_runs").join(chunks, "run_id", "left_semi").orderBy("created_at", "id").select("id").collect()
    out: dict[str, dict | str] = {}
    for row in runs:
        if dry_run:
            out[row["id"]] = "planned"
            continue
        try:
            out[row["id"]] = build_graph(ledger, row["id"], stages)
        except Exception as exc:
            ledger.set_sync_status(row["id"], "kg_worker", "failed", error=str(exc)[:2000])
            out[row["id"]] = f"failed: {exc}"
    return out


def search_graph(ledger: Ledger, query: str, run_id: str = "latest", k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Lexical evidence over chunks and sections, and graph hits, of one run."""
    run = ledger.resolve_run(run_id)
    rows = _contexts(ledger, run).withColumn("evidence_id", F.concat(F.lit("kg:"), "context_type", F.lit(":"), "context_id"))
    evidence = top_k(lexical_search(rows, "text", query), k, tie=["evidence_id"]).select(
        "evidence_id", F.substring("text", 1, K.EVIDENCE_CHARS).alias("text"), F.col("source_file_id").alias("source_id"),
        F.col("context_type").alias("source_type"), F.col("source_file_id").alias("filename"), F.col("context_id").alias("section"),
        F.col("score").alias("relevance"),
    )
    entities = ledger.read("kg_entities", run).withColumnRenamed("id", "entity_id")
    relations = ledger.read("kg_relations", run).withColumnRenamed("id", "relation_id")
    return evidence, graph_hits(entities, relations, query, k)


def retriever(ledger: Ledger, run_id: str = "latest", mode: str = "auto") -> GraphVectorRetriever:
    run = ledger.resolve_run(run_id)
    files = ledger.read("source_files", run).select(F.col("id").alias("source_file_id"), "source_type", "relative_path")
    chunks = ledger.read("document_chunks", run).withColumnRenamed("id", "chunk_id").join(files, "source_file_id")
    documents = ledger.read("document_texts", run).join(files, "source_file_id")
    entities = ledger.read("kg_entities", run).withColumnRenamed("id", "entity_id")
    embeddings = ledger.read("kg_embeddings", run).withColumn("text_preview", F.from_json("payload", "text_preview STRING")["text_preview"])
    return GraphVectorRetriever(embeddings, chunks, documents, entities, mode)


def named_relations(ledger: Ledger, run_id: str = "latest") -> DataFrame:
    run = ledger.resolve_run(run_id)
    return relation_names(ledger.read("kg_relations", run), ledger.read("kg_entities", run).withColumnRenamed("id", "entity_id"))


# Provider steps ----------------------------------------------------------------------------


def _log_call(ledger: Ledger, run_id: str, provider: TextProvider | None, purpose: str, status: str, prompt: int, answer: str, error: str | None) -> None:
    name = provider.name if provider else "none"
    row = ledger.spark.range(1).select(
        stable_id(F.lit(run_id), F.lit(purpose), F.lit(name), F.current_timestamp()).alias("id"), F.lit(run_id).alias("run_id"),
        F.lit(name).alias("provider"), F.lit(name).alias("model"), F.lit(purpose).alias("purpose"), F.lit(status).alias("status"),
        F.lit(prompt).alias("prompt_chars"), F.lit(len(answer)).alias("response_chars"), F.lit(error).cast("string").alias("error"),
    )
    ledger.append("llm_calls", row)
    ledger.append("artifacts", row.select(
        "id", "run_id", F.lit(purpose).alias("kind"), F.lit(purpose).alias("stage"), "status", F.lit(answer).alias("content"), F.lit("{}").alias("metadata")
    ))


def _ask(ledger: Ledger, run_id: str, provider: TextProvider | None, purpose: str, prompt: str) -> str:
    """The provider's answer, or an empty text; every call is logged, a failure degrades the run."""
    if provider is None:
        _log_call(ledger, run_id, provider, purpose, "skipped", 0, "", "no provider")
        return ""
    try:
        answer = provider.complete("Return valid JSON only.", prompt)
    except Exception as exc:
        _log_call(ledger, run_id, provider, purpose, "failed", len(prompt), "", str(exc))
        return ""
    _log_call(ledger, run_id, provider, purpose, "completed", len(prompt), answer, None)
    return answer


def structure_corpus(ledger: Ledger, run_id: str, provider: TextProvider | None) -> dict:
    """Provider summary of the first 30 chunks of a run (at most 24 000 characters)."""
    head = ledger.read("document_chunks", run_id).orderBy("source_file_id", "chunk_index").limit(30).select("text").collect()
    return noisy_json(_ask(ledger, run_id, provider, "corpus_structure", "\n\n".join(r["text"] for r in head)[:24000]))


def add_provider_relations(ledger: Ledger, run_id: str, provider: TextProvider | None) -> int:
    """Relations proposed by a provider from the first 25 contexts and 400 entities of a run."""
    entities = ledger.read("kg_entities", run_id).withColumnRenamed("id", "entity_id")
    listed = entities.orderBy("entity_type", "normalized").limit(400).select("entity_id", "entity_type", "name").collect()
    contexts = _contexts(ledger, run_id).orderBy("context_type", "source_file_id", "context_index").limit(25).collect()
    lines = ["\t".join(r) for r in listed] + [f"[{i}] {r['text'][:1200]}" for i, r in enumerate(contexts)]
    proposals = noisy_json(_ask(ledger, run_id, provider, "kg_relation_extraction", "\n".join(lines))).get("relations") or []
    if not proposals:
        return 0
    rows = [
        (run_id, *(str(p.get(k) or "") for k in ("subject", "predicate", "object", "evidence_text")), float(p.get("confidence", K.PROVIDER_RELATION_CONFIDENCE)))
        for p in proposals
    ]
    table = ledger.spark.createDataFrame(rows, "run_id string, subject string, predicate string, object string, evidence_text string, confidence double")
    found = stored_table(R.provider_relations(table, entities, provider.name).withColumnRenamed("relation_id", "id"))
    ledger.upsert("kg_relations", found)
    return found.count()


# Hypotheses --------------------------------------------------------------------------------


@dataclass
class PipelineInput:
    target_kpi: str
    run_id: str = "latest"
    retrieval_mode: str = "tfidf"
    weights: dict[str, float] = field(default_factory=lambda: dict(K.SCORE_WEIGHTS))
    forbidden: Sequence[str] = ()
    unavailable: Sequence[str] = ()
    no_capex: bool = False

    def __post_init__(self) -> None:
        if self.retrieval_mode not in {"auto", "tfidf", "kg", "collections"}:
            raise ValueError(f"unknown retrieval mode: {self.retrieval_mode}")
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("weights must be non-negative")


def run_pipeline(ledger: Ledger, settings: PipelineInput) -> dict[str, DataFrame]:
    """Generate, review, validate and rank candidates of a run; also its graph tables."""
    run = ledger.resolve_run(settings.run_id)
    kb = knowledge_base(ledger, run)
    if settings.retrieval_mode == "tfidf":
        files = kb["documents"].select(F.col("id").alias("document_id"), "source_type", "relative_path")
        chunks = kb["chunks"].withColumnRenamed("id", "chunk_id").join(files, "document_id").withColumnRenamed("relative_path", "filename")
        search = HybridRetriever(stored_table(chunks))
    else:
        search = retriever(ledger, run, settings.retrieval_mode)
    candidates = stored_table(H.generate(kb["size_classes"], kb["extractability"], search, settings.target_kpi))
    reviewed = H.review(candidates, kb["size_classes"])
    valid = ranking.validate(reviewed, forbidden=settings.forbidden, unavailable=settings.unavailable, no_capex=settings.no_capex)
    ranked = ranking.rank(valid, settings.weights)
    relations = R.loss_relations(kb["size_classes"]).unionByName(R.recovery_relations(kb["extractability"]))
    nodes, edges = tailings_graph(kb["summaries"], kb["size_classes"], relations, ranked)
    return {"ranked": ranked, "nodes": nodes, "edges": edges, "candidates": candidates, **kb}


def export_all(result: dict[str, DataFrame], settings: PipelineInput, output: str) -> dict[str, str]:
    """CSV, JSON, graph and report of a pipeline result."""
    ranked = result["ranked"]
    exports.write_csv(exports.export_rows(ranked).orderBy("rank"), f"{output}/hypotheses_csv", single_file=True)
    exports.write_json(ranked, f"{output}/hypotheses_json")
    exports.graph_json(result["nodes"], result["edges"]).write.mode("overwrite").json(f"{output}/graph_json")
    text = exports.plain_report(settings.target_kpi, result["documents"].count(), result["chunks"].count(), ranked)
    report = exports.write_report(Path(output) / "report.pdf", text)
    return {"csv": f"{output}/hypotheses_csv", "json": f"{output}/hypotheses_json", "graph": f"{output}/graph_json", "report": str(report)}
