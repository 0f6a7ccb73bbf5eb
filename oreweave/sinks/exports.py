"""File exports. Tables are written by Spark; only bounded reports are formatted on the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave.functions import text as T

BATCH_ROWS = 128


def export_rows(candidates: DataFrame) -> DataFrame:
    """The nine export columns of ranked candidates (a list of at most a few dozen rows)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("final_score"), "position")
    blank = F.lit("")
    return candidates.select(
        F.row_number().over(order).alias("rank"),
        "id",
        "title",
        F.coalesce("target_plant", blank).alias("plant"),
        F.coalesce("target_stream", blank).alias("stream"),
        F.coalesce("target_size_class", blank).alias("size_class"),
        "target_element",
        "final_score",
        F.array_join("warnings", "; ").alias("warnings"),
    )


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", "true").option("quoteAll", "false").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def plain_report(target_kpi: str, documents: int, chunks: int, ranked: DataFrame, top: int = 5) -> str:
    """Text report of the best candidates."""
    total = ranked.count()
    lines = [f"KPI: {target_kpi}", f"Documents: {documents}", f"Chunks: {chunks}", f"Hypotheses: {total}", "", "Top hypotheses:"]
    best = ranked.orderBy(F.desc("final_score"), "position").limit(top).collect()
    for i, row in enumerate(best, 1):
        lines += [f"{i}. {row['title']} | score={row['final_score']:.3f}", f"   {row['expected_effect']}"]
    return "\n".join(lines)


def write_report(path: Path, text: str) -> Path:
    """PDF when a PDF writer is installed, else a text file beside it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        from reportlab.lib.pagesizes import A4
        from reportlab.pdfgen import canvas
    except ImportError:
        target = path.with_suffix(".txt")
        target.write_text(text, encoding="utf-8")
        return target
    page = canvas.Canvas(str(path), pagesize=A4)
    for i, line in enumerate(text.splitlines()):
        page.drawString(40, A4[1] - 40 - 13 * i, line[:115])
    page.save()
    return path


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph export as JSON lines; parallel edges between the same ends are numbered from 0."""
    key = Window.partitionBy("source", "target").orderBy("relation")
    keyed = edges.withColumn("key", F.row_number().over(key) - 1)
    node_rows = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("value"))
    edge_rows = keyed.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*keyed.columns)).alias("value"))
    return node_rows.unionByName(edge_rows)


def append_new_json(found: DataFrame, seen: DataFrame, key: str, path: str) -> None:
    """Append the records whose key was not exported before."""
    fresh = found.dropDuplicates([key]).join(seen.select(key), key, "left_anti")
    fresh.write.mode("append").json(path)


def capped_export(works: DataFrame, seen: DataFrame, per_query: int | None, total: int | None) -> DataFrame:
    """Works of a literature harvest: new ids only, each once, at most ``per_query`` of a query.

    works: query, query_index, position, work_id and further columns. A work found by several
    queries belongs to the first one. The total cap takes queries in order.
    """
    order = [F.asc("query_index"), F.asc("position")]
    fresh = works.join(seen.select("work_id"), "work_id", "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("work_id").orderBy(*order))).where("_n = 1").drop("_n")
    if per_query:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("position"))
        first = first.withColumn("_rank", rank).where(F.col("_rank") <= per_query).drop("_rank")
    return first.orderBy(*order).limit(total) if total else first


def export_manifest(written: DataFrame, skipped: DataFrame, failed: DataFrame, status: str, **facts: Any) -> DataFrame:
    """One manifest row: counts of written, skipped and failed records and the run's settings."""
    events = (
        written.select(F.lit("written").alias("kind"))
        .unionByName(skipped.select(F.lit("skipped").alias("kind")))
        .unionByName(failed.select(F.lit("failed").alias("kind")))
    )
    counts = events.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in
                          (("written", "records_written"), ("skipped", "skipped_existing"), ("failed", "failed_pages"))])
    state = F.when((F.col("failed_pages") > 0) & F.lit(status == "completed"), "completed_degraded").otherwise(status)
    return counts.select(state.alias("status"), "*", F.lit(json.dumps(facts, ensure_ascii=False, default=str)).alias("settings"))


def harvest_manifest(records: DataFrame) -> DataFrame:
    """Flat rows of a harvest log with nested metadata."""
    m = F.col("metadata")
    return records.select(
        "status", "content_id", "title", "query", "page", "path", m["bytes"].alias("bytes"), m["sha256"].alias("sha256"),
        "article_url", "pdf_url", "scraped_at",
    )


def harvest_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("files"))


def is_pdf(content: Column) -> Column:
    return F.startswith(content, F.unhex(F.lit("25504446")))


def flat_output_names(files: DataFrame, order: Sequence[str] = ("relative_path",)) -> DataFrame:
    """Output names of a conversion: path parts joined by ``__``; later clashes get ``_1``, ``_2``, …"""
    stem = F.regexp_replace("relative_path", r"\.[^./]+$", "")
    flat = F.array_join(F.split(stem, "/"), "__")
    rank = F.row_number().over(Window.partitionBy("_flat").orderBy(*order)) - 1
    suffix = F.when(F.col("_rank") > 0, F.concat(F.lit("_"), F.col("_rank"))).otherwise("")
    return (
        files.withColumn("_flat", flat)
        .withColumn("_rank", rank)
        .withColumn("output_name", F.concat("_flat", suffix, F.lit(".md")))
        .drop("_flat", "_rank")
    )


def run_log_lines(results: DataFrame) -> DataFrame:
    """Fixed-width log line per converted file (``timestamp, path, bytes, processor, ok, skipped_reason, error``)."""
    skipped = F.col("skipped_reason").isNotNull()
    label = F.when(skipped, "SKIPPED").when(F.col("ok") & (F.col("processor") == "dry-run"), "DRY-RUN").when(F.col("ok"), "OK").otherwise("ERROR")
    name = F.element_at(F.split("path", "/"), -1)
    short = F.when(F.length(name) > 42, F.concat(F.substring(name, 1, 41), F.lit("…"))).otherwise(name)
    note = F.when(skipped, F.col("skipped_reason")).when(F.col("ok"), "").otherwise(F.coalesce("error", F.lit("")))
    line = F.concat_ws(
        " | ",
        F.rpad("timestamp", 19, " "), F.rpad(short, 42, " "), F.lpad(T.human_size(F.col("bytes")), 10, " "),
        F.rpad("processor", 26, " "), F.rpad(label, 9, " "), note,
    )
    return results.select("path", label.alias("result"), line.alias("line"))


def write_links(links: DataFrame, path: str, fmt: str = "text") -> None:
    """Harvested links as text, JSON or CSV."""
    if fmt == "text":
        links.select(F.col("link").alias("value")).write.mode("append").text(path)
    elif fmt == "json":
        write_json(links, path, "append")
    elif fmt == "csv":
        links.write.mode("append").option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown link format: {fmt}")


def write_vector_points(embeddings: DataFrame, path: str) -> None:
    """Vector points by target type, with the numeric point id of the vector index."""
    from oreweave.functions.hashing import point_id

    embeddings.select(
        point_id(F.col("id")).alias("point_id"), F.col("id").alias("embedding_id"), "run_id", "target_type",
        F.col("target_id").alias("ledger_id"), "embedding", "payload",
    ).write.mode("overwrite").partitionBy("target_type").parquet(path)


def send_vector_points(embeddings: DataFrame, send, batch_rows: int = BATCH_ROWS) -> None:
    """Push points to an external index from the tasks, ``batch_rows`` at a time.

    ``send(rows)`` must be idempotent by point id: a retried task sends its batches again.
    """

    def push(rows) -> None:
        batch = []
        for row in rows:
            batch.append(row.asDict())
            if len(batch) == batch_rows:
                send(batch)
                batch = []
        if batch:
            send(batch)

    embeddings.foreachPartition(push)


def append_feedback(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)
