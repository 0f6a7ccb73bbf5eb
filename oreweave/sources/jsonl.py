"""JSON-lines inputs: resume scans, feedback, ledger reloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = "hypothesis_id STRING, action STRING, expert_comment STRING, score_override DOUBLE, created_at STRING"
FEEDBACK_ACTIONS = ["approve", "reject", "edit_score", "tested_confirmed", "tested_refuted"]


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed JSON lines as text; malformed and blank lines are left out."""
    lines = spark.read.text(path).select(F.col("value").alias("payload"))
    return lines.where(F.try_parse_json("payload").isNotNull())


def seen_keys(spark: SparkSession, path: str, schema: str, key: Column) -> DataFrame:
    """Keys already exported to a JSON-lines folder."""
    record = F.from_json("payload", schema)
    rows = json_lines(spark, path).withColumn("record", record)
    return rows.select(key.alias("key")).where(F.col("key").isNotNull()).distinct()


def downloaded_links(spark: SparkSession, path: str) -> DataFrame:
    """Links and ids a harvest manifest already lists as downloaded."""
    record = F.from_json("payload", "status STRING, pdf_url STRING, content_id STRING")
    rows = json_lines(spark, path).select(record.alias("r")).where(F.col("r.status") == "downloaded")
    return rows.select(F.col("r.pdf_url").alias("pdf_url"), F.col("r.content_id").alias("content_id"))


def query_counts(spark: SparkSession, path: str) -> DataFrame:
    """Exported records per query."""
    record = F.from_json("payload", "query STRING")
    return json_lines(spark, path).groupBy(record["query"].alias("query")).agg(F.count("*").alias("records"))


def load_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Expert feedback; an unknown action is an error."""
    rows = spark.read.schema(FEEDBACK).option("multiLine", "true").json(path)
    checked = F.when(F.col("action").isin(FEEDBACK_ACTIONS), F.col("action")).otherwise(
        F.raise_error(F.concat(F.lit("unknown feedback action: "), F.coalesce("action", F.lit("null"))))
    )
    return rows.withColumn("action", checked)


def knowledge_base(ledger, run_id: str) -> dict[str, DataFrame]:
    """Documents, chunks and typed records of a run."""
    files, texts = ledger.read("source_files", run_id), ledger.read("document_texts", run_id)
    records = ledger.read("structured_records", run_id)
    where = "plant STRING, stream STRING, source_id STRING"
    tonnes = "element28_tonnes DOUBLE, element29_tonnes DOUBLE"

    def typed(kind: str, extra: str) -> DataFrame:
        rows = records.where(F.col("record_type") == kind)
        return rows.select("source_file_id", "record_index", F.from_json("payload", f"{where}, {tonnes}, {extra}").alias("r")).select(
            "source_file_id", "record_index", "r.*"
        )

    return {
        "documents": files.select("id", "run_id", "path", "relative_path", "source_type").join(
            texts.select(F.col("source_file_id").alias("id"), "title", "text", "metadata"), "id"
        ),
        "chunks": ledger.read("document_chunks", run_id),
        "summaries": typed("summaries", "dry_metric_tonnes DOUBLE, element28_grade_pct DOUBLE, element29_grade_pct DOUBLE"),
        "size_classes": typed("size_classes", "size_class STRING, mass_share_pct DOUBLE"),
        "extractability": typed("extractability", "extractable BOOLEAN"),
    }
