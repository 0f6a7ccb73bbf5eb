"""The input tables seen as a document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.operators.chunking import chunk_documents
from oreweave.tables import spread, table

# Terms that occur in the generated prose, added to the term catalog so that every entity
# type has hits in it.
CORPUS_TERMS = {
    "property": ["hehely", "ononst"],
    "method": ["sich", "elle"],
    "process": ["orantion"],
    "phase": ["keit"],
    "defect": ["das"],
    "application": ["from"],
    "material_class": ["with"],
}
CATALOG = {kind: [*terms, *CORPUS_TERMS.get(kind, [])] for kind, terms in K.TERM_CATALOG.items()}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, source_file_id, title, text, source_type, relative_path, lang."""
    name = F.col("doc_id").cast("string")
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("source").alias("run_id"),
        name.alias("source_file_id"),
        F.concat(F.lit("Document "), name).alias("title"),
        "text",
        F.lit("txt").alias("source_type"),
        F.concat_ws("/", "lang", F.concat(name, F.lit(".txt"))).alias("relative_path"),
        "lang",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, source_file_id, chunk_id, chunk_index, text, source_type, relative_path."""
    keep = ["run_id", "source_file_id", "source_type", "relative_path"]
    pieces = chunk_documents(documents(spark, sf_dir), keep)
    return pieces.select(
        *keep,
        F.concat_ws(":chunk:", "source_file_id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("chunk_index"),
        F.col("chunk_text").alias("text"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider records built from ``benchmark``: each item names its longest leading words as a material."""
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda w: F.length(w) >= 6)
    name = F.get(words, F.lit(0))
    return (
        table(spark, sf_dir, "benchmark")
        .select(
            F.concat(F.lit("src"), F.pmod("item_id", F.lit(20))).alias("run_id"),
            F.concat(F.lit("bench-"), "item_id").alias("source_file_id"),
            F.lit("materials_project_summary").alias("record_type"),
            F.to_json(
                F.struct(name.alias("formula_pretty"), F.concat(F.lit("mp-"), "item_id").alias("material_id"))
            ).alias("payload"),
        )
    )


SQL_DOCUMENTS = """(
  SELECT source AS run_id, doc_id::VARCHAR AS source_file_id, 'Document ' || doc_id AS title, text,
         'txt' AS source_type, lang || '/' || doc_id || '.txt' AS relative_path, lang
  FROM documents
)"""
