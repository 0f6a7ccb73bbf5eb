"""Corpus pipeline: from raw documents to packed training sequences.

Each stage gets what its predecessor kept, written as Parquet and read again:

quality     documents that the classifier does not predict as good go
near_dups   one document of each group of near duplicates stays
passages    passages that an earlier document has are cut; documents left without text go
pii         personal data is replaced by pseudonyms
packing     the rest is placed in sequences of at most 4096 tokens

All but the last stage return the columns of documents, with n_chars following the text. Extra
columns are carried along. Rows with a null doc_id are judged like others and never near
duplicates. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.llm.minhash import near_duplicates
from oreweave.llm.packing import pack_documents
from oreweave.llm.pseudonyms import DEMO_KEY, pseudonymised
from oreweave.llm.quality import quality_model
from oreweave.llm.repeats import without_repeats
from oreweave.session import shared_workdir

THRESHOLD = 0.7  # least score of a document that stays
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model(spark, docs, sf_dir)
    return docs.where(model.score(spark) >= THRESHOLD)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat an id stay or go together, but equal texts under one id stay once; null ids stay."""
    found = near_duplicates(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = found.where("not kept").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns)
    known = known.dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(without_repeats(docs)).where(F.length("text") > 0)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pseudonymised(docs, DEMO_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dups", near_dups), ("passages", passages), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None  # trained, sorted and tokenised stages are beyond SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = shared_workdir(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
