"""Hashing embeddings and the embedding table of a run."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.hashing import hash_bucket, stable_id
from oreweave.functions.text import query_terms
from oreweave.tables import text_parts


def _cells(df: DataFrame, keys: Sequence[str], text: str, dimensions: int) -> DataFrame:
    """keys, ``_cells`` (bucket, count), ``_norm``.

    Texts are shuffled once by key; token counting and norms reuse that partitioning, so the
    exploded tokens never cross the network. Partitions hold a fixed amount of text, so a task
    counts as many tokens in a large table as in a small one. Each distinct token of a text is
    hashed once.
    A text without tokens keeps one row with no cells.
    """
    placed = df.select(*keys, text).repartition(text_parts(df, text), *keys)
    tokens = placed.select(*keys, F.explode_outer(query_terms(F.col(text))).alias("_token"))
    per_token = tokens.groupBy(*keys, "_token").agg(F.count("_token").alias("_n"))
    counts = per_token.groupBy(*keys, hash_bucket(F.col("_token"), dimensions).alias("bucket")).agg(
        F.sum("_n").cast("double").alias("_count")
    )
    cell = F.when(F.col("bucket").isNotNull(), F.struct("bucket", F.col("_count").alias("count")))
    return counts.groupBy(*keys).agg(
        F.collect_list(cell).alias("_cells"),  # at most `dimensions` cells
        F.sqrt(F.sum(F.col("_count") * F.col("_count"))).alias("_norm"),
    )


def bucket_weights(
    df: DataFrame, keys: Sequence[str], text: str = "text", dimensions: int = K.EMBEDDING_DIMENSIONS
) -> DataFrame:
    """Sparse hashing vectors: keys, ``bucket``, ``weight`` (token counts scaled to unit length)."""
    cells = _cells(df, keys, text, dimensions).select(*keys, "_norm", F.inline("_cells"))
    return cells.select(*keys, "bucket", (F.col("count") / F.col("_norm")).alias("weight"))


def embed(
    df: DataFrame, keys: Sequence[str], text: str = "text", dimensions: int = K.EMBEDDING_DIMENSIONS
) -> DataFrame:
    """Dense hashing vectors: keys and ``embedding`` (zeros for a text without tokens)."""
    by_bucket = F.map_from_entries(F.transform("_cells", lambda c: F.struct(c["bucket"], c["count"] / F.col("_norm"))))
    # the map is bound by a one-element transform; a lambda would rebuild a plain column per cell
    dense = F.transform(
        F.array(by_bucket),
        lambda cells: F.transform(
            F.sequence(F.lit(0), F.lit(dimensions - 1)),
            lambda i: F.coalesce(F.try_element_at(cells, i.cast("bigint")), F.lit(0.0)),
        ),
    )
    return _cells(df, keys, text, dimensions).select(*keys, F.get(dense, F.lit(0)).alias("embedding"))


def embed_query(text: str, dimensions: int = K.EMBEDDING_DIMENSIONS) -> dict[int, float]:
    """The same vector for one query string, as non-zero cells."""
    counts = Counter(
        int(hashlib.sha1(token.encode("utf-8")).hexdigest()[:16], 16) % dimensions
        for token in re.findall(K.QUERY_TOKEN_PATTERN, (text or "").lower())
    )
    length = math.sqrt(sum(n * n for n in counts.values()))
    return {bucket: n / length for bucket, n in sorted(counts.items())}


def embedding_targets(documents: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents, chunks and entities as one table of texts to embed.

    documents: run_id, source_file_id, title, text. chunks: run_id, chunk_id, text.
    entities: run_id, entity_id, entity_type, name.
    """
    return (
        documents.select(
            "run_id", F.lit("documents").alias("target_type"), F.col("source_file_id").alias("target_id"),
            F.concat_ws("\n", "title", "text").alias("text"),
        )
        .unionByName(
            chunks.select("run_id", F.lit("chunks").alias("target_type"), F.col("chunk_id").alias("target_id"), "text")
        )
        .unionByName(
            entities.select(
                "run_id", F.lit("entities").alias("target_type"), F.col("entity_id").alias("target_id"),
                F.concat(F.col("entity_type"), F.lit(": "), F.col("name"), F.lit(" ")).alias("text"),
            )
        )
    )


def build_embeddings(
    targets: DataFrame, model: str = K.EMBEDDING_MODEL, dimensions: int = K.EMBEDDING_DIMENSIONS
) -> DataFrame:
    keys = ["run_id", "target_type", "target_id"]
    shown = targets.withColumn("text_preview", F.substring("text", 1, K.PAYLOAD_PREVIEW_CHARS))
    return embed(shown, [*keys, "text_preview"], "text", dimensions).select(
        stable_id(F.col("run_id"), F.col("target_type"), F.col("target_id"), F.lit(model)).alias("embedding_id"),
        *keys,
        F.lit(model).alias("model"),
        F.lit(dimensions).alias("dimensions"),
        "embedding",
        "text_preview",
    )
