"""Overlapping fixed-size chunks of whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.text import collapse_ws

CHUNKS_PER_BLOCK = 64


def chunk_documents(
    docs: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk: the ``keep`` columns, ``chunk_index`` and ``chunk_text``.

    Chunk starts are ``i * (size - overlap)``, so no state is carried and no shuffle is
    needed. A text is first cut into blocks of 64 chunks: a long text is then scanned once
    per block instead of once per chunk, and no output row carries the whole text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    body = docs.select(*keep, collapse_ws(F.coalesce(F.col(text), F.lit(""))).alias("_body"))

    def chunk_count(length):
        return (F.ceil(F.greatest(length - size, F.lit(0)) / step) + 1).cast("int")

    last_block = F.floor((chunk_count(F.length("_body")) - 1) / CHUNKS_PER_BLOCK).cast("int")
    block_chars = (CHUNKS_PER_BLOCK - 1) * step + size
    blocks = F.transform(
        F.sequence(F.lit(0), last_block),
        lambda b: F.substring(F.col("_body"), b * (CHUNKS_PER_BLOCK * step) + 1, F.lit(block_chars)),
    )
    # an empty text yields no block: a generator drops it without computing the body twice
    parts = body.select(*keep, F.posexplode(F.when(F.length("_body") > 0, blocks)).alias("_block", "_part"))
    chunks = F.transform(
        F.sequence(F.lit(0), chunk_count(F.length("_part")) - 1),
        lambda i: F.struct(
            (F.col("_block") * CHUNKS_PER_BLOCK + i).alias("chunk_index"),
            F.substring(F.col("_part"), i * step + 1, F.lit(size)).alias("chunk_text"),
        ),
    )
    return parts.select(*keep, F.inline(chunks))
