"""Incremental ingestion as Structured Streaming.

A work queue polled until it is empty becomes a file stream with ``availableNow``: the
checkpoint remembers what was taken, a restart goes on from there, and each micro-batch is
written once under its batch number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.operators.dedupe import keep_first
from oreweave.session import shared_workdir


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, then stop."""
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the stream to a parquet folder, exactly once per batch (the file sink's own log)."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def first_of_key(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Seen-key rule of the exporters: one row per key over the whole stream, however long ago it was seen.

    The rows passed so far are the table of seen keys. A batch keeps its first row of each key
    and drops keys of earlier batches by an anti join; a repeated batch overwrites its own
    folder only, so nothing depends on event time or on state in memory.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = keep_first(batch, list(keys), list(order))
        if batch_id:
            known = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(path)
            seen = known.where(F.col("batch") < batch_id).select(*keys)
            same = [fresh[k].eqNullSafe(seen[k]) for k in keys]
            fresh = fresh.join(seen, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain(stream, write, checkpoint)
    return spark.read.schema(schema).parquet(path)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key of a stream.

    Each batch is reduced to its newest row per key and written to its own folder, which a
    repeated batch overwrites; reading resolves the batches. Nothing is rewritten while
    streaming, so the cost of a batch depends on the batch alone.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_first(batch, list(keys), list(order)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain(stream, write, checkpoint)
    return keep_first(spark.read.parquet(path), list(keys), list(order)).drop("batch")


STREAK_OUTPUT = "key string, events bigint, longest_streak bigint, stopped boolean"
STRETCH = ("first", "last", "events", "head", "tail", "longest")
STREAK_STATE = ", ".join(f"`{name}` array<bigint>" for name in STRETCH)


def _follow(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """One stretch out of two, the second after the first: its failures at the head, at the tail and in the longest run."""
    head = a[3] + b[3] if a[3] == a[2] else a[3]
    tail = b[4] + a[4] if b[4] == b[2] else b[4]
    return [a[0], b[1], a[2] + b[2], head, tail, max(a[5], b[5], a[4] + b[3])]


def failure_streaks(stream: DataFrame, limit: int) -> DataFrame:
    """Consecutive failures per key (``key, seq, failed``) and whether an exporter would have stopped.

    Rows may arrive in any sequence, over micro-batches too. The state of a key is a list of
    stretches of sequence numbers without a gap; a stretch keeps counts only, and early ones wait
    until the rows between arrive and join them. The answer after each micro-batch is that of all
    rows so far in sequence. State grows with the gaps, not with the rows: number a key's rows
    without gaps. A repeated number counts once, its first arrival; within a micro-batch a failure
    goes before a success. A null outcome is a success; rows without a number are passed over.
    """

    def update(key, batches, state):
        old = list(map(list, zip(*state.get))) if state.exists else []
        frames = list(batches)  # arrays, for a key has few rows and a table many keys
        seqs, failed = (np.concatenate([frame[name].to_numpy() for frame in frames]) for name in ("seq", "failed"))
        if seqs.dtype.kind not in "iu":
            known = ~pd.isna(seqs)
            seqs, failed = seqs[known], failed[known]
        seqs = seqs.astype(np.int64, copy=False)
        if failed.dtype != bool:
            failed = np.array([value is not None and value == value and bool(value) for value in failed], bool)
        order = np.lexsort((~failed, seqs))
        seqs, failed = seqs[order], failed[order]
        fresh = np.r_[True, seqs[1:] != seqs[:-1]][: len(seqs)]
        if old:  # numbers inside a known stretch came before
            firsts, lasts = np.array([s[0] for s in old]), np.array([s[1] for s in old])
            at = np.searchsorted(firsts, seqs, "right") - 1
            fresh &= (at < 0) | (seqs > lasts[at])
        new = [[int(q), int(q), 1, int(f), int(f), int(f)] for q, f in zip(seqs[fresh], failed[fresh])]
        stretches: list[list[int]] = []
        for stretch in sorted(old + new):
            if stretches and stretches[-1][1] + 1 == stretch[0]:
                stretches[-1] = _follow(stretches[-1], stretch)
            else:
                stretches.append(stretch)
        if not stretches:
            return
        state.update(tuple([s[i] for s in stretches] for i in range(len(STRETCH))))
        whole = stretches[0]
        for stretch in stretches[1:]:
            whole = _follow(whole, stretch)
        yield pd.DataFrame([(key[0], whole[2], whole[5], whole[5] >= limit)], columns=["key", "events", "longest_streak", "stopped"])

    return stream.groupBy("key").applyInPandasWithState(update, STREAK_OUTPUT, STREAK_STATE, "update", "NoTimeout")


def work_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Output and checkpoint folder of one streaming run."""
    root = shared_workdir(spark, name)
    return f"{root}/data", f"{root}/checkpoint"
