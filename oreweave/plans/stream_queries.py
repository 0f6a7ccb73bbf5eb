"""Incremental queries: the events table read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.operators.dedupe import keep_first
from oreweave.plans.registry import query
from oreweave.session import shared_workdir
from oreweave.streaming import incremental as S
from oreweave.tables import table


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # the folder holds other tables too; the stream takes the events file only
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("stream_dedupe", "SELECT user_id, event_type, count(*) AS keys FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    """Each (user, event type) passes once, whenever it comes back."""
    data, checkpoint = S.work_paths(spark, "stream-dedupe")
    first = S.first_of_key(_stream(spark, sf_dir), data, checkpoint, ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")])
    return first.groupBy("user_id", "event_type").agg(F.count("*").alias("keys"))


@query("stream_upsert", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type AS status FROM events ORDER BY user_id, ts DESC, event_id DESC")
def stream_upsert(spark, sf_dir):
    data, checkpoint = S.work_paths(spark, "stream-upsert")
    latest = S.upsert_batches(_stream(spark, sf_dir), data, checkpoint, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return latest.select("user_id", "event_id", F.col("event_type").alias("status"))


@query("stream_streaks", """
  WITH rows AS (SELECT event_id // 64 AS key, event_id % 64 AS seq, event_type = 'error' AS failed FROM events),
  runs AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - row_number() OVER (PARTITION BY key, failed ORDER BY seq) AS run FROM rows),
  sizes AS (SELECT key, failed, run, count(*) AS n FROM runs GROUP BY ALL)
  SELECT key::VARCHAR AS key, sum(n)::BIGINT AS events, coalesce(max(n) FILTER (failed), 0) AS longest_streak, coalesce(max(n) FILTER (failed), 0) >= 3 AS stopped
  FROM sizes GROUP BY key
""")
def stream_streaks(spark, sf_dir):
    """Failure streaks of pages of 64 events whose rows come in several micro-batches out of sequence."""
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.expr("event_id div 64").cast("string").alias("key"), (F.col("event_id") % 64).cast("int").alias("seq"), (F.col("event_type") == "error").alias("failed"),
    )
    source, (data, checkpoint) = shared_workdir(spark, "streaks-in"), S.work_paths(spark, "stream-streaks")
    rows.repartition(4, F.xxhash64("key", "seq")).write.parquet(source)  # each file, so each micro-batch, has some rows of every key
    streaks = S.failure_streaks(S.file_stream(spark, source, rows.schema, max_files=max(1, _files(spark, source) // 3)), 3)
    S.drain(streaks, lambda batch, number: batch.write.mode("overwrite").parquet(f"{data}/batch={number}"), checkpoint, "update")
    schema = streaks.schema.add("batch", "long")
    return keep_first(spark.read.schema(schema).parquet(data), ["key"], [F.desc("batch")]).drop("batch")


def _files(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getFileCount()
