"""Readers for the input tables and the record views the jobs derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

PART_BYTES = 4 << 20  # text whose words are counted in one task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLE_NAMES:
        raise KeyError(f"unknown table: {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table scan over all cores, when the files arrive in fewer splits than cores.

    For CPU-heavy row work on small or badly split files. A table with enough splits, as any
    large one has, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_parts(df: DataFrame, text: str) -> int:
    """How many partitions give each about PART_BYTES of text, at least one a core."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLE_NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


SIZE_CLASS_BY_LINE = ["+125", "+71", "-125+71", "-71+45", "-45+20", "-20+10", "-10"]


def tailings_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tailings size-class records built from ``lineitem``.

    The supplier stands for the plant, the line status for the tailings stream and the
    line number for the size class; quantity and price are the two element tonnages.
    Money is summed as a decimal so the totals do not depend on row order.
    """
    lines = table(spark, sf_dir, "lineitem")
    size_class = F.element_at(
        F.array(*[F.lit(s) for s in SIZE_CLASS_BY_LINE]), F.pmod(F.col("l_linenumber") - 1, F.lit(7)).cast("int") + 1
    )
    return (
        lines.groupBy(
            F.concat(F.lit("P"), F.col("l_suppkey")).alias("plant"),
            F.when(F.col("l_linestatus") == "O", "Отвальные хвосты").otherwise("Хвосты породные").alias("stream"),
            size_class.alias("size_class"),
        )
        .agg(
            F.sum("l_quantity").alias("element28_tonnes"),
            (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) / 10000).cast("double").alias("price_tonnes"),
        )
        .withColumn("element29_tonnes", F.round("price_tonnes", 1))
        .drop("price_tonnes")
    )
