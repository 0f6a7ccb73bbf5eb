"""Ordered scans that survive groups of any size.

A plain window sorts a whole group in one task. Here each group is cut into blocks of its
order column: the window runs inside a block, one aggregate row per block goes through a
second window, and the carried value is joined back. A group with a third of all rows is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, output: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row. ``block`` must grow with ``order``."""
    rows = df.withColumn(BLOCK, block)
    inside = rows.withColumn("_own", F.last(value, ignorenulls=True).over(
        _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys, BLOCK).agg(
        F.max_by(value, F.struct(*order)).alias("_end"))
    blocks = rows.select(*keys, BLOCK).distinct().join(ends, [*keys, BLOCK], "left")
    carried = blocks.select(*keys, BLOCK, F.last("_end", ignorenulls=True).over(_before(keys)).alias("_carry"))
    return (
        inside.join(carried, [*keys, BLOCK])
        .withColumn(output, F.coalesce("_own", "_carry"))
        .drop("_own", "_carry", BLOCK)
    )


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, label: Column, output: str = "island"
) -> DataFrame:
    """Number the runs of equal ``label`` in each group, from 1."""
    rows = df.withColumn(BLOCK, block).withColumn("_label", label)
    inside = _inside(keys, order)
    marked = rows.withColumn("_prev", F.lag("_label").over(inside)).withColumn("_pos", F.row_number().over(inside))
    starts = F.when((F.col("_pos") > 1) & ~F.col("_prev").eqNullSafe(F.col("_label")), 1).otherwise(0)
    counted = marked.withColumn("_runs", F.sum(starts).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    edges = counted.groupBy(*keys, BLOCK).agg(
        F.max("_runs").alias("_last_run"),
        F.min_by("_label", F.struct(*order)).alias("_first"),
        F.max_by("_label", F.struct(*order)).alias("_last"),
    )
    sequence = Window.partitionBy(*keys).orderBy(BLOCK)
    step = F.when(F.row_number().over(sequence) == 1, 1).when(
        F.lag("_last").over(sequence).eqNullSafe(F.col("_first")), 0).otherwise(1)
    offsets = (
        edges.withColumn("_step", step)
        .withColumn("_size", F.col("_step") + F.col("_last_run"))
        .withColumn("_base", F.sum("_size").over(sequence) - F.col("_last_run"))
        .select(*keys, BLOCK, "_base")
    )
    return (
        counted.join(offsets, [*keys, BLOCK])
        .withColumn(output, (F.col("_base") + F.col("_runs")).cast("bigint"))
        .drop("_prev", "_pos", "_runs", "_base", "_label", BLOCK)
    )


def consecutive_run(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, flag: Column, output: str = "run_length"
) -> DataFrame:
    """Length of the current streak of ``flag`` rows; 0 where the flag is false."""
    numbered = islands(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, order, block, F.col("_flag"))
    sizes = islands_position(numbered, keys, order, block)
    return sizes.withColumn(output, F.when(F.col("_flag"), F.col("_position")).otherwise(F.lit(0)).cast("bigint")).drop(
        "_flag", "_position", "island"
    )


def islands_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Position of each row inside its island, counted across blocks."""
    return numbering(df, [*keys, "island"], order, block, "_position")


def numbering(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, output: str) -> DataFrame:
    """Row numbers from 1 in each group, counted across blocks."""
    rows = df.withColumn(BLOCK, block)
    own = rows.withColumn("_own", F.row_number().over(_inside(keys, order)))
    before = (
        rows.groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_carry"))
    )
    return own.join(before, [*keys, BLOCK]).withColumn(output, F.col("_own") + F.col("_carry")).drop("_own", "_carry", BLOCK)
