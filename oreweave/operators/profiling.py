"""Column profiles and exact statistics of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreweave import constants as K
from oreweave.session import stored
from oreweave.tables import spread

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
NEVER_NUMBERS = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, non-null count and row count, from one scan."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("data_type"),
            F.col(c).alias("non_null"),
            F.col("_rows").alias("row_count"),
        )
        for i, c in enumerate(df.columns, 1)
    ]
    return counts.select(F.inline(F.array(*cells)))


def _long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric column, value) rows without nulls and NaN.

    Dates, times and truth values are never numbers. Text is cast only where it has a digit or an
    infinity: a cast that fails costs many times one that does not.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(c: str) -> Column:
        if isinstance(kinds[c], NUMERIC):
            return F.col(c).try_cast("double")
        text = F.col(c).cast("string")
        return F.when(F.rlike(text, F.lit("(?i)[0-9]|inf")), text.try_cast("double"))

    able = [c for c in columns if not isinstance(kinds[c], NEVER_NUMBERS)]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), number(c).alias("value")) for c in able])
    rows = spread(df.select(*able)) if able else df
    cells = cells if able else F.array().cast("array<struct<column_name:string,value:double>>")
    return rows.select(F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    accuracy: int = 100_000,
) -> DataFrame:
    """Exact interpolated quantiles of groups of any size.

    A sketch brackets every quantile; rows below a bracket are only counted, map-side, and just
    the distinct values inside travel. They are dealt over tasks by ranges of value, block counts
    are summed up over the ranges, and only the block that holds a rank is put in order: neither a
    group nor a bracket meets in one task. Groups of at most ``2 * accuracy`` rows use their full
    range. A bracket that misses its rank raises, it never yields a wrong value.
    """
    slack = 8.0 / accuracy
    lows = [max(0.0, p - slack) for p in probabilities]
    highs = [min(1.0, p + slack) for p in probabilities]
    sketch = values.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.percentile_approx(value, lows + highs, accuracy).alias("_sketch"),
    )
    low_at, high_at = F.get("_sketch", F.col("_i")), F.get("_sketch", F.col("_i") + len(probabilities))
    small = F.col("_n") <= 2 * accuracy
    p = F.col("probability")
    brackets = sketch.select(
        *keys, "_n", "_sketch", "_min", "_max",
        F.posexplode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("_i", "probability"),
    ).select(
        *keys,
        "probability",
        F.when(small | (p <= slack), F.col("_min")).otherwise(low_at).alias("_low"),
        F.when(small | (p >= 1 - slack), F.col("_max")).otherwise(high_at).alias("_high"),
        (p * (F.col("_n") - 1)).alias("_rank"),
    )
    # a stored table has a known size: the planner broadcasts it where it is small
    joined = values.join(stored(brackets), list(keys)).where(F.col(value) <= F.col("_high"))
    by = [*keys, "probability", "_rank"]
    inside = F.when(F.col(value) >= F.col("_low"), F.col(value))  # null: below the bracket, one row a quantile
    folded = joined.groupBy(*by, inside.alias("_value")).agg(F.count("*").alias("_c"))
    dealt = stored(folded.repartitionByRange(*[F.col(c) for c in by], F.asc_nulls_first("_value")).withColumn("_block", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(*by, "_block").agg(F.sum("_c").alias("_t"))
    blocks = blocks.withColumn("_carry", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    holds = [(F.col("_carry") <= r) & (r < F.col("_carry") + F.col("_t")) for r in (F.floor("_rank"), F.ceil("_rank"))]
    ordered = Window.partitionBy(*by, "_block").orderBy(F.asc_nulls_first("_value"))
    ranked = dealt.join(blocks.where(holds[0] | holds[1]), [*by, "_block"])
    ranked = ranked.withColumn("_end", F.col("_carry") + F.sum("_c").over(ordered)).withColumn("_start", F.col("_end") - F.col("_c"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_value")))

    found = ranked.groupBy(*by).agg(value_at(F.floor("_rank")).alias("_a"), value_at(F.ceil("_rank")).alias("_b"))
    part = F.col("_rank") - F.floor("_rank")
    quantile = F.col("_a") + (F.col("_b") - F.col("_a")) * part
    missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
    return found.select(*keys, "probability", F.coalesce(quantile, missed).alias("quantile"))


def _wide_quantiles(values: DataFrame, keys: Sequence[str], names: dict[float, str]) -> DataFrame:
    found = exact_quantiles(values, keys, "value", list(names))
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for p, name in names.items()]
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of the numeric columns."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    values = _long_form(df, names)
    moments = values.groupBy("column_name").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = _wide_quantiles(values, ["column_name"], {0.25: "p25", 0.5: "p50", 0.75: "p75"})
    return moments.join(quartiles, "column_name")


def key_metric_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(word in c.lower() for word in K.KEY_METRIC_WORDS)]


def key_metrics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, median and sum of the columns whose names look like process metrics.

    Text that is no number is left out, as are columns without any number.
    """
    names = list(columns) if columns is not None else key_metric_columns(df.columns)
    values = _long_form(df, names)
    stats = values.groupBy("column_name").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.sum(F.col("value").cast("decimal(30,6)")).cast("double").alias("sum"),
    )
    median = _wide_quantiles(values, ["column_name"], {0.5: "median"})
    return stats.join(median, "column_name")


def head_rows(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(n)


def run_file_stats(results: DataFrame) -> DataFrame:
    """ok, skipped and error counts per file type (``ftype, ok, skipped_reason``)."""
    skipped = F.col("skipped_reason").isNotNull()
    return results.groupBy("ftype").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("ok") & ~skipped).alias("ok"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(~F.col("ok") & ~skipped).alias("errors"),
    )


def markdown_report(name: str, df: DataFrame, order: Sequence[str], max_rows: int = 50) -> str:
    """Markdown profile of a table. Everything is computed in Spark; the driver formats a few rows."""

    def grid(rows: list, columns: Sequence[str]) -> list[str]:
        body = ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows]
        return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body]

    profile = column_profile(df).orderBy("position").collect()
    total = profile[0]["row_count"] if profile else 0
    lines = [f"# {name}", "", f"- **Строк**: {total}, **Колонок**: {len(profile)}"]
    lines.append("- **Типы данных**: " + ", ".join(p["data_type"] for p in profile[:5]))
    lines += ["", "### Колонки", ""]
    lines += [f"{p['position']}. `{p['column_name']}` ({p['data_type']}) — {p['non_null']}/{total} непустых" for p in profile]
    lines += ["", f"### Данные (первые {min(max_rows, total)} строк)", ""]
    lines += grid(head_rows(df, order, max_rows).collect(), df.columns)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    if numeric:
        stats = describe(df, numeric)
        rounded = stats.select("column_name", *[F.bround(F.col(c).cast("double"), 3).alias(c) for c in stats.columns[1:]])
        lines += ["", "### Статистика", "", *grid(rounded.orderBy("column_name").collect(), rounded.columns)]
    named = key_metric_columns(df.columns)
    for row in key_metrics(df, named).orderBy("column_name").collect() if named else []:
        lines += ["", f"**Ключевая колонка**: `{row['column_name']}`"]
        labels = (("Мин", "min"), ("Макс", "max"), ("Среднее", "mean"), ("Медиана", "median"), ("Сумма", "sum"))
        lines += [f"- {label}: {row[key]:.3f}" for label, key in labels]
    lines += ["", f"*Источник: {name}*"]
    return "\n".join(lines)
