"""Greedy improvement of metric vectors, one independent run per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.scoring import variant_score
from oreweave.functions.vectors import clamp

METRICS = list(K.VARIANT_WEIGHTS)
ACTIONS = [name for name, _ in K.IMPROVEMENT_ACTIONS]
RISK = "implementation_risk"


def _step_size(metric: str, delta: float, value: Column) -> Column:
    """Undamped change of a metric: proportional to its headroom, or to the risk that is left."""
    room = value if metric == RISK else F.lit(1.0) - value
    return F.lit(abs(delta)) * F.greatest(room, F.lit(0.02))


def _gains(state: Column, iteration: Column, number: Column) -> Column:
    """Weighted gain of every action, with a rotating tie break."""
    gains = []
    for index, (_, deltas) in enumerate(K.IMPROVEMENT_ACTIONS):
        gain = F.lit(0.0)
        for metric, delta in deltas.items():
            gain = gain + F.lit(abs(K.VARIANT_WEIGHTS[metric])) * _step_size(metric, delta, state[metric])
        tie = ((iteration + index + number) % len(K.IMPROVEMENT_ACTIONS)) * F.lit(0.000001)
        gains.append(gain + tie)
    return F.array(*gains)


def _apply(state: Column, choice: Column, iteration: Column) -> Column:
    damping = F.lit(1.0) / (F.lit(1.0) + (iteration - 1) / F.lit(35.0))
    fields = []
    for metric in METRICS:
        value = state[metric]
        out = value
        for index, (_, deltas) in enumerate(K.IMPROVEMENT_ACTIONS):
            if metric in deltas:
                change = _step_size(metric, deltas[metric], value) * damping
                moved = clamp(value - change if metric == RISK else value + change)
                out = F.when(choice == index, moved).otherwise(out)
        fields.append(out.alias(metric))
    return F.struct(*fields, choice.cast("int").alias("action"))


def _best(gains: Column) -> Column:
    return (F.array_position(gains, F.array_max(gains)) - 1).cast("int")


def improve(df: DataFrame, number: str, iterations: int = 100, trace: bool = False) -> DataFrame:
    """Run ``iterations`` greedy steps on the six metric columns of every row.

    Each step applies the action with the largest gain. The steps of a row depend on each
    other, the rows do not, so the whole run is a fold inside the row: no shuffle and no
    driver loop. ``trace`` returns one row per step instead of the final metrics.
    """
    start = F.struct(*[F.col(m).cast("double").alias(m) for m in METRICS], F.lit(-1).alias("action"))

    def advance(state: Column, i: Column) -> Column:
        # one-element transform: the gains are computed once and used twice
        choice = F.get(F.transform(F.array(_gains(state, i, F.col(number))), _best), F.lit(0))
        return F.get(F.transform(F.array(choice), lambda c: _apply(state, c, i)), F.lit(0))

    steps = F.sequence(F.lit(1), F.lit(iterations))
    if not trace:
        final = F.aggregate(steps, start, advance)
        return df.withColumn("_final", final).select(
            *[c for c in df.columns if c not in METRICS],
            variant_score({m: F.col(m) for m in METRICS}).alias("start_score"),
            *[F.col(f"_final.{m}").alias(m) for m in METRICS],
            variant_score({m: F.col(f"_final.{m}") for m in METRICS}).alias("final_score"),
        )
    history = F.aggregate(
        steps, F.array(start), lambda acc, i: F.concat(acc, F.array(advance(F.element_at(acc, -1), i)))
    )
    keep = [c for c in df.columns if c not in METRICS]
    rows = df.withColumn("_h", history).select(*keep, "_h", F.explode(steps).alias("iteration"))
    now, before = F.get("_h", F.col("iteration")), F.get("_h", F.col("iteration") - 1)
    score = {name: variant_score({m: side[m] for m in METRICS}) for name, side in (("after", now), ("before", before))}
    return rows.select(
        *keep,
        "iteration",
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), now["action"] + 1).alias("action"),
        score["before"].alias("before_score"),
        score["after"].alias("after_score"),
        (score["after"] - score["before"]).alias("score_delta"),
        *[now[m].alias(m) for m in METRICS],
    )


def variants(spark, rows: Sequence[tuple] = tuple(K.VARIANT_METRICS)) -> DataFrame:
    """The architecture variants with the number used by the tie break."""
    schema = "variant_id string, " + ", ".join(f"{m} double" for m in METRICS)
    table = spark.createDataFrame([tuple(r) for r in rows], schema)
    return table.withColumn("number", F.substring("variant_id", 2, 10).cast("int"))
