"""Scoring, validation and quality of candidate changes.

Candidate columns: id, title, hypothesis_text, proposed_change, target_plant, target_stream,
target_size_class, target_element, causal_chain, evidence (array of evidence structs),
validation_steps, warnings (array), risks (array), generator, position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.scoring import component_scores, weighted_score
from oreweave.functions.text import any_contains, first_number_above
from oreweave.functions.vectors import clamp
from oreweave.operators.dedupe import top_n


def validation_warnings(
    text: Column,
    evidence_count: Column,
    chain_length: Column,
    step_count: Column,
    forbidden: Sequence[str] = (),
    unavailable: Sequence[str] = (),
    no_capex: bool = False,
) -> Column:
    """Array of the warnings a candidate earns, in rule order."""
    low = F.lower(text)
    rules = [
        *[F.when(F.contains(low, F.lit(e.lower())), F.lit(f"Запрещенный элемент в гипотезе: {e}")) for e in forbidden],
        *[F.when(F.contains(low, F.lit(e.lower())), F.lit(f"Недоступное оборудование: {e}")) for e in unavailable],
        F.when(
            F.lit(no_capex) & any_contains(low, K.NO_CAPEX_WORDS),
            "Ограничение no_capex: гипотеза требует капитального изменения или нового узла.",
        ),
        F.when(evidence_count == 0, "Нет evidence-фрагментов."),
        F.when(chain_length < 3, "Недостаточно полная причинная цепочка."),
        F.when(step_count == 0, "Нет плана проверки."),
    ]
    return F.array_compact(F.array(*rules))


def validate(candidates: DataFrame, **constraints) -> DataFrame:
    text = F.concat_ws(" ", "title", "hypothesis_text", "proposed_change")
    found = validation_warnings(
        text, F.size("evidence"), F.size("causal_chain"), F.size("validation_steps"), **constraints
    )
    return candidates.withColumn("warnings", F.concat("warnings", found))


def target_tonnes(evidence: Column) -> Column:
    """First number above 10 over the evidence texts, in order; 100 when there is none."""
    numbers = F.array_compact(F.transform(evidence, lambda e: first_number_above(e["text"])))
    return F.coalesce(F.get(numbers, F.lit(0)), F.lit(100.0))


def rank(candidates: DataFrame, weights: Mapping[str, float] = K.SCORE_WEIGHTS) -> DataFrame:
    """Component scores, final score and a stable ranking by it.

    The largest tonnage is one scalar of the whole table, not a window over it.
    """
    sized = candidates.withColumn("target_tonnes", target_tonnes(F.col("evidence")))
    largest = F.coalesce(sized.agg(F.max("target_tonnes")).scalar(), F.lit(1.0))
    scores = component_scores(
        F.col("proposed_change"), F.size("evidence"), F.size("causal_chain"), F.col("generator"),
        F.col("target_tonnes"), F.greatest(largest, F.lit(1.0)),
    )
    scored = sized.select("*", *[c.alias(name) for name, c in scores.items()])
    final = weighted_score({name: F.col(name) for name in scores}, weights)
    return scored.withColumn("final_score", final).orderBy(F.desc("final_score"), "position")


def reflect(candidates: DataFrame) -> DataFrame:
    """Warnings for thin evidence and a missing size class, a risk note for capital changes."""
    needs_class = ~F.col("generator").isin("analogy", "prediction_guided", "expert_seed")
    no_class = F.coalesce("target_size_class", F.lit("")) == ""
    notes = F.array_compact(
        F.array(
            F.when(F.size("evidence") < 2, "Reflection agent: weak evidence pack, needs stronger source support."),
            F.when(no_class & needs_class, "Reflection agent: no target size class."),
        )
    )
    capex = any_contains(F.lower("proposed_change"), K.REVIEW_CAPEX_WORDS)
    risk = F.when(capex, F.array(F.lit("Reflection agent: проверить CapEx, сроки монтажа и влияние на простои."))).otherwise(
        F.array().cast("array<string>")
    )
    return candidates.withColumn("warnings", F.concat("warnings", notes)).withColumn("risks", F.concat("risks", risk))


def diversify(candidates: DataFrame, per_bucket: int = 2) -> DataFrame:
    """At most two candidates per plant, size class and generator.

    ``bucket_position`` is where the bucket was first seen: the review lists bucket by bucket.
    """
    bucket = ["target_plant", "target_size_class", "generator"]
    kept = top_n(candidates, bucket, [F.asc("position")], per_bucket)
    return kept.withColumn("bucket_position", F.min("position").over(Window.partitionBy(*bucket)))


def size_class_order(size_classes: DataFrame, n: int = 8) -> DataFrame:
    """The n heaviest size classes by their larger element tonnage."""
    heaviest = F.greatest(F.coalesce("element28_tonnes", F.lit(0.0)), F.coalesce("element29_tonnes", F.lit(0.0)))
    return size_classes.withColumn("priority", heaviest).orderBy(F.desc("priority"), "plant", "stream", "size_class").limit(n)


def richest(records: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The record with the largest sum of both element tonnages, per group when keys are given."""
    total = F.coalesce("element28_tonnes", F.lit(0.0)) + F.coalesce("element29_tonnes", F.lit(0.0))
    scored = records.withColumn("total_tonnes", total)
    ordered = [F.desc("total_tonnes"), *[F.asc(c) for c in order]]
    return top_n(scored, list(keys), ordered, 1) if keys else scored.orderBy(*ordered).limit(1)


def profile_quality(candidates: DataFrame, max_hypotheses: int, record_count: int) -> DataFrame:
    """Quality metrics of a ranked candidate list, in one aggregation."""

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    metrics = candidates.agg(
        F.count("*").alias("hypotheses"),
        F.avg("final_score").alias("avg_final_score"),
        share(F.size("evidence") > 0).alias("evidence_coverage"),
        share(F.size("causal_chain") >= 4).alias("causal_coverage"),
        share(F.size("warnings") > 0).alias("warning_rate"),
        (F.count_distinct("generator") / 6.0).alias("generator_diversity"),
    ).withColumn("corpus_use", F.lit(min(1.0, record_count / 60.0))).withColumn(
        "hypothesis_breadth", F.least(F.lit(1.0), F.col("hypotheses") / F.lit(max(1, max_hypotheses)))
    )
    return with_quality(metrics)


def with_quality(metrics: DataFrame) -> DataFrame:
    total = F.lit(0.0)
    for name, weight in K.PROFILE_QUALITY_WEIGHTS.items():
        total = total + F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
    quality = F.when(F.col("hypotheses") == 0, F.lit(0.0)).otherwise(clamp(total))
    rounded = [F.bround(F.col(n), 6).alias(n) for n in K.PROFILE_QUALITY_WEIGHTS]
    return metrics.select(
        *[c for c in metrics.columns if c not in K.PROFILE_QUALITY_WEIGHTS], *rounded, F.bround(quality, 6).alias("quality_score")
    )
