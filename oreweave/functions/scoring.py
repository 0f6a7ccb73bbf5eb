"""Weighted-score expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.text import any_contains
from oreweave.functions.vectors import clamp


def weighted_score(scores: Mapping[str, Column], weights: Mapping[str, float] = K.SCORE_WEIGHTS) -> Column:
    """Weighted mean of the positive components minus the risk penalty, clamped to 0..1."""
    positive = [name for name in weights if name != "risk"]
    total = F.lit(0.0)
    for name in positive:
        total = total + F.lit(weights[name]) * scores[name]
    normalizer = max(1e-9, sum(weights[name] for name in positive))
    return clamp((total - F.lit(weights["risk"]) * scores["risk"]) / F.lit(normalizer))


def component_scores(
    change: Column,
    evidence_count: Column,
    chain_length: Column,
    generator: Column,
    tonnes: Column,
    max_tonnes: Column,
) -> dict[str, Column]:
    """The eight component scores of a proposed change."""
    low = F.lower(change)
    existing = any_contains(low, K.EXISTING_EQUIPMENT_WORDS)
    capex = any_contains(low, K.HIGH_CAPEX_WORDS)
    kpi = F.least(F.lit(1.0), tonnes / F.greatest(F.lit(1.0), max_tonnes))
    risk = F.lit(0.35) + F.when(capex, 0.25).otherwise(0.0) - F.when(existing, 0.10).otherwise(0.0)
    return {
        "kpi_impact": kpi,
        "feasibility": F.when(existing, 0.85).when(capex, 0.55).otherwise(0.70),
        "evidence_strength": F.least(F.lit(1.0), F.lit(0.25) + F.lit(0.15) * evidence_count),
        "causal_consistency": F.when(chain_length >= 4, 0.90).otherwise(0.55),
        "novelty": F.when(generator != "expert_seed", 0.65).otherwise(0.35),
        "business_value": F.least(F.lit(1.0), F.lit(0.35) + kpi * 0.65),
        "implementability": F.when(existing, 0.85).otherwise(0.55),
        "risk": F.greatest(F.lit(0.05), F.least(F.lit(1.0), risk)),
    }


def variant_score(metrics: Mapping[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in K.VARIANT_WEIGHTS.items():
        total = total + F.lit(weight) * metrics[name]
    return clamp(total)
