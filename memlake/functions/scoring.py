"""Score arithmetic: merging modalities, decay, importance and domain ranking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
WEIGHTS = {"vector": 0.5, "fulltext": 0.3, "graph": 0.2}


def merge_scores(scores: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS, penalize_missing: bool = True) -> Column:
    """Weighted mean of modality scores.

    A missing (null) modality counts as 0 in the sum; it stays in the divisor if ``penalize_missing``
    (hybrid search), else only present modalities do.  A divisor of 0 or less gives 0.
    """
    total = sum((F.coalesce(scores[m] * F.lit(weights[m]), F.lit(0.0)) for m in scores), F.lit(0.0))
    if penalize_missing:
        divisor = F.lit(float(sum(weights[m] for m in scores)))
    else:
        divisor = sum((F.when(scores[m].isNotNull(), F.lit(weights[m])).otherwise(F.lit(0.0)) for m in scores), F.lit(0.0))
    return F.when(divisor > 0, total / divisor).otherwise(F.lit(0.0))


def decay(weight: Column, since_ms: Column, now_ms: int, rate: float) -> Column:
    """weight * e^(-rate * hours); a weight of 0 stays 0."""
    hours = (F.lit(now_ms) - since_ms) / F.lit(float(HOUR_MS))
    return F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.exp(-F.lit(rate) * hours))


def importance(given: Column, kind: Column, age_ms: Column, defaults: Mapping[str, float], factor: float = 0.95, fallback: float = 0.5) -> Column:
    """Base importance, by class where none is given, times factor^(days / 30)."""
    table = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    base = F.coalesce(given, F.element_at(table, kind) if defaults else F.lit(None), F.lit(fallback))
    return base * F.pow(F.lit(factor), age_ms / F.lit(float(DAY_MS)) / 30.0)


def domain_rank(score: Column, valid: Column, weight: Column) -> Column:
    """x 0.05 for an entry that is no longer valid, else x (1 + (importance - 0.5) / 2)."""
    return F.when(~F.coalesce(valid, F.lit(True)), score * 0.05).otherwise(score * (1 + (weight - 0.5) * 0.5))


def idf(documents: Column, frequency: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1."""
    return F.log((documents + 1) / (frequency + 1)) + 1


def temporal_weight(delta_ms: Column, tau_ms: float | None) -> Column:
    """e^(-dt / tau), 1 where no scale is set."""
    if not tau_ms:
        return F.lit(1.0)
    return F.exp(-F.greatest(delta_ms, F.lit(0)) / F.lit(float(tau_ms)))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
