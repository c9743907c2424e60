"""Arithmetic of scores, and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.params import DEFAULT, Params


def clamp01(x: Column) -> Column:
    """MTH01."""
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """MTH02."""
    return 1 / (1 + F.exp(-x))


def distance_score(d: Column) -> Column:
    """MTH03."""
    return F.round(1 / (1 + F.greatest(d, F.lit(0.0))), 3)


def decay(age: Column, days: float) -> Column:
    """MTH04: an e-folding time, in spite of being called half-life elsewhere."""
    return F.exp(-F.greatest(age.cast("double"), F.lit(0.0)) / F.lit(max(float(days), 1.0)))


def support(entailment: Column, neutral: Column, weight: float = DEFAULT.neutral_weight) -> Column:
    """MTH05."""
    return clamp01(entailment + neutral * weight)


def band(score: Column) -> Column:
    """MTH06."""
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def jaccard(a: Column, b: Column) -> Column:
    """MTH07: of two arrays of different values; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """VEC01: 0 for empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)).otherwise(0.0)


def candidate_score(mentions: Column, hits: Column, p: Params = DEFAULT) -> Column:
    """AGG08: context weighs 0.6 and mentions 0.4; without a context gate, mentions alone give up to 0.6."""
    least = max(p.min_mentions, 1)
    m = F.least(F.lit(1.0), mentions / F.lit(float(least)))
    if p.min_context <= 0:
        return clamp01(F.least(F.lit(0.6), m * 0.6))
    c = F.least(F.lit(1.0), hits / F.lit(float(p.min_context)))
    return clamp01(c * 0.6 + m * 0.4)


def profile_confidence(snapshot: Column, customer: Column, guarantor: Column, high_risk: Column, fact_check: Column) -> Column:
    """AGG20: ``customer`` and ``guarantor`` are structs with four filled or empty fields besides the name, ``high_risk`` an array."""
    n = F.length(F.coalesce(snapshot, F.lit("")))

    def filled(party: Column) -> Column:
        fields = [F.coalesce((F.trim(party[f]) != "").cast("int"), F.lit(0)) for f in ("rating", "esg_scorecard", "new_director", "appointment_date")]
        return sum(fields[1:], fields[0])

    c, g = filled(customer), filled(guarantor)
    s = (
        F.lit(0.2) + F.when(n >= 400, 0.3).when(n >= 200, 0.2).when(n >= 80, 0.1).otherwise(0.0)
        + F.when(c >= 3, 0.3).when(c >= 1, 0.2).otherwise(0.0) + F.when(g >= 1, 0.1).otherwise(0.0)
        + F.when(F.size(high_risk) >= 1, 0.2).otherwise(0.0)
    )
    s = F.when(fact_check.isNotNull(), s * (0.6 + 0.4 * clamp01(fact_check))).otherwise(s)
    return F.greatest(F.least(s, F.lit(0.95)), F.lit(0.0))
