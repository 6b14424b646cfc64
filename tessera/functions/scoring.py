"""Scores from distances, and grades from scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The curves' ends, coefficients and grade names.
QUALITY_GRADES = ("Very Poor", "Poor", "Moderate", "Good", "Excellent")
PRIVACY_GRADES = ("Poor", "Moderate", "Good", "Very Good", "Excellent")


def tabular_js_score(d: Column) -> Column:
    return F.when(d > 0.99, 0.0).when(d < 0.02, 10.0).otherwise(7.44 * d * d - 16.646 * d + 10.305)


def text_js_score(d: Column) -> Column:
    return F.when(d > 0.8, 1.5).when(d < 0.12, 10.0).otherwise(-12.5 * d + 11.5)


def correlation_score(e: Column) -> Column:
    return F.when(e > 0.46, 0.0).when(e < 0.01, 10.0).otherwise(37.562 * e * e - 35.643 * e + 10.056)


def structure_score(d: Column) -> Column:
    return 10.0 * F.exp(-1.6 * d)


def final_score(raw: Column) -> Column:
    """One decimal, from 0 to 10."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.bround(raw, 1)))


def grade(score: Column, names: tuple[str, ...] = QUALITY_GRADES) -> Column:
    """Two points of score a grade."""
    return F.element_at(F.array(*map(F.lit, names)), F.least(F.floor(score / 2).cast("int"), F.lit(len(names) - 1)) + 1)


def quality_score(correlation: Column, structure: Column, distribution: Column) -> Column:
    """Weighted mean of the scores that are present, to three decimals."""
    parts = ((structure, 0.84), (distribution, 0.86), (correlation, 1.0))
    weighted = sum(F.coalesce(s * w, F.lit(0.0)) for s, w in parts)
    weight = sum(F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts)
    return F.bround(weighted / F.nullif(weight, F.lit(0.0)), 3)


def text_quality_score(semantic: Column, structure: Column) -> Column:
    parts = ((semantic, 0.7), (structure, 0.3))
    weighted = sum(F.coalesce(s * w, F.lit(0.0)) for s, w in parts)
    weight = sum(F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts)
    return weighted / F.nullif(weight, F.lit(0.0))


def mean_of_nonzero(*scores: Column) -> Column:
    """A score of zero counts as absent."""
    kept = F.filter(F.array(*scores), lambda s: s.isNotNull() & (s != 0))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, s: a + s) / F.size(kept))


def attack_grade(precision: Column, accuracy: Column) -> Column:
    """How well members stay hidden from one attack: 3 (best) to 1."""
    less, more = F.least(precision, accuracy), F.greatest(precision, accuracy)
    return F.when(more <= 0.5, 3.0).when((less <= 0.5) & (more <= 0.8), 2.5).when(more <= 0.8, 2.0).when(less <= 0.8, 1.5).otherwise(1.0)
