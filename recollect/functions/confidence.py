"""Confidence algebra: probabilities in [0, 1] as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


exact = clamp


def from_successes(successes, total) -> Column:
    s, n = _c(successes), _c(total)
    return F.when(n == 0, 0.0).otherwise(clamp(s / F.when(n == 0, 1.0).otherwise(n)))


def from_percent(percent) -> Column:
    return F.least(_c(percent), F.lit(100.0)) / 100


def and_(a, b) -> Column:
    return clamp(_c(a) * _c(b))


def or_(a, b) -> Column:
    return clamp(_c(a) + _c(b) - _c(a) * _c(b))


def not_(a) -> Column:
    return 1 - _c(a)


def combine_weighted(a, b, wa, wb) -> Column:
    w = _c(wa) + _c(wb)
    return F.when(w == 0, 0.5).otherwise(clamp((_c(a) * _c(wa) + _c(b) * _c(wb)) / F.when(w == 0, 1.0).otherwise(w)))


def decayed(a, rate, hops) -> Column:
    return clamp(_c(a) * F.exp(-_c(rate) * _c(hops)))


def scaled(a, factor) -> Column:
    return clamp(_c(a) * clamp(factor))


def calibrate_overconfidence(a) -> Column:
    a = _c(a)
    return F.when(a > 0.8, a * 0.85).when(a > 0.6, a * 0.9).otherwise(a)


def update_with_base_rate(a, base) -> Column:
    """Bayes with a base rate; where both hypotheses are impossible the confidence stays."""
    a, b = _c(a), _c(base)
    d = a * b + (1 - a) * (1 - b)
    return F.when(d == 0, a).otherwise(clamp(a * b / F.when(d == 0, 1.0).otherwise(d)))


def bucket(a) -> Column:
    a = _c(a)
    return F.when(a >= 0.7, "high").when(a <= 0.3, "low").otherwise("medium")


def seems_legitimate(a) -> Column:
    return _c(a) >= 0.6


def seems_questionable(a) -> Column:
    return _c(a) <= 0.4


# Intervals: struct<lower, point, upper, width> ---------------------------------------------------------------------


def _interval(lower: Column, point: Column, upper: Column, width: Column) -> Column:
    return F.struct(lower.alias("lower"), point.alias("point"), upper.alias("upper"), width.alias("width"))


def interval(point, uncertainty) -> Column:
    p = _c(point)
    half = F.least(_c(uncertainty) * p, p, 1 - p)
    return _interval(p - half, p, p + half, 2 * half)


def interval_contains(i: Column, x) -> Column:
    return (_c(x) >= i["lower"]) & (_c(x) <= i["upper"])


def interval_overlaps(i: Column, j: Column) -> Column:
    return (i["lower"] <= j["upper"]) & (j["lower"] <= i["upper"])


def _both(i: Column, j: Column, how) -> Column:
    lower, upper = how(i["lower"], j["lower"]), how(i["upper"], j["upper"])
    return _interval(lower, how(i["point"], j["point"]), upper, upper - lower)


def interval_and(i: Column, j: Column) -> Column:
    return _both(i, j, and_)


def interval_or(i: Column, j: Column) -> Column:
    return _both(i, j, or_)


def interval_not(i: Column) -> Column:
    return _interval(1 - i["upper"], 1 - i["point"], 1 - i["lower"], i["width"])


def category(point, width) -> Column:
    p, w = _c(point), _c(width)
    return F.when((p >= 0.8) & (w < 0.1), "high").when((p >= 0.6) & (w < 0.2), "medium").when((p >= 0.3) & (w < 0.3), "low").otherwise("very_uncertain")


# Confidence in metrics, tiers and the two kinds of memory -------------------------------------------------------------


def weighted_distance(distance, a, b) -> Column:
    return _c(distance) * (1 - _c(a) * _c(b))


def temporal_boost(a, age_seconds, boost) -> Column:
    return clamp(_c(a) * (1 + _c(boost) * F.exp(-_c(age_seconds) / 3600)))


def diversity_weighted(confidence: Column, diversity: Column) -> Column:
    """An aggregate."""
    w = F.greatest(diversity, F.lit(0.1))
    return F.sum(confidence * w) / F.sum(w)


def adjust_for_tier(a, tier: Column, days) -> Column:
    factor = F.when(tier == "hot", 1.0).when(tier == "warm", 0.95).otherwise(0.9)
    return clamp(_c(a) * factor * F.pow(F.lit(0.5), _c(days) / 3650), 0.01, 1.0)


def episode_confidence(encoding, reliability, vividness, decay) -> Column:
    return clamp((0.5 * _c(encoding) + 0.3 * _c(reliability) + 0.2 * _c(vividness)) * 0.9 * (1 - _c(decay)))


def concept_confidence(encoding, reliability, vividness, coherence) -> Column:
    """An aggregate over a concept's episodes."""
    return clamp(F.avg((_c(encoding) + _c(reliability) + _c(vividness)) / 3) * 0.9 * coherence)


def through_binding(a, strength) -> Column:
    return clamp(_c(a) * _c(strength) * 0.95)


def blend(episodic, semantic, we, ws) -> Column:
    e, s = _c(episodic), _c(semantic)
    mixed = combine_weighted(e, s, we, ws)
    return clamp(F.when((e > 0.5) & (s > 0.5), F.least(mixed * 1.1, F.greatest(e, s) * 1.1)).otherwise(mixed))


def budget_left(cost: Column, total: float, window) -> Column:
    """Whether a consumer still fits into a budget that earlier ones of the window have drawn on."""
    return F.sum(cost).over(window) <= total
