"""Forgetting curves and their relatives as Column expressions of elapsed time. Hours and days are doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .confidence import _c, clamp

# Fixed values of the memory model.
TAU_HOURS, BETA, HYBRID_TAU, HYBRID_BETA, HYBRID_SPLIT_HOURS = 1.96, 0.18, 0.8, 0.25, 24.0
NEO_ALPHA, NEO_BETA, NEO_SCALE, PERMASTORE_DAYS, PERMASTORE, NEO_FLOOR = 1.0, 0.3, 0.2, 1095.0, 0.3, 0.01
MIN_CONFIDENCE = 0.1


def exponential(a, hours, tau: float = TAU_HOURS) -> Column:
    return _c(a) * F.exp(-_c(hours) / tau)


def power_law(a, hours, beta: float = BETA) -> Column:
    return _c(a) * F.pow(1 + _c(hours), F.lit(-beta))


def hybrid(a, hours, tau: float = HYBRID_TAU, beta: float = HYBRID_BETA, split: float = HYBRID_SPLIT_HOURS) -> Column:
    return F.when(_c(hours) < split, exponential(a, hours, tau)).otherwise(power_law(a, hours, beta))


def hippocampal_retention(hours, individual=1.0, salience=1.0, recent=1.0, theta=None) -> Column:
    tau = TAU_HOURS * _c(individual) * _c(salience) * _c(recent)
    if theta is not None:
        tau = tau * theta_modulation(theta)
    return F.exp(-_c(hours) / tau)


def neocortical_retention(days, overlap=0.0, alpha: float = NEO_ALPHA, beta: float = NEO_BETA) -> Column:
    r = alpha * F.pow(1 + _c(days), -beta / (1 + NEO_SCALE * _c(overlap)))
    old = (_c(days) > PERMASTORE_DAYS) & (r > PERMASTORE)
    return F.when(old, F.greatest(r, F.lit(PERMASTORE))).otherwise(F.greatest(r, F.lit(NEO_FLOOR)))


def neocortical(a, days, overlap=0.6, boost=1.0) -> Column:
    return clamp(F.greatest(_c(a) * neocortical_retention(days, overlap) * F.least(_c(boost), F.lit(1.5)), F.lit(PERMASTORE)))


def two_component(a, hours, access_count, threshold: int = 3, overlap: float = 0.6) -> Column:
    """Often-recalled memories decay as neocortical ones, others as hippocampal."""
    return F.when(_c(access_count) >= threshold, neocortical(a, _c(hours) / 24, overlap)).otherwise(_c(a) * hippocampal_retention(hours))


def half_life_days(beta) -> Column:
    return F.pow(F.lit(2.0), 1 / _c(beta)) - 1


def lazy(a, hours, access_count, kind: Column | None = None, floor: float = MIN_CONFIDENCE) -> Column:
    """A row's own curve (or the default, two components), calibrated for the default person, not below the floor."""
    default = two_component(a, hours, access_count)
    if kind is not None:
        default = (
            F.when(kind == "exponential", exponential(a, hours)).when(kind == "power_law", power_law(a, hours))
            .when(kind == "hybrid", hybrid(a, hours)).otherwise(default)
        )
    calibrated = default * F.when(default > 0.7, 0.965).otherwise(1.005)
    return clamp(F.greatest(calibrated, F.lit(floor)))


def predicted_retention(hours, age_days) -> Column:
    w = F.least(_c(age_days) / 365, F.lit(1.0))
    return hippocampal_retention(hours) * (1 - w) + neocortical_retention(_c(hours) / 24) * w


def memory_blend(a, hours, age_days, has_content: Column) -> Column:
    w = F.least(_c(age_days) / 365, F.lit(1.0))
    overlap = F.when(has_content, 0.7).otherwise(0.3)
    return clamp(_c(a) * (hippocampal_retention(hours) * (1 - w) + neocortical_retention(_c(hours) / 24, overlap) * w))


def episode_blend(a, hours, age_days, vividness) -> Column:
    """Transfer over three years; vivid episodes (above .7) overlap more with what is known."""
    w = F.least(_c(age_days) / PERMASTORE_DAYS, F.lit(1.0))
    overlap = F.when(_c(vividness) > 0.7, 0.8).otherwise(0.2)
    return clamp(_c(a) * (hippocampal_retention(hours) * (1 - w) + neocortical_retention(_c(hours) / 24, overlap) * w))


def forgetting(a, hours, rate=0.05) -> Column:
    return clamp(_c(a) * F.exp(-_c(hours) * _c(rate)))


def episode_forgetting(encoding, vividness, reliability, hours, rate=0.05) -> tuple[Column, Column, Column]:
    """Vividness goes faster (x .8), reliability slower than it (x .9)."""
    f = F.exp(-_c(hours) * _c(rate))
    return clamp(_c(encoding) * f), clamp(_c(vividness) * f * 0.8), clamp(_c(reliability) * f * 0.9)


def remerge(encoding, reliability, age_days) -> Column:
    w = F.least(_c(age_days) / PERMASTORE_DAYS, F.lit(1.0))
    return clamp(_c(encoding) * (1 - w) + _c(reliability) * w)


def ssts_retention(retrievability, stability, days) -> Column:
    return clamp(F.pow(_c(retrievability), _c(days) / _c(stability)), 0.01, 0.99)


def ssts_fold(events: Column, s0: float = 1.0, d0: float = 5.0, lr: float = 0.1) -> Column:
    """Stability, retrievability and difficulty after an ordered array of struct<success, effort, confidence>."""

    def step(x: Column, e: Column) -> Column:
        ok = e["success"]
        s = F.when(ok, x["s"] + x["d"] * (1 + lr) * (1 + 0.9 * (e["effort"] - 1))).otherwise(x["s"] * 0.95)
        r = F.when(ok, 0.9 + 0.08 * e["confidence"]).otherwise(F.lit(0.1))
        d = F.when(ok, x["d"]).otherwise(x["d"] * 1.15)
        return F.struct(s.alias("s"), r.alias("r"), d.alias("d"))

    return F.aggregate(events, F.struct(F.lit(s0).alias("s"), F.lit(0.9).alias("r"), F.lit(d0).alias("d")), step)


def optimal_interval_days(stability, retrievability) -> Column:
    return clamp(_c(stability) * F.abs(F.ln(F.lit(0.9)) / F.ln(_c(retrievability))), 0.1, 365.0)


def spacing_interval(days, success: Column) -> Column:
    return F.when(success, _c(days) * 2.5).otherwise(1.0)


def testing_effect(strength, success: Column) -> Column:
    return clamp(F.when(success, _c(strength) * 1.3).otherwise(_c(strength) * 0.8))


def record_recalls(reliability, recalls: Column) -> Column:
    """Every third recall moves reliability by a twentieth towards .05."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(recalls, F.lit(1))), _c(reliability), lambda r, i: F.when((i % 3 == 0) & (i <= recalls), 0.95 * r + 0.05 * 0.05).otherwise(r))


def interference_strength(similarity, proactive: float = 0.8, retroactive: float = 1.2) -> Column:
    return _c(similarity) * (proactive + retroactive) / 2


def theta_modulation(phase) -> Column:
    return 1 + 0.1 * F.sin(2 * math.pi * _c(phase))


def ripple(value: Column, mean_above: float = 0.3, least: int = 5) -> Column:
    """An aggregate: a group shows a ripple."""
    return (F.count(value) >= least) & (F.avg(value) > mean_above) & (F.avg(value) < 0.7) & (F.var_pop(value) > 0.1)


def should_consolidate(value: Column, threshold: float = 0.3) -> Column:
    return ripple(value, threshold, 10)


def hippocampal_tau(tau, h, a, w, p, age) -> Column:
    return _c(tau) * (0.3 * _c(h) + 0.2 * _c(a) + 0.25 * _c(w) + 0.25 * _c(p)) * _c(age)


def neocortical_tau(tau, s, a, f, n, age) -> Column:
    return _c(tau) * (0.25 * _c(s) + 0.2 * _c(a) + 0.3 * _c(f) + 0.25 * _c(n)) * _c(age)
