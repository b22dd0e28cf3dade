"""Probabilistic results: episodes with confidences, an interval over them, and the algebra of results.

A result is a DataFrame with a row for each episode (id, confidence, ...). Its interval is an aggregate; evidence and uncertainty
are DataFrames beside it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import confidence as C


def interval_of(df: DataFrame, keys: list[str] | None = None, confidence: str = "confidence") -> DataFrame:
    """Mean and population deviation as an interval; n rows. An empty result has the point 0."""
    mean, sd = F.coalesce(F.avg(confidence), F.lit(0.0)), F.coalesce(F.stddev_pop(confidence), F.lit(0.0))
    own = df.groupBy(*(keys or [])).agg(mean.alias("point"), sd.alias("deviation"), F.count(F.lit(1)).alias("n"))
    lower, upper = C.clamp(F.col("point") - F.col("deviation")), C.clamp(F.col("point") + F.col("deviation"))
    return own.withColumns({"lower": lower, "upper": upper, "width": upper - lower})


@dataclass
class Result:
    episodes: DataFrame
    interval: DataFrame
    evidence: DataFrame | None = None
    uncertainty: DataFrame | None = None

    @classmethod
    def of(cls, episodes: DataFrame, evidence: DataFrame | None = None, uncertainty: DataFrame | None = None) -> Result:
        return cls(episodes, interval_of(episodes), evidence, uncertainty)

    def and_(self, other: Result) -> Result:
        """Episodes of both, with the left confidence; interval AND."""
        return Result(intersect(self.episodes, other.episodes), _pair(self.interval, other.interval, C.interval_and), _bag(self.evidence, other.evidence))

    def or_(self, other: Result) -> Result:
        return Result(union(self.episodes, other.episodes), _pair(self.interval, other.interval, C.interval_or), _bag(self.evidence, other.evidence))

    def not_(self) -> Result:
        """The same episodes; the interval negated."""
        i = C.interval_not(F.struct("lower", "point", "upper", "width"))
        return Result(self.episodes, self.interval.select(i.alias("i")).select("i.*"), self.evidence)

    def combine(self, other: Result) -> Result:
        return Result.of(combine(self.episodes, other.episodes), _bag(self.evidence, other.evidence))

    def above(self, threshold: float) -> Result:
        """Episodes from a threshold on; the interval anew, at least .05 wide."""
        kept = self.episodes.where(F.col("confidence") >= threshold)
        again = interval_of(kept)
        return Result(kept, again.withColumn("width", F.greatest("width", F.lit(0.05))), self.evidence)


def _pair(a: DataFrame, b: DataFrame, how) -> DataFrame:
    """Two one-row tables into one."""
    fields = ["lower", "point", "upper", "width"]
    x, y = a.select(F.struct(*fields).alias("a")), b.select(F.struct(*fields).alias("b"))
    return x.join(y).select(how(F.col("a"), F.col("b")).alias("i")).select("i.*")


def _bag(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return a if b is None else b if a is None else a.unionByName(b, allowMissingColumns=True)


def intersect(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def union(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """All of a, and of b what a lacks."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"))


def minus(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def combine(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Each id once, the first side's row first."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_side")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_side", "_n")


def dedup(a: DataFrame, key: str = "id") -> DataFrame:
    return a.dropDuplicates([key])


# Evidence ---------------------------------------------------------------------------------------------------------------


def _noisy_or(p: Column) -> Column:
    """An aggregate: 1 - prod(1 - p), by logarithms; a certain path makes it 1."""
    return 1 - F.exp(F.sum(F.ln(F.greatest(1 - p, F.lit(1e-300)))))


def noisy_or_paths(paths: DataFrame, key: str, rate: float = 0.35, most: int = 8, least: float = 0.001) -> DataFrame:
    """p = confidence * weight * tier factor * exp(-rate * hops); per key the best `most` of those from `least` on; noisy OR."""
    p = F.col("confidence") * F.col("weight") * F.col("tier_factor") * F.exp(-rate * F.col("hops"))
    w = Window.partitionBy(key).orderBy(F.desc("p"), "path_id")
    top = paths.withColumn("p", C.clamp(p)).where(F.col("p") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.groupBy(key).agg(_noisy_or(F.col("p")).alias("confidence"), F.count(F.lit(1)).alias("n_paths"), F.least(F.stddev_pop("p"), F.lit(0.3)).alias("diversity"))


def aggregate_evidence(evidence: DataFrame, key: str, least: float = 0.01, most: int = 10) -> DataFrame:
    """Noisy OR of independent evidence if there is any, else of the dependent; the strongest `most`."""
    own = evidence.where(F.col("strength") >= least).withColumn("free", F.size("dependencies") == 0)
    any_free = F.max(F.col("free").cast("int")).over(Window.partitionBy(key))
    w = Window.partitionBy(key).orderBy(F.desc("strength"), "evidence_id")
    used = own.withColumn("any_free", any_free).where((F.col("any_free") == 0) | F.col("free")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return used.groupBy(key).agg(_noisy_or(F.col("strength")).alias("confidence"), F.count(F.lit(1)).alias("n_used"))


def odds_fold(evidence: DataFrame, key: str, prior: float = 0.5) -> DataFrame:
    """Bayes by odds, in time order; an odds that is not finite falls back to .6 of the state and .4 of the evidence."""

    def step(p: Column, e: Column) -> Column:
        s = e["strength"]
        odds = F.try_divide(p, 1 - p) * F.try_divide(s, 1 - s)
        return F.when(odds.isNull() | F.isnan(odds), 0.6 * p + 0.4 * s).otherwise(odds / (1 + odds))

    # Odds multiply, so the order does not matter and their logarithms are summed; where some strength is no odds (0 or 1), the key's
    # evidence is folded in its order, in one row.
    log_odds = F.ln(F.col("strength") / (1 - F.col("strength")))
    proper = (F.col("strength") > 0) & (F.col("strength") < 1)
    sums = evidence.groupBy(key).agg(F.sum(F.when(proper, log_odds)).alias("_l"), F.count(F.lit(1)).alias("n"), F.max(F.when(proper, 0).otherwise(1)).alias("_odd"))
    start = math.log(prior / (1 - prior))
    plain = sums.where("_odd = 0").select(key, (1 / (1 + F.exp(-(F.col("_l") + start)))).alias("confidence"), F.col("n").cast("int").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("ts", "evidence_id", "strength")))
    folded = evidence.join(sums.where("_odd = 1").select(key), key, "left_semi").groupBy(key).agg(rows.alias("e"))
    return plain.unionByName(folded.select(key, F.aggregate("e", F.lit(prior), step).alias("confidence"), F.size("e").alias("n")))


def uncertainty_total(sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return sources.groupBy(*(keys or [])).agg(_noisy_or(F.col("impact")).alias("uncertainty"), F.max("impact").alias("largest"), F.count(F.lit(1)).alias("n"))


def apply_uncertainty(confidence, uncertainty) -> Column:
    return C.clamp(C._c(confidence) * (1 - C._c(uncertainty)))


def uncertainty_summary(sources: DataFrame) -> DataFrame:
    return sources.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("impact").alias("impact"))


def evidence_diversity(evidence: DataFrame, key: str) -> DataFrame:
    return evidence.groupBy(key).agg(F.least(F.stddev_pop("strength"), F.lit(0.3)).alias("diversity"))


# Calibration -------------------------------------------------------------------------------------------------------------


def calibration_bins(samples: DataFrame, bins: int = 10) -> DataFrame:
    """Samples (predicted, correct) by bin: the last bin is closed."""
    b = F.least(F.floor(F.col("predicted") * bins), F.lit(bins - 1)).cast("int")
    return samples.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def _mean(c: Column) -> Column:
    """The mean from an exact sum, so that no digit depends on partitions (for values up to a million, to 18 places; else the usual one)."""
    x = c.cast("double")
    plain = F.abs(x) <= 1e6
    return F.when(F.bool_and(plain), F.sum(F.when(plain, x.cast("decimal(38,18)"))).cast("double") / F.count(x)).otherwise(F.avg(x))


def calibration_errors(samples: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and maximal calibration error, Brier score, rank correlation of the bins (null under three bins)."""
    by = calibration_bins(samples, bins)
    w = Window.partitionBy(F.lit(1))  # at most `bins` rows

    def rank(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2

    # Averages that differ by their last digits alone, which depend on partitions, are ties.
    ranked = by.withColumns({"ct": F.round("confidence", 9), "at": F.round("accuracy", 9)})
    ranked = ranked.withColumns({"rc": rank("ct"), "ra": rank("at")})
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    errors = ranked.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.when(F.count(F.lit(1)) >= 3, F.corr("rc", "ra")).alias("spearman"))
    brier = samples.agg(_mean(F.pow(F.col("predicted") - F.col("correct").cast("double"), 2)).alias("brier"))
    return errors.join(brier)


def calibration_factors(samples: DataFrame, bins: int = 10) -> DataFrame:
    f = F.when(F.col("confidence") > 0, F.least(F.greatest(F.col("accuracy") / F.col("confidence"), F.lit(0.5)), F.lit(1.5))).otherwise(1.0)
    return calibration_bins(samples, bins).select("bin", f.alias("factor"))


def calibrated(df: DataFrame, factors: DataFrame, bins: int = 10, confidence: str = "confidence") -> DataFrame:
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    own = df.withColumn("bin", b).join(F.broadcast(factors), "bin", "left")  # at most `bins` rows
    return own.withColumn(confidence, C.clamp(F.col(confidence) * F.coalesce("factor", F.lit(1.0)))).drop("bin", "factor")
