"""Tables kept in order: access statistics, tiers, semantic duplicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.confidence import clamp
from .cues import at, hours_between


def tier_for(activation: Column) -> Column:
    return F.when(activation >= 0.7, "hot").otherwise("warm")


def access_windows(access: DataFrame) -> DataFrame:
    """access(id, when, activation) with average and trend (later half less earlier half) of the last ten."""
    w = Window.partitionBy("id").orderBy("when", "access_id").rowsBetween(-9, 0)
    last = F.collect_list("activation").over(w)
    n = F.size("_l")
    half = F.floor(n / 2).cast("int")
    mean = lambda a, k: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / k
    trend = F.when(n < 2, 0.0).otherwise(mean(F.slice("_l", half + 1, n - half), n - half) - mean(F.slice("_l", F.lit(1), half), F.greatest(half, F.lit(1))))
    return access.withColumn("_l", last).withColumns({"average": F.avg("activation").over(w), "trend": trend}).drop("_l")


def access_frequency(access: DataFrame, alpha: float = 0.3) -> DataFrame:
    """id, frequency: smoothed 3600 / seconds between accesses, in order; fewer than two accesses: 0."""
    rows = F.array_sort(F.collect_list(F.unix_micros(F.col("when").cast("timestamp"))))
    own = access.groupBy("id").agg(rows.alias("t"))
    gaps = F.filter(F.zip_with(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: (a - b) / 1e6), lambda g: g > 0)
    f = F.aggregate(gaps, F.lit(None).cast("double"), lambda s, g: F.when(s.isNull(), 3600 / g).otherwise(alpha * (3600 / g) + (1 - alpha) * s))
    return own.select("id", F.coalesce(f, F.lit(0.0)).alias("frequency"))


def migration_candidates(memories: DataFrame, as_of: datetime, most: int = 100) -> DataFrame:
    """Hot memories that should leave: weak, idle over five minutes, or falling; the weakest first."""
    idle = hours_between(at(as_of), F.col("last_access")) * 3600
    return memories.where((F.col("activation") < 0.3) | (idle > 300) | (F.col("trend") < -0.2)).orderBy("activation", "id").limit(most)


def pressure_evictions(memories: DataFrame, used: float) -> DataFrame:
    """The least recently used share that a fill level asks to go: 20 % over .95, 10 % over .85, none below."""
    share = 0.2 if used > 0.95 else 0.1 if used > 0.85 else 0.0
    cut = memories.agg(F.percentile_approx(F.unix_micros(F.col("last_access").cast("timestamp")), share, 10_000).alias("cut"))
    if not share:
        return memories.limit(0)
    return memories.join(F.broadcast(cut)).where(F.unix_micros(F.col("last_access").cast("timestamp")) <= F.col("cut")).drop("cut")


def duplicate_action(similarity, new_confidence: Column, old_confidence: Column, strategy: str, threshold: float = 0.95) -> Column:
    """What becomes of a memory whose best match is this similar: skip, merge, replace, link or keep_both."""
    s = similarity
    by = {
        "skip": F.lit("skip"),
        "merge": F.lit("merge"),
        "keep_highest": F.when(new_confidence > old_confidence, "replace").otherwise("skip"),
        "link": F.lit("link"),
        "composite": F.when(s >= 0.99, "skip").otherwise("merge"),
    }
    return F.when(s.isNull() | (s < threshold), "keep_both").otherwise(by[strategy])


def deduplication_rate(actions: DataFrame) -> DataFrame:
    return actions.agg(F.avg((F.col("action") != "keep_both").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def merge_pair(a: Column, b: Column, ca: Column, cb: Column) -> tuple[Column, Column]:
    """The unit midpoint of two vectors, and the surer confidence x .95."""
    return V.normalise(V.add(a, b)), clamp(F.greatest(ca, cb) * 0.95)


def tier_statistics(memories: DataFrame) -> DataFrame:
    return memories.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("activation").alias("activation"))


def lru(memories: DataFrame, n: int) -> DataFrame:
    return memories.orderBy("last_access", "id").limit(n)


def running_mean(df: DataFrame, by: str, order: list[str], value: str, into: str = "mean") -> DataFrame:
    """df with the mean of value over a key's rows so far."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.avg(value).over(w))
