"""Pattern completion: partial records filled from similar ones, by votes, by means and by an attractor network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import confidence as C
from ..functions import text as X
from ..functions import vectors as V
from ..store import keep, ship
from . import cells


def masked_neighbours(partials: DataFrame, episodes: DataFrame, k: int = 7, threshold: float = 0.6, by: list[str] | None = None) -> DataFrame:
    """partial_id, id, similarity, rank: the k most similar episodes over the known dimensions, within `by` if given. Parts of the partials
    meet parts of the episodes in cells, as products of matrices; only the k best of a cell go on."""
    p, e = cells.packed(partials, by or []), cells.packed(episodes, by or [])
    scored = cells.meet(p, e, by or [], lambda left, same: cells.BestMasked(left, k, threshold, 6, ["partial_id", "id", "similarity"]), "partial_id long, id long, similarity double", most=max(64, min(cells.MOST, 2**22 // max(k, 1))))
    w = Window.partitionBy("partial_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def field_similarity(what: Column, other_what: Column, where: Column, other_where: Column, context: Column) -> Column:
    """The mean of what is known: words of what, equality of where, half of the context's overlap."""
    parts = F.filter(F.array(F.when(what.isNotNull(), X.word_similarity(what, other_what)), F.when(where.isNotNull(), (where == other_where).cast("double")), 0.5 * context), lambda x: x.isNotNull())
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(parts), F.lit(1))


def vote(neighbours: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, value, confidence: the value of the largest weight (ties: the first in order) and its share."""
    by = neighbours.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    ranked = by.withColumn("_t", F.sum("_w").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(F.round("_w", 9)), value)))
    return ranked.where("_n = 1").select(*keys, value, (F.col("_w") / F.col("_t")).alias("confidence"))


def top_people(episodes: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    n = episodes.select(*keys, F.explode("who").alias("person")).groupBy(*keys, "person").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "person")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def reconstruct_embedding(partials: DataFrame, neighbours: DataFrame, episodes: DataFrame) -> DataFrame:
    """id, embedding: unknown dimensions become the mean of the neighbours' (0 without neighbours)."""
    mean = V.mean_vector(neighbours.select("partial_id", "id").join(episodes.select("id", "embedding"), "id"), ["partial_id"], into="mean")
    met = partials.join(mean.withColumnRenamed("partial_id", "id"), "id", "left")
    blank = F.transform("embedding", lambda x: F.lit(0.0))
    return met.select("id", F.zip_with("embedding", F.coalesce("mean", blank), lambda p, m: F.coalesce(p.cast("double"), m)).alias("embedding"))


def merge_match_scores(by_embedding: DataFrame, by_time: DataFrame, completeness: float) -> DataFrame:
    """Full join on id: embedding score by completeness, temporal by what lacks."""
    a, b = by_embedding.select("id", F.col("score").alias("e")), by_time.select("id", F.col("score").alias("t"))
    s = F.coalesce("e", F.lit(0.0)) * completeness + F.coalesce("t", F.lit(0.0)) * (1 - completeness)
    return a.join(b, "id", "full").select("id", s.alias("relevance")).orderBy(F.desc("relevance"), "id")


def integrate(local: DataFrame, global_: DataFrame) -> DataFrame:
    """field, value, confidence: agreement gives the larger confidence x 1.2 (at most 1), else the surer side wins."""
    a = local.select("field", F.col("value").alias("lv"), F.col("confidence").alias("lc"))
    b = global_.select("field", F.col("value").alias("gv"), F.col("confidence").alias("gc"))
    lc, gc = F.coalesce("lc", F.lit(0.0)), F.coalesce("gc", F.lit(0.0))
    agree = F.col("lv") == F.col("gv")
    value = F.when(F.col("gv").isNull() | (lc >= gc), F.coalesce("lv", "gv")).otherwise(F.col("gv"))
    return a.join(b, "field", "full").select("field", value.alias("value"), F.when(agree, F.least(F.greatest(lc, gc) * 1.2, F.lit(1.0))).otherwise(F.greatest(lc, gc)).alias("confidence"), F.coalesce(agree, F.lit(False)).alias("agree"))


def recency_weight(hours_apart, window_hours: float) -> Column:
    return F.pow(F.greatest(1 - C._c(hours_apart) / window_hours, F.lit(0.0)), 2)


def merge_contexts(temporal: DataFrame, spatial: DataFrame) -> DataFrame:
    """id, weight: the midpoint where both speak, else the one that does."""
    t, s = temporal.select("id", F.col("weight").alias("t")), spatial.select("id", F.col("weight").alias("s"))
    return t.join(s, "id", "full").select("id", F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), (F.col("t") + F.col("s")) / 2).otherwise(F.coalesce("t", "s")).alias("weight")).orderBy(F.desc("weight"), "id")


def source_of(known: Column, confidence, support) -> Column:
    """Where a field's value comes from."""
    c, s = C._c(confidence), C._c(support)
    return F.when(known, "recalled").when((s > 0.7) & (c >= 0.7), "consolidated").when((s > 0.7) & (c >= 0.5), "reconstructed").otherwise("imagined")


def reality(fields: DataFrame, key: str) -> DataFrame:
    """key, source: the commonest source of a record's fields; ties go to the stricter source."""
    strict = F.when(F.col("source") == "recalled", 4).when(F.col("source") == "consolidated", 3).when(F.col("source") == "reconstructed", 2).otherwise(1)
    n = fields.groupBy(key, "source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(strict))
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "source")


def completion_confidence(convergence, energy, consensus, plausibility, converged: Column) -> Column:
    c = 0.3 * C._c(convergence) + 0.25 * C._c(energy) + 0.25 * C._c(consensus) + 0.2 * C._c(plausibility)
    return C.clamp(F.when(converged, c).otherwise(c * 0.3))


def gated(df: DataFrame, least: float = 0.7) -> DataFrame:
    return df.where(F.col("confidence") >= least)


def plausibility(local, neighbour_mean) -> Column:
    """.3 of local consistency and .7 of the neighbours' mean similarity, halved below .6; .2 without neighbours."""
    m = C._c(neighbour_mean)
    return F.when(m.isNull(), 0.2).otherwise((0.3 * C._c(local) + 0.7 * m) * F.when(m < 0.6, 0.5).otherwise(1.0))


def consistency(confidence: Column) -> Column:
    """An aggregate over alternatives: 1 - min(deviation / mean, 1)."""
    m, n = F.avg(confidence), F.count(confidence)
    return F.when(n < 2, 1.0).when(m < 1e-9, 0.5).otherwise(1 - F.least(F.stddev_pop(confidence) / m, F.lit(1.0)))


def diverse(df: DataFrame, group: str, k: int = 5, least_gap: float = 0.3) -> DataFrame:
    """group, id, confidence: greedily the surest (of equals the smallest id) that differ from all kept by 1 - cosine >= least_gap. Each of
    k rounds takes one row of every group, and what is too close to it goes; no round brings a group together."""
    left = df.select(group, "id", "confidence", "embedding")
    kept = None
    for _ in range(k):
        best = keep(left.groupBy(group).agg(F.min_by(F.struct("id", "confidence", "embedding"), F.struct(-F.col("confidence"), F.col("id"))).alias("b")).select(group, "b.*"))
        if best.isEmpty():
            break
        kept = best if kept is None else kept.unionByName(best)
        near = best.select(F.col(group).alias("_g"), F.col("embedding").alias("_e"))
        left = left.join(near, F.col(group) == F.col("_g")).where(1 - V.cosine(F.col("embedding"), F.col("_e")) >= least_gap).select(group, "id", "confidence", "embedding")
    return (kept if kept is not None else left).select(group, "id", "confidence")


# The attractor network --------------------------------------------------------------------------------------------------


def k_winners(x: np.ndarray, share: float) -> np.ndarray:
    """The largest share of the entries (at least one), the others 0; ties keep the first."""
    k = max(1, int(len(x) * share))
    out = np.zeros_like(x)
    top = np.argsort(-x, kind="stable")[:k]
    out[top] = x[top]
    return out


def separate(x: np.ndarray, expansion: int = 10, share: float = 0.05) -> np.ndarray:
    """Expand by fixed sine weights, keep the winners, fold back."""
    n = len(x)
    i, j = np.arange(n * expansion)[:, None], np.arange(n)[None, :]
    w = np.sin((i + 1.0) * (j + 1.0) * 0.1) / np.sqrt(n)
    high = k_winners(np.maximum(w @ x, 0), share)
    return high.reshape(expansion, n).sum(axis=0)


def hebbian(patterns: np.ndarray) -> np.ndarray:
    w = patterns.T @ patterns / max(1, patterns.shape[1])
    np.fill_diagonal(w, 0)
    return (w + w.T) / 2


def energy(w: np.ndarray, x: np.ndarray) -> float:
    return float(-0.5 * x @ w @ x)


def converge(w: np.ndarray, x: np.ndarray, most: int = 7, tolerance: float = 0.01, share: float = 0.05) -> tuple[np.ndarray, int, bool]:
    for it in range(1, most + 1):
        new = k_winners(1 / (1 + np.exp(-(w @ x))), share)
        if np.linalg.norm(new - x) < tolerance:
            return new, it, True
        x = new
    return x, most, False


def hebbian_weights(episodes: DataFrame) -> np.ndarray:
    """The sum of outer products by partial sums of partitions: width x width numbers a partition come to the driver."""
    ship(episodes.sparkSession)

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                m = V.matrix(b["embedding"])
                s = m.T @ m / m.shape[1]
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(total)), len(total)), "j": np.tile(np.arange(len(total)), len(total)), "w": total.ravel()})

    rows = episodes.where(F.col("embedding").isNotNull()).select("embedding").mapInPandas(outer, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).toPandas()
    n = int(rows["i"].max()) + 1 if len(rows) else 1
    w = np.zeros((n, n))
    if len(rows):
        w[rows["i"], rows["j"]] = rows["w"]
    np.fill_diagonal(w, 0)
    return w


def complete(partials: DataFrame, weights: np.ndarray, least_known: int = 16, most: int = 7, gate: float = 0.0) -> DataFrame:
    """id, embedding, iterations, converged, energy, confidence of each partial with enough known dimensions."""
    ship(partials.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, v in zip(b["id"], b["embedding"], strict=True):
                x = np.array([np.nan if e is None else e for e in v], np.float64)
                if (~np.isnan(x)).sum() < least_known:
                    continue
                known = np.where(np.isnan(x), 0, x)
                y, it, ok = converge(weights, separate(known), most, share=0.25)
                full = np.where(np.isnan(x), y, x)
                out.append((key, full.tolist(), it, ok, energy(weights, y), 0.9 * (1 - it / most) if ok else 0.3 * 0.9))
            yield pd.DataFrame(out, columns=["id", "embedding", "iterations", "converged", "energy", "confidence"])

    kind = partials.schema["id"].dataType.simpleString()
    done = partials.select("id", "embedding").mapInPandas(run, f"id {kind}, embedding array<double>, iterations int, converged boolean, energy double, confidence double")
    return done.where(F.col("confidence") >= gate)
