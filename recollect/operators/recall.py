"""The recall pipelines: seeding, spreading, merging of confidences, decay, ranking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as C
from ..functions import decay as D
from ..functions import vectors as V
from . import graph
from .cues import EmbeddingCue, at, hours_between, ranked


def seed(memories: DataFrame, cue: EmbeddingCue, temperature: float = 0.5) -> DataFrame:
    """id, activation, confidence, similarity of the cue's nearest memories: sigmoid of the similarity, at least .01."""
    from .cues import by_embedding

    threshold = max(0.4, cue.threshold)
    hits = by_embedding(memories, cue)
    act = V.sigmoid_activation(F.col("score"), threshold, temperature)
    return hits.select("id", act.alias("activation"), F.greatest(F.col("score"), act * 0.5).alias("confidence"), F.col("score").alias("similarity")).where(F.col("activation") >= 0.01)


def merge_seeds(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("id").agg(F.least(F.sum("activation"), F.lit(1.0)).alias("activation"), F.max("confidence").alias("confidence"), F.max("similarity").alias("similarity"))


def recency_boost(age_hours: Column, factor: float = 1.2, window_hours: float = 24.0) -> Column:
    share = F.least(F.greatest(age_hours / window_hours, F.lit(0.0)), F.lit(1.0))
    return F.when(age_hours <= window_hours, 1 + (factor - 1) * (1 - share)).otherwise(1.0)


def rank(spread: DataFrame, seeds: DataFrame, memories: DataFrame, as_of: datetime, least: float = 0.1, most: int = 100) -> DataFrame:
    """Spread left-joined with the seeds (confidence x 1.1 there), joined with the memories, decayed, scored."""
    met = spread.join(seeds.select("id", "similarity"), "id", "left").join(memories.select("id", "when", "recall_count"), "id")
    hours = F.greatest(hours_between(at(as_of), F.col("when")), F.lit(0.0))
    base = C.clamp(F.col("confidence") * F.when(F.col("similarity").isNotNull(), 1.1).otherwise(1.0))
    conf = D.lazy(base, hours, F.col("recall_count"))
    score = F.col("activation") * conf
    score = F.when(F.col("similarity").isNotNull(), (score + F.col("similarity")) / 2).otherwise(score) * recency_boost(hours)
    out = met.select("id", "activation", conf.alias("confidence"), "similarity", score.alias("score")).where(F.col("confidence") >= least)
    return ranked(out, limit=most)


def recall(memories: DataFrame, edges: DataFrame, cue: EmbeddingCue, as_of: datetime, max_depth: int = 3, most: int = 100) -> DataFrame:
    """Seed, spread, merge, decay, rank."""
    seeds = merge_seeds(seed(memories, cue))
    return rank(graph.spread(edges, seeds, max_depth), seeds, memories, as_of, most=most)


def combine_cues(cues: DataFrame, strategy: str, keys: list[str]) -> DataFrame:
    """cues(keys, cue_id, embedding, confidence) as one vector by keys: average, confidence or attention (softmax of confidences)."""
    from pyspark.sql.window import Window

    if strategy == "average":
        return V.mean_vector(cues, keys)
    if strategy == "confidence":
        return V.mean_vector(cues, keys, weight=F.col("confidence"))
    w = Window.partitionBy(*keys)
    return V.mean_vector(cues.withColumn("_a", V.softmax(F.col("confidence"), w)), keys, weight=F.col("_a"))


def blend_weights(episodic, semantic, coherence, base: tuple[float, float] = (0.7, 0.3), mode: str = "adaptive") -> tuple[Column, Column]:
    """Weights that sum to 1: fixed by mode, or the base moved by the pathways' confidence and the concepts' coherence."""
    fixed = {"episodic": (1.0, 0.0), "semantic": (0.0, 1.0), "balanced": (0.5, 0.5)}
    if mode in fixed:
        return F.lit(fixed[mode][0]), F.lit(fixed[mode][1])
    e, s = base[0] * C._c(episodic), base[1] * C._c(semantic) * (0.5 + 0.5 * C._c(coherence))
    t = e + s
    return F.when(t > 0, e / t).otherwise(base[0]), F.when(t > 0, s / t).otherwise(base[1])


def blended(episodic: DataFrame, semantic: DataFrame, mode: str = "adaptive") -> DataFrame:
    """Full join of the two pathways (id, confidence[, coherence]); calibrated by where a row came from."""
    a = episodic.select("id", F.col("confidence").alias("e"))
    b = semantic.select("id", F.col("confidence").alias("s"), "coherence")
    met = a.join(b, "id", "full")
    e, s = F.coalesce("e", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    we, ws = blend_weights(e, s, F.coalesce("coherence", F.lit(0.0)), mode=mode)
    conf = C.blend(e, s, we, ws)
    both = F.col("e").isNotNull() & F.col("s").isNotNull()
    balance = 1 - F.abs(we - ws)
    said = F.when(both, conf * 1.15 * (1 + 0.1 * balance)).when(F.col("s").isNotNull(), conf * F.when(F.col("coherence") >= 0.7, 1.05).otherwise(0.9)).otherwise(conf)
    source = F.when(both, "both").when(F.col("s").isNotNull(), "semantic").otherwise("episodic")
    return met.select("id", C.clamp(said).alias("confidence"), source.alias("source"))


def dual_search(episodes: DataFrame, concepts: DataFrame, vector, k: int = 20, digits: int = 6) -> DataFrame:
    """kind, id, score: the k best of two tables of vectors together; of equals episodes last, as their kind sorts."""
    score = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.round(V.cosine(F.col("embedding"), V.literal(vector)), digits).alias("score"))
    return score(episodes, "episode").unionByName(score(concepts, "concept")).orderBy(F.desc("score"), "kind", "id").limit(k)
