"""From a query's tree to DataFrames: the memory tables, and what each verb makes of them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as C
from ..functions import vectors as V
from ..operators import completion, consolidation, cues, graph
from ..operators.results import Result
from . import language as L


@dataclass
class Memory:
    """One space's tables. memories: id, embedding, confidence[, what, where, when, who, space_id]; edges: src, dst, weight;
    patterns: cluster, strength, n, source_episodes, centroid."""

    memories: DataFrame
    edges: DataFrame | None = None
    patterns: DataFrame | None = None
    as_of: datetime | None = None


def predicate(c: L.Constraint) -> Column:
    by = {
        ("confidence", ">"): lambda v: F.col("confidence") > v, ("confidence", "<"): lambda v: F.col("confidence") < v,
        ("confidence", ">="): lambda v: F.col("confidence") >= v, ("confidence", "<="): lambda v: F.col("confidence") <= v,
        ("created", "before"): cues.created_before, ("created", "after"): cues.created_after,
        ("content", "contains"): cues.content_contains, ("space", "is"): cues.in_space,
        ("content", "similar"): lambda v: cues.similar_to(v, c.threshold),
    }
    return by[c.field, c.op](c.value)


def compare(column: Column, t: L.Threshold) -> Column:
    return {">": column > t.value, "<": column < t.value, ">=": column >= t.value, "<=": column <= t.value, "=": column == t.value}[t.op]


def matching(df: DataFrame, pattern: L.Pattern) -> DataFrame:
    """The rows that a pattern means, with a score; their confidence is the score of a vector, else their own."""
    if isinstance(pattern, L.NodeId):
        return df.where(F.col("id").cast("string") == pattern.id).withColumn("score", F.lit(1.0))
    if isinstance(pattern, L.Vector):
        norm = sum(x * x for x in pattern.values) ** 0.5
        s = F.round(F.greatest(V.cosine(F.col("embedding"), V.literal(pattern.values), norm_b=F.lit(norm)), F.lit(0.0)), 6)
        return df.withColumn("score", s).where(F.col("score") >= pattern.threshold)
    if isinstance(pattern, L.Content):
        return df.where(cues.content_contains(pattern.text)).withColumn("score", F.lit(1.0))
    return df.withColumn("score", F.lit(1.0))


def run_recall(q: L.Recall, m: Memory) -> Result:
    """Pattern, then constraints, then confidence, then limit. BASE_RATE updates the confidence."""
    df = m.memories
    for c in q.constraints:
        df = df.where(predicate(c))
    df = matching(df, q.pattern)
    if q.base_rate is not None:
        df = df.withColumn("confidence", C.update_with_base_rate(F.col("confidence"), q.base_rate))
    if q.confidence:
        df = df.where(compare(F.col("confidence"), q.confidence))
    if q.limit:
        df = df.orderBy(F.desc("score"), F.desc("confidence"), "id").limit(q.limit)
    evidence = df.select("id", F.lit("direct_match").alias("kind"), F.col("score").alias("strength"))
    return Result.of(df, evidence)


def run_spread(q: L.Spread, m: Memory) -> Result:
    """All that activation from the source reaches, without the source: confidence is activation."""
    rate = graph.decay_to_rate(q.decay)
    kind = m.edges.schema["src"].dataType
    seeds = m.edges.sparkSession.range(1).select(F.lit(q.source).cast(kind).alias("id"), F.lit(1.0).alias("activation"))
    met = graph.spread(m.edges, seeds, q.max_hops, graph.exponential(graph.RATE if rate is None else rate))
    own = met.where((F.col("id") != F.lit(q.source).cast(kind)) & (F.col("activation") >= q.threshold)).withColumn("confidence", F.col("activation"))
    uncertainty = m.edges.sparkSession.createDataFrame([("spreading_activation_noise", 0.5 * q.decay)], "kind string, impact double")
    return Result.of(own, own.select("id", F.lit("spreading_activation").alias("kind"), F.col("activation").alias("strength")), uncertainty)


def run_imagine(q: L.Imagine, m: Memory) -> Result:
    """Completions near the pattern: neighbours' mean as embedding; confidence from the cue's strength and the neighbours."""
    strength = 0.5 if isinstance(q.pattern, L.Vector | L.Content) else 0.1
    if isinstance(q.pattern, L.Vector):
        strength = sum(x != 0 for x in q.pattern.values) / len(q.pattern.values)
    if q.seeds:
        strength = min(0.9, strength + 0.2)
    if q.confidence and strength < q.confidence.value:
        raise L.ValidationError(f"the cue is too weak: {strength:.2f} under {q.confidence.value}")
    near = matching(m.memories, q.pattern)
    if q.seeds:
        near = near.unionByName(m.memories.where(F.col("id").cast("string").isin(list(q.seeds))).withColumn("score", F.lit(1.0))).dropDuplicates(["id"])
    top = near.orderBy(F.desc("score"), "id").limit(7)
    made = V.mean_vector(top.withColumn("g", F.lit(0)), ["g"], weight=F.greatest(F.col("score"), F.lit(1e-9)), into="embedding")
    how = top.agg(F.avg("score").alias("s"), completion.consistency(F.col("confidence")).alias("c"))
    novelty = q.novelty or 0.0
    out = made.join(how).select(F.lit("imagined").alias("id"), "embedding", C.clamp(F.lit(strength) * (0.5 * F.col("s") + 0.5 * F.col("c")) * (1 - 0.5 * novelty)).alias("confidence"))
    return Result.of(out)


def run_consolidate(q: L.Consolidate, m: Memory) -> Result:
    """Patterns that the target names, or those of the episodes that the query selects."""
    if q.pattern is None or not isinstance(q.pattern, L.AnyPattern):
        df = m.memories
        for c in q.constraints:
            df = df.where(predicate(c))
        if q.pattern is not None:
            df = matching(df, q.pattern)
        chosen = df.dropDuplicates(["id"])
        found = consolidation.detect_patterns(chosen.withColumn("g", F.lit(0)), ["g"])
    else:
        found = m.patterns.where(F.col("cluster").cast("string").contains(q.target) | F.exists("source_episodes", lambda x: x.cast("string").contains(q.target)))
    rows = found.select(F.concat(F.lit(q.target + ":"), F.col("cluster").cast("string")).alias("id"), F.col("strength").alias("confidence"), "n", "source_episodes")
    uncertainty = m.memories.sparkSession.createDataFrame([("measurement_error", 0.15)], "kind string, impact double")
    return Result.of(rows, uncertainty=uncertainty)


def execute(text: str, memory: Memory, dimension: int | None = None, most: int = L.MAX_COST) -> Result:
    """Parse, admit, run. PREDICT is checked and then refused, as there is no model of the future here."""
    q = L.admit(L.parse(text, dimension), most)
    match q:
        case L.Recall():
            return run_recall(q, memory)
        case L.Spread():
            return run_spread(q, memory)
        case L.Imagine():
            return run_imagine(q, memory)
        case L.Consolidate():
            return run_consolidate(q, memory)
        case _:
            raise NotImplementedError("PREDICT: prediction is not implemented")
