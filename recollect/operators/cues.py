"""Cues and constraints as row filters and scores over an episode table.

Episode columns used where they apply: id, embedding, what, where, when, who, confidence, space_id. A cue whose limit is None has all
that reach its threshold."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.confidence import _c, clamp


@dataclass(frozen=True)
class EmbeddingCue:
    vector: tuple[float, ...]
    threshold: float = 0.8
    limit: int | None = 100


@dataclass(frozen=True)
class ContextCue:
    start: datetime | None = None
    end: datetime | None = None
    location: str | None = None
    threshold: float = 0.5
    limit: int | None = 50


@dataclass(frozen=True)
class TemporalCue:
    kind: str  # before, after, between, recent
    at: datetime | None = None
    end: datetime | None = None
    hours: float | None = None
    threshold: float = 0.0
    limit: int | None = 100


@dataclass(frozen=True)
class SemanticCue:
    content: str
    threshold: float = 0.3
    limit: int | None = 75


def adaptive_threshold(threshold, cue_confidence) -> Column:
    return 0.7 * _c(threshold) + 0.3 * _c(cue_confidence)


def ranked(df: DataFrame, score: str = "score", limit: int | None = None, key: str = "id") -> DataFrame:
    """Best first; equal scores by id, so that a limit always takes the same rows."""
    out = df.orderBy(F.desc(score), key)
    return out.limit(limit) if limit is not None else out


def by_embedding(episodes: DataFrame, cue: EmbeddingCue) -> DataFrame:
    """Exact scan: cosine, kept from the threshold on. The cue's norm is worked out here, once."""
    norm = sum(x * x for x in cue.vector) ** 0.5
    scored = episodes.withColumn("score", F.greatest(V.cosine(F.col("embedding"), V.literal(cue.vector), norm_b=F.lit(norm)), F.lit(0.0)))
    return ranked(scored.where(F.col("score") >= cue.threshold), limit=cue.limit)


def by_content(episodes: DataFrame, cue: SemanticCue) -> DataFrame:
    """Only texts with a word of the cue are split and scored: without one the score is 0 (a cue without words, or a threshold below 0,
    scores all)."""
    needed = [re.escape(w) for w in cue.content.lower().split()]
    if needed and cue.threshold >= 0:
        episodes = episodes.where(F.lower("what").rlike("|".join(needed)))
    scored = episodes.withColumn("score", X.semantic_similarity(cue.content, F.col("what")))
    return ranked(scored.where(F.col("score") > cue.threshold), limit=cue.limit)


def by_content_cold(episodes: DataFrame, cue: SemanticCue) -> DataFrame:
    """The cold tier's rule: a substring counts 1."""
    inside = F.contains(F.lower("what"), F.lit(cue.content.lower()))
    scored = episodes.withColumn("score", F.when(inside, 1.0).otherwise(X.jaccard(X.words(F.lit(cue.content)), X.words(F.col("what")))))
    return ranked(scored.where(F.col("score") >= cue.threshold), limit=cue.limit)


def by_context(episodes: DataFrame, cue: ContextCue) -> DataFrame:
    """The mean of what the cue asks for: time range (closed), location."""
    parts = []
    if cue.start is not None and cue.end is not None:
        parts.append(F.when(F.col("when").between(at(cue.start), at(cue.end)), 1.0).otherwise(0.0))
    if cue.location is not None:
        parts.append(X.location_similarity(F.lit(cue.location), F.col("where")))
    score = sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.0)
    return ranked(episodes.withColumn("score", score).where(F.col("score") > cue.threshold), limit=cue.limit)


def at(t: datetime) -> Column:
    """A time as a column without a zone, as the tables have it."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def temporal_score(when: Column, cue: TemporalCue, as_of: datetime) -> Column:
    if cue.kind == "before":
        return F.when(when < at(cue.at), 1.0).otherwise(0.0)
    if cue.kind == "after":
        return F.when(when > at(cue.at), 1.0).otherwise(0.0)
    if cue.kind == "between":
        return F.when(when.between(at(cue.at), at(cue.end)), 1.0).otherwise(0.0)
    age = hours_between(at(as_of), when)
    return F.when((age >= 0) & (age <= cue.hours), 1 - age / cue.hours).otherwise(0.0)


def by_time(episodes: DataFrame, cue: TemporalCue, as_of: datetime) -> DataFrame:
    scored = episodes.withColumn("score", temporal_score(F.col("when"), cue, as_of))
    return ranked(scored.where(F.col("score") > cue.threshold), limit=cue.limit)


#: Handlers by cue type; `register` adds more.
HANDLERS = {
    EmbeddingCue: lambda df, cue, as_of: by_embedding(df, cue),
    SemanticCue: lambda df, cue, as_of: by_content(df, cue),
    ContextCue: lambda df, cue, as_of: by_context(df, cue),
    TemporalCue: by_time,
}


def register(kind: type, handler) -> None:
    HANDLERS[kind] = handler


def recall(episodes: DataFrame, cue, as_of: datetime | None = None) -> DataFrame:
    """The handler of the cue's type; TypeError if none is known."""
    for kind, handler in HANDLERS.items():
        if isinstance(cue, kind):
            return handler(episodes, cue, as_of)
    raise TypeError(f"no handler for {type(cue).__name__}")


# Constraints ----------------------------------------------------------------------------------------------------------


def confidence_above(v: float) -> Column:
    return F.col("confidence") > v


def confidence_below(v: float) -> Column:
    return F.col("confidence") < v


def confidence_between(low: float, high: float) -> Column:
    return F.col("confidence").between(low, high)


def created_before(t: datetime) -> Column:
    return F.col("when") < at(t)


def created_after(t: datetime) -> Column:
    return F.col("when") > at(t)


def similar_to(vector, threshold: float) -> Column:
    return F.greatest(V.cosine(F.col("embedding"), V.literal(vector)), F.lit(0.0)) >= threshold


def content_contains(s: str) -> Column:
    return F.contains(F.lower("what"), F.lit(s.lower()))


def in_space(space: str) -> Column:
    return F.col("space_id") == space


def with_people(people: list[str]) -> Column:
    return F.arrays_overlap(F.col("who"), F.array(*map(F.lit, people)))


def completeness(what: Column, where: Column, who: Column, embedding: Column) -> Column:
    """The mean of: has what, has where, has who, share of dimensions that are not zero."""
    has = lambda c: F.when(c.isNotNull() & (F.length(c) > 0), 1.0).otherwise(0.0)
    people = F.when(F.size(who) > 0, 1.0).otherwise(0.0)
    return (has(what) + has(where) + people + F.size(F.filter(embedding, lambda x: x != 0)) / F.size(embedding)) / 4


def to_partial(embedding: Column, masked: float) -> Column:
    """The vector without its leading share of dimensions."""
    n = F.size(embedding)
    return F.transform(embedding, lambda x, i: F.when(i / n >= masked, x))


def recognise(episodes: DataFrame, vector, threshold: float = 0.8) -> DataFrame:
    """One row: the best similarity, and whether it makes the cue familiar."""
    best = episodes.agg(F.max(V.cosine(F.col("embedding"), V.literal(vector))).alias("similarity"))
    return best.withColumn("familiar", F.col("similarity") >= threshold)


def verified(results: DataFrame, threshold: float) -> DataFrame:
    """One row: whether all results reach the threshold and have a confidence in [0, 1]."""
    return results.agg(
        F.coalesce(F.min(F.col("confidence") >= threshold), F.lit(True)).alias("above"),
        F.coalesce(F.min(clamp(F.col("confidence")) == F.col("confidence")), F.lit(True)).alias("in_range"),
    )
