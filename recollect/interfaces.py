"""The places where users put their own parts: what each must offer, and the part that is used where nothing else is given.

Every part takes and gives DataFrames or Columns, so that a user's part becomes a piece of the same plan. `Parts` bundles them;
`parts()` are the defaults, and `parts(graph=...)` replaces one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decay as D
from .functions import text as X
from .functions import vectors as V
from .operators import completion, consolidation, context, cues, graph
from .operators.cues import EmbeddingCue
from .sources import tables


@runtime_checkable
class Lexicon(Protocol):
    def variants(self, queries: DataFrame, term: str = "query") -> DataFrame:
        """term, variant, confidence of each query that the lexicon knows."""


@runtime_checkable
class EmbeddingProvider(Protocol):
    def embed(self, df: DataFrame, text: str, into: str) -> DataFrame:
        """df with a column of vectors; null texts stay null."""


@runtime_checkable
class VectorOps(Protocol):
    def similarity(self, a: Column, b: Column) -> Column: ...

    def mean(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys, centroid."""


@runtime_checkable
class GraphBackend(Protocol):
    def neighbours(self, ids: DataFrame) -> DataFrame:
        """src, dst, weight of the edges that leave ids (id)."""

    def spread(self, seeds: DataFrame, hops: int) -> DataFrame:
        """id, activation and what else the spread says, from seeds (id, activation)."""


@runtime_checkable
class MemoryBackend(Protocol):
    def store(self, memories: DataFrame) -> None: ...

    def recall(self, cue, as_of: datetime | None = None) -> DataFrame: ...


@runtime_checkable
class DualMemoryBackend(Protocol):
    def episodes(self) -> DataFrame: ...

    def concepts(self) -> DataFrame: ...


@runtime_checkable
class StorageTierBackend(Protocol):
    def write(self, memories: DataFrame) -> None: ...

    def scan(self, tier: str | None = None) -> DataFrame: ...

    def recall(self, vector, threshold: float, limit: int) -> DataFrame: ...


@runtime_checkable
class PatternCompleter(Protocol):
    def complete(self, partials: DataFrame) -> DataFrame:
        """id, embedding, confidence of the partials that could be completed."""


@runtime_checkable
class ConsolidationService(Protocol):
    def run(self, episodes: DataFrame, as_of: datetime) -> DataFrame:
        """A row for each pattern that a cycle finds."""


@runtime_checkable
class DecayIntegration(Protocol):
    def decayed(self, memories: DataFrame, as_of: datetime) -> DataFrame:
        """memories with the confidence they have left at a time."""


# The parts that are used where nothing else is given ------------------------------------------------------------------------


@dataclass(frozen=True)
class TableLexicon:
    """Rows (term, variant, confidence)."""

    rows: DataFrame

    def variants(self, queries: DataFrame, term: str = "query") -> DataFrame:
        return X.lexicon_lookup(queries, self.rows, term)


@dataclass(frozen=True)
class HashEmbedding:
    dim: int = 64

    def embed(self, df: DataFrame, text: str = "text", into: str = "embedding") -> DataFrame:
        return df.withColumn(into, F.when(F.col(text).isNotNull(), X.hash_embedding(F.col(text), self.dim)))


@dataclass(frozen=True)
class BatchEmbedding:
    """Any function from a list of texts to a list of vectors."""

    provider: Callable[[list[str]], list[list[float]]]

    def embed(self, df: DataFrame, text: str = "text", into: str = "embedding") -> DataFrame:
        return context.embed_with(df, self.provider, text, into)


class ColumnVectors:
    def similarity(self, a: Column, b: Column) -> Column:
        return V.cosine(a, b)

    def mean(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return V.mean_vector(df, keys)


@dataclass(frozen=True)
class EdgeTable:
    edges: DataFrame

    def neighbours(self, ids: DataFrame) -> DataFrame:
        return self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")

    def spread(self, seeds: DataFrame, hops: int) -> DataFrame:
        return graph.spread(self.edges, seeds, hops)


@dataclass
class MemoryTable:
    """A table of episodes; what is stored comes on top, a stored id replaces the older row."""

    rows: DataFrame

    def store(self, memories: DataFrame) -> None:
        self.rows = self.rows.join(memories.select("id"), "id", "left_anti").unionByName(memories, allowMissingColumns=True)

    def recall(self, cue, as_of: datetime | None = None) -> DataFrame:
        return cues.recall(self.rows, cue, as_of)


@dataclass(frozen=True)
class SplitMemories:
    """One table, told apart by a condition."""

    rows: DataFrame
    is_episode: Column

    def episodes(self) -> DataFrame:
        return context.split_kinds(self.rows, self.is_episode)[0]

    def concepts(self) -> DataFrame:
        return context.split_kinds(self.rows, self.is_episode)[1]


@dataclass(frozen=True)
class ParquetTiers:
    """Tiers as partitions of one table."""

    spark: SparkSession
    path: str

    def write(self, memories: DataFrame) -> None:
        tables.write_tiered(memories, self.path)

    def scan(self, tier: str | None = None) -> DataFrame:
        return tables.read_tier(self.spark, self.path, tier)

    def recall(self, vector, threshold: float, limit: int) -> DataFrame:
        return tables.tiered_recall(self.scan(), vector, threshold, limit)


@dataclass(frozen=True)
class Attractor:
    """The attractor network over the episodes' vectors."""

    episodes: DataFrame
    least_known: int = 16

    def complete(self, partials: DataFrame) -> DataFrame:
        return completion.complete(partials, completion.hebbian_weights(self.episodes), self.least_known)


@dataclass(frozen=True)
class DreamCycle:
    by: list[str] = field(default_factory=list)

    def run(self, episodes: DataFrame, as_of: datetime) -> DataFrame:
        return consolidation.dream(episodes, as_of, self.by)


@dataclass(frozen=True)
class Forgetting:
    rate: float = 0.05

    def decayed(self, memories: DataFrame, as_of: datetime) -> DataFrame:
        hours = F.greatest(cues.hours_between(cues.at(as_of), F.col("when")), F.lit(0.0))
        return memories.withColumn("confidence", D.forgetting(F.col("confidence"), hours, self.rate))


@dataclass(frozen=True)
class Parts:
    """A set of parts to work with. A part that needs a table is given with it."""

    vectors: VectorOps = field(default_factory=ColumnVectors)
    embedding: EmbeddingProvider = field(default_factory=HashEmbedding)
    decay: DecayIntegration = field(default_factory=Forgetting)
    consolidation: ConsolidationService = field(default_factory=DreamCycle)
    lexicon: Lexicon | None = None
    memories: MemoryBackend | None = None
    kinds: DualMemoryBackend | None = None
    graph: GraphBackend | None = None
    tiers: StorageTierBackend | None = None
    completer: PatternCompleter | None = None

    def recall_text(self, spark: SparkSession, text: str, threshold: float = 0.4, limit: int = 100) -> DataFrame:
        """Memories for a text: embedded by the one part, recalled by the other."""
        if self.memories is None:
            raise ValueError("recall_text needs a memory backend")
        row = self.embedding.embed(spark.createDataFrame([(text,)], "text string"), "text", "embedding").first()
        return self.memories.recall(EmbeddingCue(tuple(row["embedding"]), threshold, limit))


def parts(**own) -> Parts:
    return replace(Parts(), **own)
