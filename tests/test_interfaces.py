"""The default parts fulfil what they stand for, and a user's part takes a default's place."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect import interfaces as I


def test_defaults(spark, tmp_path):
    m = spark.createDataFrame([(1, "red car", 0.9, datetime(2024, 1, 1)), (2, "blue sky", 0.5, datetime(2024, 1, 31))], "id long, what string, confidence double, when timestamp_ntz")
    m = I.HashEmbedding(8).embed(m, "what").withColumn("activation", F.col("confidence"))
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5)], "src long, dst long, weight double")
    own = I.parts(
        embedding=I.HashEmbedding(8), memories=I.MemoryTable(m), graph=I.EdgeTable(edges), tiers=I.ParquetTiers(spark, str(tmp_path / "t")), kinds=I.SplitMemories(m, F.col("id") == 1),
        lexicon=I.TableLexicon(spark.createDataFrame([("car", "auto", 0.9)], "term string, variant string, confidence double")), completer=I.Attractor(m, 1),
    )
    kinds = (I.VectorOps, I.EmbeddingProvider, I.DecayIntegration, I.ConsolidationService, I.Lexicon, I.MemoryBackend, I.DualMemoryBackend, I.GraphBackend, I.StorageTierBackend, I.PatternCompleter)
    given = (own.vectors, own.embedding, own.decay, own.consolidation, own.lexicon, own.memories, own.kinds, own.graph, own.tiers, own.completer)
    assert all(isinstance(x, k) for x, k in zip(given, kinds, strict=True))
    assert own.recall_text(spark, "red car", 0.9).first()["id"] == 1
    own.memories.store(m.where("id = 2").withColumn("confidence", F.lit(0.1)))
    assert {r["id"]: r["confidence"] for r in own.memories.rows.collect()} == {1: 0.9, 2: 0.1}
    assert [r["dst"] for r in own.graph.neighbours(spark.createDataFrame([(1,)], "id long")).collect()] == [2]
    own.tiers.write(m)
    assert own.tiers.scan("hot").count() == 1 and own.tiers.recall([1.0] * 8, 0.0, 1).count() == 1
    assert own.kinds.episodes().count() == own.kinds.concepts().count() == 1
    assert own.lexicon.variants(spark.createDataFrame([("Car",)], "query string")).first()["variant"] == "auto"
    left = {r["id"]: r["confidence"] for r in own.decay.decayed(m, datetime(2024, 2, 1)).collect()}
    assert left[1] < left[2] < 0.5
    assert own.completer.complete(m.select("id", "embedding")).count() == 2


def test_own_part(spark):
    class Half:
        def decayed(self, memories, as_of):
            return memories.withColumn("confidence", F.col("confidence") / 2)

    own = I.parts(decay=Half())
    assert isinstance(own.decay, I.DecayIntegration)
    assert own.decay.decayed(spark.createDataFrame([(1.0,)], "confidence double"), datetime(2024, 1, 1)).first()[0] == 0.5
    with pytest.raises(ValueError):
        own.recall_text(spark, "x")
    assert I.BatchEmbedding(lambda ts: [[1.0] for _ in ts]).embed(spark.createDataFrame([("a",)], "text string")).first()["embedding"] == [1.0]
