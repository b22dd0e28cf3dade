"""Memory tables from stored ones: tiers, logs, records of other systems, and the supplied test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..operators.cues import at, ranked

AS_OF = datetime(2024, 2, 1)


# The supplied tables as memories -------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, concept (label), confidence by a rule of the id."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("concept"), (0.5 + 0.5 * ((F.col("vec_id") * 37) % 100) / 100).alias("confidence"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, when, who, what, value of the events."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("when"), F.col("user_id").alias("who"), F.col("event_type").alias("what"), "value", (0.5 + 0.5 * ((F.col("event_id") * 37) % 100) / 100).alias("confidence"), (F.col("event_id") % 6).alias("recall_count"))


def vector_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that have a vector: event and vector of the same number."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("concept"))
    return episodes(spark, sf_dir).join(v, "id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, what, where, space_id, confidence of the documents (quality labels: .9 or .3; without a label .5)."""
    d = read(spark, sf_dir, "documents")
    q = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return d.join(q, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("what"), F.col("source").alias("where"), F.col("lang").alias("space_id"), F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("confidence"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight, direction: regions, nations and customers, down and up."""
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer")
    a = n.select(F.concat(F.lit("r"), "n_regionkey").alias("hi"), F.concat(F.lit("n"), "n_nationkey").alias("lo"), F.lit(0.9).alias("weight"))
    b = c.select(F.concat(F.lit("n"), "c_nationkey").alias("hi"), F.concat(F.lit("c"), "c_custkey").alias("lo"), F.lit(0.8).alias("weight"))
    both = a.unionByName(b)
    return both.select(F.col("hi").alias("src"), F.col("lo").alias("dst"), "weight", F.lit("down").alias("direction")).unionByName(both.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight", F.lit("up").alias("direction")))


# Tiers ------------------------------------------------------------------------------------------------------------------


def write_tiered(memories: DataFrame, path: str, mode: str = "append") -> None:
    tier = F.when(F.col("activation") >= 0.7, "hot").otherwise("warm")
    memories.withColumn("tier", F.coalesce(F.col("tier"), tier) if "tier" in memories.columns else tier).write.mode(mode).partitionBy("tier").parquet(path)


def read_tier(spark: SparkSession, path: str, tier: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("tier") == tier) if tier else df


def tiered_recall(df: DataFrame, vector, threshold: float, limit: int) -> DataFrame:
    """All tiers at once; the warmer tier first among equal scores."""
    order = F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "warm", 1).otherwise(2)
    s = V.cosine(F.col("embedding"), V.literal(vector))
    return df.withColumn("score", s).where(F.col("score") >= threshold).orderBy(F.desc("score"), order, "id").limit(limit)


# Logs -------------------------------------------------------------------------------------------------------------------


def replay(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The live state of a change log: the last entry of each key, deleted ones gone."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op <> 'delete'").drop("_n")


def compact(log: DataFrame, path: str) -> None:
    """The live state as a new log."""
    replay(log).write.mode("errorifexists").parquet(path)


def backup(df: DataFrame, path: str, since: datetime | None = None, when: str = "when") -> None:
    """Full, or what came after a time."""
    (df if since is None else df.where(F.col(when) > at(since))).write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, paths: list[str], until: datetime | None = None, when: str = "when") -> DataFrame:
    df = spark.read.parquet(*paths)
    return df if until is None else df.where(F.col(when) <= at(until))


def forget(memories: DataFrame, ids: DataFrame, how: str = "delete") -> DataFrame:
    """delete: rows gone; suppress: activation 0."""
    gone = ids.select("id").distinct()
    if how == "delete":
        return memories.join(gone, "id", "left_anti")
    return memories.join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("activation", F.when(F.col("_gone"), 0.0).otherwise(F.col("activation"))).drop("_gone")


# Other systems ----------------------------------------------------------------------------------------------------------


def from_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int = 32, **options) -> DataFrame:
    """A table of a relational store, read by ranges of its key."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, **options)
    return r.load()


def from_export(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """An export of a graph or key-value store: JSON lines or CSV with id, label, text, properties."""
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.schema("id STRING, label STRING, text STRING, properties MAP<STRING, STRING>").json(path)


def to_episodes(records: DataFrame, dim: int = 64) -> DataFrame:
    """Records as episodes: the label is the space, the text gives the vector."""
    return records.select("id", F.col("label").alias("space_id"), F.col("text").alias("what"), X.hash_embedding(F.col("text"), dim).alias("embedding"))


def migration_check(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """One row: counts on either side, rows missing and rows too many."""
    a, b = source.select(key), target.select(key)
    missing = a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    extra = b.join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("extra"))
    return a.agg(F.count(F.lit(1)).alias("source")).join(b.agg(F.count(F.lit(1)).alias("target"))).join(missing).join(extra)


def spaces(memories: DataFrame) -> DataFrame:
    return memories.groupBy("space_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def best(df: DataFrame, n: int) -> DataFrame:
    return ranked(df, limit=n)


def shard_of(space: Column, workers: int) -> Column:
    """Which of so many workers a space belongs to: the same one wherever it is asked."""
    return F.conv(F.substring(F.md5(space.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % workers


def write_by_space(memories: DataFrame, path: str, mode: str = "append") -> None:
    """Memories of each space apart: what is asked of one space reads that space alone."""
    memories.write.mode(mode).partitionBy("space_id").parquet(path)


def recall_in_space(spark: SparkSession, path: str, space: str, vector, threshold: float, limit: int) -> DataFrame:
    """The best of one space; partition pruning reads no other."""
    own = spark.read.parquet(path).where(F.col("space_id") == space)
    return ranked(own.withColumn("score", V.cosine(F.col("embedding"), V.literal(vector))).where(F.col("score") >= threshold), limit=limit)
