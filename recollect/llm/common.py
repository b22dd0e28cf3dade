"""Helpers that every corpus operator shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from ..store import forget, keep, shared_dir

__all__ = ["MOST_KEYS", "documents", "forget", "fresh", "keep", "only", "shared_dir", "ship", "text_of"]

#: Keys that are broadcast at most (some 8 bytes each); beyond, rows and keys meet by a shuffle.
MOST_KEYS = 4_000_000



#: Bytes of an Arrow batch that goes to a Python worker, where the session has Spark's bound of 64 MB, of which a worker and the JVM
#: hold several at a time.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """As store.ship; tokenizers run one thread a worker, as Spark has a worker for each core, and batches are bounded in bytes."""
    store.ship(spark)
    spark.sparkContext.environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    if spark.conf.get(_BATCH) in ("67108864b", "67108864", "64m"):  # Spark's own
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name like each of names that df does not have (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(text: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def only(docs: DataFrame, judged: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that judged says are kept, with their own columns. judged: doc_id, raw (xxhash64 of the text, null as empty),
    kept, for each row of docs; of rows alike in doc_id and text one at most is kept, and as they are alike it is any one of them.

    Only the keys of rows that go are met with docs; texts are shuffled for the few keys that several rows have."""
    own = docs.columns
    raw, nth, key, hashed = fresh(docs, "raw", "nth", "gone_id", "gone_raw")
    keys = keep(judged.groupBy("doc_id", "raw").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n")).where("not any or n > 1"))
    marked = docs.withColumn(raw, F.xxhash64(text_of(text)))

    def met(which: DataFrame, how: str) -> DataFrame:
        small = which.select(F.col("doc_id").alias(key), F.col("raw").alias(hashed))
        small = F.broadcast(small) if which.count() <= MOST_KEYS else small
        return marked.join(small, marked["doc_id"].eqNullSafe(small[key]) & (marked[raw] == small[hashed]), how)

    plain = lambda df: df.select(*(F.col(f"`{c}`") for c in own))
    out = plain(met(keys, "left_anti"))
    several = keys.where("any")
    if not several.isEmpty():
        ranked = met(several, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", raw).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in own))))))
        out = out.unionByName(plain(ranked.where(F.col(nth) == 1)))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

