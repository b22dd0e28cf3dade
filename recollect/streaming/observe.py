"""Observation streams: sequence checks, snapshots by generation, windows, sinks.

Observations: session_id, space_id, seq, event_time, id, what, priority, confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

SESSION_IDLE_MS = 300_000
#: Queue capacities by priority, pressure cut-offs and the batch sizes that go with them.
CAPACITY = {"high": 10_000, "normal": 100_000, "low": 50_000}
PRESSURE, BATCHES = (0.5, 0.8, 0.95), (10, 100, 500, 1000)


def source(spark, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """Files that arrive in a folder as a stream; the rate limit is the admission control."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sequence_gaps(observations: DataFrame) -> DataFrame:
    """Batch form: each observation with what its session's numbering expects: ok, gap or duplicate."""
    w = Window.partitionBy("session_id").orderBy("arrival")
    last = F.max("seq").over(w.rowsBetween(Window.unboundedPreceding, -1))
    expected = F.coalesce(last, F.col("seq") - 1) + 1
    return observations.withColumn("status", F.when(F.col("seq") == expected, "ok").when(F.col("seq") < expected, "duplicate").otherwise("gap"))


def validate_sequences(stream: DataFrame, when: str = "event_time", late: str = "10 minutes") -> DataFrame:
    """Streaming form, with a state per session that ends five minutes (of event time) after the session's last observation, as soon as
    the watermark has passed. Event time needs no batches of its own: a stream without new files rests."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, latest = state.get if state.exists else (None, 0)
        out = []
        for f in frames:
            latest = max(latest, int(f[when].max().timestamp() * 1000))
            for seq in f["seq"].sort_values().tolist():
                want = seq if last is None else last + 1
                out.append((key[0], seq, "ok" if seq == want else "duplicate" if seq < want else "gap"))
                last = seq if last is None else max(last, seq)
        if last is not None:
            state.update((int(last), latest))
            state.setTimeoutTimestamp(max(latest + SESSION_IDLE_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "seq", "status"])

    kind = stream.schema["session_id"].dataType.simpleString()
    own = stream.withWatermark(when, late).select("session_id", "seq", when)
    return own.groupBy("session_id").applyInPandasWithState(check, f"session_id {kind}, seq long, status string", "last long, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(df: DataFrame, minutes: int = 60, late: str | None = None, when: str = "event_time", by: tuple[str, ...] = ("what",)) -> DataFrame:
    own = df.withWatermark(when, late) if late else df
    return own.groupBy(F.window(when, f"{minutes} minutes").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, minutes: int = 60, every: int = 30, late: str | None = None, when: str = "event_time") -> DataFrame:
    own = df.withWatermark(when, late) if late else df
    return own.groupBy(F.window(when, f"{minutes} minutes", f"{every} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, gap_minutes: int = 30, late: str | None = None, when: str = "event_time", by: str = "session_id") -> DataFrame:
    own = df.withWatermark(when, late) if late else df
    return own.groupBy(F.session_window(when, f"{gap_minutes} minutes").alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def commit_generations(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Append each micro-batch as a generation. A batch that is run again replaces its own folder: exactly once."""

    def write(batch: DataFrame, generation: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{path}/generation={generation}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def snapshot(spark, path: str, generation: int) -> DataFrame:
    """What had been committed up to a generation: partition pruning, no more."""
    return spark.read.parquet(path).where(F.col("generation") <= generation)


def by_priority(batch: DataFrame) -> DataFrame:
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2)
    return batch.orderBy(rank, "seq")


def admitted(batch: DataFrame, parts: int = 32) -> DataFrame:
    """Of each priority what its queue holds, the earliest first (by arrival, then id). Ranks are taken in `parts` slices of a priority, each
    a range of arrivals, on top of the counts of the slices before: no task sees a whole priority."""
    most = F.when(F.col("priority") == "high", CAPACITY["high"]).when(F.col("priority") == "normal", CAPACITY["normal"]).otherwise(CAPACITY["low"])
    ends = batch.agg(F.min("arrival"), F.max("arrival")).first()
    width = max(1, -(-((ends[1] or 0) - (ends[0] or 0) + 1) // parts))
    sliced = batch.withColumn("_slice", F.floor((F.col("arrival") - F.lit(ends[0] or 0)) / width).cast("int"))
    counts = sliced.groupBy("priority", "_slice").agg(F.count(F.lit(1)).alias("_own"))
    past = F.coalesce(F.sum("_own").over(Window.partitionBy("priority").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select(F.col("priority").alias("_p"), F.col("_slice").alias("_s"), past.alias("_past")))
    within = F.row_number().over(Window.partitionBy("priority", "_slice").orderBy("arrival", "id"))
    met = sliced.withColumn("_n", within).join(counts, (F.col("priority").eqNullSafe(F.col("_p"))) & (F.col("_slice") == F.col("_s")))
    return met.withColumn("admitted", F.col("_n") + F.col("_past") <= most).drop("_n", "_past", "_p", "_s", "_slice")


def pressure_state(pressure: Column) -> Column:
    return F.when(pressure < PRESSURE[0], "normal").when(pressure < PRESSURE[1], "warning").when(pressure < PRESSURE[2], "critical").otherwise("overloaded")


def batch_size(pressure: Column) -> Column:
    return F.when(pressure < PRESSURE[0], BATCHES[0]).when(pressure < PRESSURE[1], BATCHES[1]).when(pressure < PRESSURE[2], BATCHES[2]).otherwise(BATCHES[3])


def retry_after_seconds(depth: Column, rate: Column) -> Column:
    return F.when(rate < 1, 60.0).otherwise(F.least((depth - F.floor(depth / 2)) / rate, F.lit(300.0)))


def pages(df: DataFrame, size: int = 10) -> Iterator[list]:
    """Results in small batches, without holding all of them."""
    page = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def scheduled(stream: DataFrame, every: str, work: Callable[[DataFrame, int], None], checkpoint: str):
    """A consolidation that runs at an interval on what has arrived."""
    return stream.writeStream.trigger(processingTime=every).foreachBatch(work).option("checkpointLocation", checkpoint)
