"""Observation streams end to end, on files."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recollect.sources import tables
from recollect.streaming import observe as S

SCHEMA = "session_id string, seq long, id long, event_time timestamp, what string, value double, priority string, arrival long"


def rows(seqs, session="s", hour=0):
    t = datetime(2024, 1, 1, hour)
    return [(session, q, i, t + timedelta(minutes=20 * i), "view", 1.0, "low" if i % 2 else "high", i) for i, q in enumerate(seqs)]


def drain(writer):
    """Run a stream over what has arrived, within a time limit."""
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180), "the stream did not end"
    finally:
        q.stop()


def test_sequences(spark, tmp_path):
    got = [r["status"] for r in S.sequence_gaps(spark.createDataFrame(rows([5, 6, 6, 8, 9]), SCHEMA)).orderBy("arrival").collect()]
    assert got == ["ok", "ok", "duplicate", "gap", "ok"]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows([1, 2, 4]), SCHEMA).coalesce(1).write.parquet(src)
    stream = S.validate_sequences(S.source(spark, src, spark.createDataFrame([], SCHEMA).schema))
    out = str(tmp_path / "out")
    for part in ([], [rows([4, 5], "s", 1), rows([9], "t", 1)]):
        for more in part:
            spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = S.validate_sequences(S.source(spark, src, spark.createDataFrame([], SCHEMA).schema))
        drain(stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    got = sorted((r["session_id"], r["seq"], r["status"]) for r in spark.read.parquet(out).collect())
    assert got == [("s", 1, "ok"), ("s", 2, "ok"), ("s", 4, "duplicate"), ("s", 4, "gap"), ("s", 5, "ok"), ("t", 9, "ok")]


def test_a_stream_without_new_files_rests(spark, tmp_path):
    """Under the default trigger the state's time limit makes no batches of its own."""
    src = str(tmp_path / "in")
    spark.createDataFrame(rows([1, 2]), SCHEMA).coalesce(1).write.parquet(src)
    q = S.validate_sequences(S.source(spark, src, spark.createDataFrame([], SCHEMA).schema)).writeStream.format("memory").queryName("rests").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 90
        while time.time() < until and not (q.lastProgress and not q.status["isTriggerActive"] and not q.status["isDataAvailable"]):
            time.sleep(0.5)
        time.sleep(3)
        batch = q.lastProgress["batchId"]
        time.sleep(4)
        assert q.lastProgress["batchId"] == batch <= 3
    finally:
        q.stop()
    assert spark.sql("SELECT * FROM rests").count() == 2


def test_generations_and_snapshot(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows([1, 2]), rows([3])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        drain(S.commit_generations(S.source(spark, src, spark.createDataFrame([], SCHEMA).schema), out, str(tmp_path / "c")))
    assert S.snapshot(spark, out, 0).count() == 2 and S.snapshot(spark, out, 9).count() == 3


def test_windows_with_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(rows(range(6)), SCHEMA).coalesce(1).write.parquet(src)
    stream = S.tumbling(S.source(spark, src, spark.createDataFrame([], SCHEMA).schema), late="10 minutes")
    drain(stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")))
    assert sorted(r["n"] for r in spark.sql("SELECT * FROM tumbled").collect()) == [3, 3]


def test_admission_and_pages(spark):
    df = spark.createDataFrame(rows(range(5)), SCHEMA)
    assert S.admitted(df).where("admitted").count() == 5
    many = spark.range(0, 25_000).select("id", (F.col("id") * 7 % 1000).alias("arrival"), F.lit("high").alias("priority"))
    kept = S.admitted(many).where("admitted").agg(F.count("*").alias("n"), F.max("arrival").alias("last")).first()
    assert kept["n"] == S.CAPACITY["high"] and kept["last"] == 399
    assert [r["priority"] for r in S.by_priority(df).collect()] == ["high"] * 3 + ["low"] * 2
    assert [len(p) for p in S.pages(df, 2)] == [2, 2, 1]


def test_stores(spark, tmp_path):
    m = spark.createDataFrame([(1, 0.9, [1.0, 0.0]), (2, 0.1, [0.9, 0.1])], "id long, activation double, embedding array<double>")
    at = str(tmp_path / "tiers")
    tables.write_tiered(m, at)
    assert tables.read_tier(spark, at, "hot").count() == 1
    assert [r["id"] for r in tables.tiered_recall(tables.read_tier(spark, at), (1, 0), 0.5, 5).collect()] == [1, 2]
    log = spark.createDataFrame([(1, 1, "store"), (1, 2, "delete"), (2, 3, "store")], "id long, seq long, op string")
    tables.compact(log, str(tmp_path / "log"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [2]
    check = tables.migration_check(m, m.where("id = 1")).first()
    assert (check["source"], check["target"], check["missing"], check["extra"]) == (2, 1, 1, 0)
    records = spark.createDataFrame([("x", "space", "hello there")], "id string, label string, text string")
    assert len(tables.to_episodes(records, 8).first()["embedding"]) == 8
