"""Where intermediate tables go: the shared folder that the session names, and reading them back."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it was not installed (a path that does not exist there is harmless)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *known])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode (tests) a folder made here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIR:
        _OWN_DIR[key] = "file://" + tempfile.mkdtemp(prefix="recollect-")
    return _OWN_DIR[key]


def keep(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it again: cuts the lineage, and survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/recollect-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    kept = df.sparkSession.read.schema(df.schema).parquet(at)
    kept._kept_at = at
    return kept


def forget(*kept: DataFrame) -> None:
    """Delete what `keep` wrote, where nothing that is still to run reads it (and what was not written by `keep` stays)."""
    for df in kept:
        at = getattr(df, "_kept_at", None)
        if at is not None:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
