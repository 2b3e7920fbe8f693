"""Session defaults and the shared folder for what must outlive an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_MANY = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def builder(app: str = "ordertide") -> SparkSession.Builder:
    """AQE on, UTC, RocksDB state: transformWithState needs it."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(*_STATE)
    )


def with_state(spark: SparkSession) -> None:
    """Lets streams of this session keep keyed state of their own, whoever has made the session: that needs RocksDB."""
    if spark.conf.get(_STATE[0], None) != _STATE[1]:
        spark.conf.set(*_STATE)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, *, few: bool = True) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and survives lost executors.

    With ``few``, partitions after a shuffle are as large as the session advises, and not as many as there are cores, so that a small
    table is a file or two. Stages that compute much on little data do without.
    """
    df.sparkSession._jvm.System.gc()  # see discard
    path, conf = fresh_path(df.sparkSession, what), df.sparkSession.conf
    before = conf.get(_MANY, "true")
    conf.set(_MANY, "false" if few else "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_MANY, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: what was made of them must itself be written.

    Shuffle files of jobs that are done go too. Spark deletes them when the driver collects its garbage, which a driver with
    room to spare does seldom, while they fill the executors' disks.
    """
    if tables:
        tables[0].sparkSession._jvm.System.gc()
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
