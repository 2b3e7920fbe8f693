"""Stream readers and batch scans of event logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_values(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Stream of text lines as ``value``: a folder of JSON-lines files in place of a topic."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def file_table(spark: SparkSession, path: str, schema: T.StructType | str, *, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Stream over a growing table's files."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def kafka_values(spark: SparkSession, servers: str, topic: str, *, max_offsets: int | None = None) -> DataFrame:
    """Topic values as text, from the earliest offset. The cluster must have Spark's Kafka connector."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    return r.load().select(F.col("value").cast("string").alias("value"))


def kafka_sink(keyed: DataFrame, servers: str, topic: str, checkpoint: str):
    """Writes ``key`` and ``value``; acks 1, snappy and a linger of 10 ms."""
    return (
        keyed.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("kafka.acks", "1").option("kafka.compression.type", "snappy").option("kafka.linger.ms", "10")
        .option("checkpointLocation", checkpoint).start()
    )


def topic_writer(servers: str, topic: str) -> Callable[[DataFrame], None]:
    """Sends a batch's ``key`` and ``value`` to a topic; for ``keep``, one for each table."""

    def send(keyed: DataFrame) -> None:
        w = keyed.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        w.option("kafka.acks", "1").option("kafka.compression.type", "snappy").option("kafka.linger.ms", "10").save()

    return send


def folder_writer(path: str) -> Callable[[DataFrame], None]:
    """In place of a topic: JSON lines of key and value, added to a folder."""

    def send(keyed: DataFrame) -> None:
        keyed.select(F.col("key").cast("string").alias("key"), "value").write.mode("append").json(path)

    return send
