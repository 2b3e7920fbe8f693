"""Keep-first deduplication over bounded inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_first(events: DataFrame, key: str | list[str] = "event_id", order: list[str | Column] | None = None) -> DataFrame:
    """One row for each key, the least by ``order`` and then by all columns, so that the survivor doesn't depend on arrival.

    ``min(struct)`` combines on the map side, so a key with very many copies sends one row from each task. Rows whose key
    is null in any part can't be told apart as repeats and all stay.
    """
    keys = [key] if isinstance(key, str) else key
    order = order if order is not None else ["timestamp"]
    first = [F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]
    whole = F.struct(*first, *[F.col(c).alias(c) for c in events.columns])
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    told_apart = events.withColumn("_own", F.when(unknown, F.monotonically_increasing_id()))
    best = told_apart.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_own").agg(F.min(whole).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in events.columns])


def keep_new(events: DataFrame, history: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key isn't in the history."""
    return events.join(history.select(key).distinct(), key, "left_anti")


class History:
    """Keys of all loads so far, as a table bucketed by key: a new load is dealt to its buckets, and the history stays where it is.

    ``buckets``: at least as many as the session's shuffle partitions, or Spark may deal both sides anew. ``path`` is a shared folder.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, *, key: str = "event_id", buckets: int = 200, database: str = "ordertide_history"):
        self.spark, self.key, self.buckets, self.path = spark, key, buckets, path
        self.name = f"`{database}`.`{name}`"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def new(self, load: DataFrame) -> DataFrame:
        """Rows whose key no earlier load had. Rows without a key can't be told apart as repeats and stay."""
        if not self.exists():
            return load
        seen = self.spark.table(self.name).select(F.col(self.key).alias("_seen")).hint("merge")
        return load.join(seen, F.col(self.key) == F.col("_seen"), "left_anti")

    def add(self, load: DataFrame) -> None:
        """Remembers the keys of rows that ``new`` returned, once each."""
        keys = load.select(self.key).dropna().distinct().repartition(self.buckets, self.key)  # a file for each bucket
        w = keys.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path)
        w.mode("append").saveAsTable(self.name)


def keep_first_within(events: DataFrame, key: str = "event_id", ttl_ms: int = 3_600_000) -> DataFrame:
    """Bounded retention by event time: a repeat within ``ttl_ms`` of the *accepted* row before it is dropped, later ones count anew.

    A row after a gap of ``ttl_ms`` is accepted whatever came before, so a key's rows fall into runs between such gaps, and a run shorter
    than ``ttl_ms`` is its first row alone. In longer runs accepting depends on what was accepted before: there the chain is folded over
    the run's later timestamps. Of rows with one key and timestamp the least stays; rows without either go.
    """
    firsts = keep_first(events.dropna(subset=[key, "timestamp"]), [key, "timestamp"])
    by_time = Window.partitionBy(key).orderBy("timestamp")
    begins = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(by_time) >= ttl_ms, F.lit(True))
    runs = firsts.withColumn("_begins", begins)
    run = F.max(F.when(F.col("_begins"), F.col("timestamp"))).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = runs.withColumn("_run", run).where(F.col("_begins") | (F.col("timestamp") >= F.col("_run") + ttl_ms))
    taken = F.expr(
        f"aggregate(array_sort(_ts), cast(array(_run) as array<bigint>), (a, t) -> IF(t >= element_at(a, -1) + {int(ttl_ms)}L, array_append(a, t), a))"
    )
    chains = open_.where("NOT _begins").groupBy(key, "_run").agg(F.collect_list("timestamp").alias("_ts"))
    accepted = chains.select(key, F.explode(taken).alias("timestamp"), F.lit(True).alias("_taken"))
    return open_.join(accepted, [key, "timestamp"], "left").where("_begins OR _taken").select(*events.columns)
