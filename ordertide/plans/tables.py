"""Stored tables: date-partitioned Parquet with keys, sort order, bloom filters and retention."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.functions.scalar import event_time


@dataclass(frozen=True)
class TableSpec:
    name: str
    path: str
    time_column: str  # epoch milliseconds
    primary_key: tuple[str, ...]
    retention_days: int
    sort: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    max_rows_per_file: int = 5_000_000
    partition: str = field(default="dt")

    def with_date(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.partition, F.to_date(event_time(F.col(self.time_column))))

    def write(self, df: DataFrame, mode: str = "overwrite") -> None:
        """Overwrites only the dates that ``df`` holds, so running a load again gives the same table.

        Rows without a time go under the default partition.
        """
        out = (df if self.partition in df.columns else self.with_date(df)).sortWithinPartitions(self.partition, *self.sort)
        w = out.write.mode(mode).partitionBy(self.partition).option("maxRecordsPerFile", self.max_rows_per_file)
        w = w.option("partitionOverwriteMode", "dynamic")
        for c in self.bloom:
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        w.parquet(self.path)

    def read(self, spark: SparkSession, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """With bounds, also a predicate on the partition column, so that other dates' files aren't opened."""
        df, t = spark.read.parquet(self.path), F.col(self.time_column)
        for bound, op in ((start_ms, "ge"), (end_ms, "le")):
            if bound is not None:
                day = F.to_date(event_time(F.lit(bound).cast("bigint")))
                df = df.where((F.col(self.partition) >= day) & (t >= bound) if op == "ge" else (F.col(self.partition) <= day) & (t <= bound))
        return df

    def create(self, spark: SparkSession, database: str = "default") -> str:
        """Registers what is stored as a table of the catalog, with its partitions, so that SQL finds it by name; the name."""
        name = f"`{database}`.`{self.name}`"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        schema = spark.read.parquet(self.path).schema.toDDL()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet PARTITIONED BY (`{self.partition}`) LOCATION '{self.path}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def retained(self, df: DataFrame, now_ms: int) -> DataFrame:
        return df.where(F.col(self.time_column) >= now_ms - self.retention_days * 86_400_000)

    def expire(self, spark: SparkSession, now_ms: int) -> list[str]:
        """Removes partitions that lie wholly before the cutoff; their names."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        cutoff = spark.range(1).select(F.to_date(event_time(F.lit(now_ms - self.retention_days * 86_400_000).cast("bigint"))).cast("string")).first()[0]
        gone = []
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            value = name.partition("=")[2]
            if s.isDirectory() and name.startswith(f"{self.partition}=") and value < cutoff and not value.startswith("__"):
                fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)


def raw_spec(path: str) -> TableSpec:
    return TableSpec("orders_raw", path, "timestamp", ("event_id",), 7, ("timestamp",), ("event_id", "order_id"))


def rollup_spec(path: str) -> TableSpec:
    return TableSpec("orders_rollup_1m", path, "window_start_1m", ("restaurant_id", "menu_item_id", "window_start_1m"), 30, ("window_start_1m", "restaurant_id"))


def restaurant_topk_spec(path: str) -> TableSpec:
    return TableSpec("restaurant_topk", path, "window_start", ("restaurant_id", "window_start", "rank"), 30, ("restaurant_id", "window_start", "rank"))


def global_topk_spec(path: str) -> TableSpec:
    return TableSpec("global_topk", path, "window_start", ("window_start", "rank"), 30, ("window_start", "rank"))
