"""Running sums within groups of any size: rows lie in ranges of (group, order), and a range takes over what those before it sum to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.session import written


def laid(df: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """A written table of ``df`` with ``_run``, the number of the range of (group, order) that a row lies in. Groups aren't null."""
    return written(df.repartitionByRange(group, *order).withColumn("_run", F.spark_partition_id()), what)


def running(rows: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows``, a written table with ``_run``, and for each sum the sum over its group up to and with the row.

    A group that lies in several runs is the first or the last of each, so what a run takes over is two rows a run at most.
    """
    local = Window.partitionBy("_run", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.groupBy("_run").agg(F.min(group).alias("_a"), F.max(group).alias("_b")).select(F.explode(F.array("_a", "_b")).alias(group), "_run").distinct()
    several = ends.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(group)
    parts = rows.join(F.broadcast(several), group, "left_semi").groupBy(group, "_run").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    taken = parts.select(group, "_run", *[F.sum(n).over(before).alias(f"_of_{n}") for n in sums])
    here = rows.select("*", *[F.sum(c).over(local).alias(n) for n, c in sums.items()]).join(F.broadcast(taken), [group, "_run"], "left")
    return here.select(*rows.columns, *[(F.col(n) + F.coalesce(f"_of_{n}", F.lit(0))).alias(n) for n in sums])
