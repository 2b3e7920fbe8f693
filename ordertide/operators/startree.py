"""Pre-aggregates as a star-tree: a node is divided by its next dimension only while it holds many records.

A level is a subset of the dimensions, numbered by Spark's grouping id (a bit for each dimension that is aggregated away, the first
dimension's highest). A record is a distinct combination of all dimensions. The rows of a level are made where the node above, which is
the level without its last dimension, holds more than ``limit`` records; the sums of smaller nodes come from their records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.operators.rollup import CUBE_DIMS

SUMS = ["sum_revenue_cents", "sum_quantity", "order_count"]
SKETCH = "unique_customers_hll"
COLUMNS = [*CUBE_DIMS, "level", *SUMS, "records", SKETCH]
ROOT = (1 << len(CUBE_DIMS)) - 1
LIMIT = 10_000


def level_of(dims: set[str]) -> int:
    return sum(1 << len(CUBE_DIMS) - 1 - i for i, d in enumerate(CUBE_DIMS) if d not in dims)


def dims_of(level: int) -> list[str]:
    return [d for i, d in enumerate(CUBE_DIMS) if not level >> len(CUBE_DIMS) - 1 - i & 1]


def above(level: int) -> int:
    """The level without its last dimension."""
    return level | (level + 1)


def _sums(sketched: bool) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in SUMS], *([F.hll_union_agg(SKETCH).alias(SKETCH)] if sketched else [])]


def _shaped(df: DataFrame) -> DataFrame:
    return (df if SKETCH in df.columns else df.withColumn(SKETCH, F.lit(None).cast("binary"))).select(*COLUMNS)


def records(rolled: DataFrame) -> DataFrame:
    """Level 0: one row for each combination of all dimensions."""
    g = rolled.groupBy(*CUBE_DIMS).agg(*_sums(SKETCH in rolled.columns))
    return _shaped(g.withColumns({"level": F.lit(0).cast("bigint"), "records": F.lit(1).cast("bigint")}))


def nodes(finest: DataFrame) -> DataFrame:
    """level, the dimensions and ``records`` of each node that could be divided."""
    n = finest.select(*CUBE_DIMS[:-1]).cube(*CUBE_DIMS[:-1]).agg(F.count(F.lit(1)).alias("records"), F.grouping_id().cast("bigint").alias("_g"))
    return n.select((F.col("_g") * 2 + 1).alias("level"), *CUBE_DIMS[:-1], "records")


def levels(finest: DataFrame, divided: DataFrame, divided_levels: list[int], *, base: bool = True) -> DataFrame:
    """The rows of all levels above the records, below the nodes in ``divided`` (level and dimensions), and the root.

    ``divided_levels``: the levels that these nodes lie in, 16 at most. ``base``: whether ``finest`` is all that there is, so that its records can be counted.
    """
    below = [x for x in range(1, ROOT) if above(x) in set(divided_levels)]
    grouped = finest.groupingSets([dims_of(x) for x in (ROOT, *below)], *CUBE_DIMS)
    rows = grouped.agg(F.grouping_id().cast("bigint").alias("level"), *_sums(True), (F.count(F.lit(1)) if base else F.lit(0).cast("bigint")).alias("records"))
    up = F.col("level").bitwiseOR(F.col("level") + 1)
    keys = {f"_k{i}": F.when(up.bitwiseAND(F.lit(1 << len(CUBE_DIMS) - 1 - i)) == 0, F.col(d)) for i, d in enumerate(CUBE_DIMS[:-1])}
    rows = rows.withColumns({"_up": up, **keys})
    of = divided.select(F.col("level").alias("_dl"), *[F.col(d).alias(f"_d{i}") for i, d in enumerate(CUBE_DIMS[:-1])])
    same = (F.col("_up") == F.col("_dl")) & F.col("_k0").eqNullSafe(F.col("_d0"))
    for i in range(1, len(CUBE_DIMS) - 1):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_d{i}"))
    kept = rows.where(F.col("level") != ROOT).join(of, same, "left_semi")
    return _shaped(kept).unionByName(_shaped(rows.where(F.col("level") == ROOT)))


def served(tree: DataFrame, dims: list[str], limit: int, *, whole: bool) -> DataFrame:
    """Sums and the union of sketches by ``dims``, from a stored tree. ``whole``: all nodes above that level are known to be divided."""
    level = level_of(set(dims))
    rows = tree.where(F.col("level") == level).select(*dims, *SUMS, SKETCH)
    if level in (0, ROOT) or whole:
        return rows
    up = above(level)
    divided = tree.where((F.col("level") == up) & (F.col("records") > limit)).select(*[F.col(d).alias(f"_{d}") for d in dims_of(up)], F.lit(1).alias("_one"))
    same = F.lit(1) == F.col("_one")
    for d in dims_of(up):
        same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
    small = tree.where(F.col("level") == 0).join(divided, same, "left_anti").groupBy(*dims).agg(*_sums(True))
    return rows.unionByName(small)
