"""The tables that requests are answered from: ranked windows, per restaurant and global, the rollup, and a star-tree of its sums.

They lie in one store, so a commit shows all of them at once. A load replaces dates; a stream adds closed windows, of which
only those that it brings are ranked. A request for a range of time opens the files of its dates alone.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.functions.scalar import event_time, hour_of_day, iso_day_of_week
from ordertide.operators import startree
from ordertide.operators.rollup import CUBE_DIMS, merge_rollup
from ordertide.operators.topk import top_k_global, top_k_per_restaurant
from ordertide.plans.engine import Engine, recent_top, route, top_by_revenue
from ordertide.plans.store import Kept, Store, Transaction, starts_ms
from ordertide.schemas import ROLLUP_KEY

TABLES = {
    "rollup": Kept("append", tuple(ROLLUP_KEY), "window_start_1m", ("window_start_1m", "restaurant_id")),
    "rollup_hours": Kept("add", tuple(ROLLUP_KEY), "window_start_1m", ("window_start_1m", "restaurant_id"), (startree.SKETCH,), ("menu_item_name", "category_id", "hour_of_day", "day_of_week")),
    "restaurant_topk": Kept("latest", ("restaurant_id", "window_start"), "window_start", ("restaurant_id", "window_start", "rank")),
    "global_topk": Kept("latest", ("window_start",), "window_start", ("window_start", "rank")),
    "customers": Kept("append", (*ROLLUP_KEY, "customer_id"), "window_start_1m", ("restaurant_id", "menu_item_id")),
    "tree": Kept("add", ("level", *CUBE_DIMS), sort=("level",), sketches=(startree.SKETCH,)),
}


@dataclass(frozen=True)
class Serving:
    """Tables below one folder. ``limit``: records that a node of the tree may hold undivided. ``fold``: commits after which their files are made one, and the tree anew."""

    root: str
    k: int = 10
    limit: int = startree.LIMIT
    fold: int = 16

    @cached_property
    def store(self) -> Store:
        return Store(self.root, TABLES, self.fold)

    def exists(self, spark: SparkSession) -> bool:
        return self.store.exists(spark)

    def write(self, rolled: DataFrame, *, mode: str = "combined") -> Serving:
        """Loads a rollup: the dates that it holds are replaced, others stay, and the tree is of all that is stored then."""
        txn = self.store.begin(rolled.sparkSession)
        txn.put("rollup", rolled, replace="dates")
        txn.drop("rollup_hours", [d for d in txn.dates("rollup") if any(n == txn.n for n, _ in txn.mark["tables"]["rollup"][d])])
        self._leave_customers(txn)
        self._fill(txn, txn.last("rollup"), None, mode, replace="dates")
        txn.commit()
        return self

    def write_customers(self, visits: DataFrame) -> Serving:
        """Stores who is behind the sums: a row for each window, restaurant, item and customer, of all dates that the rollup holds. Sketches only estimate their number."""
        start = event_time(F.col("window_start_1m"))
        rows = visits.select(*ROLLUP_KEY, "customer_id").distinct().withColumns({"hour_of_day": hour_of_day(start), "day_of_week": iso_day_of_week(start)})
        txn = self.store.begin(visits.sparkSession)
        txn.put("customers", rows, replace="dates")
        txn.commit()
        return self

    def _leave_customers(self, txn: Transaction) -> None:
        """Customers of dates whose rollup this transaction changes are no longer all of them."""
        txn.drop("customers", [d for d, folders in txn.mark["tables"].get("rollup", {}).items() if any(n == txn.n for n, _ in folders)])

    def append(self, batch: DataFrame, writer: str, number: int, *, mode: str = "combined") -> bool:
        """Adds closed windows of a stream in one commit; whether there was something new.

        A batch that is in already does nothing. Rows whose key is stored are left out, and so are windows that the merge job has merged.
        Windows that have stored rows are ranked with these.
        """
        spark = batch.sparkSession
        txn = self.store.begin(spark)
        if txn.done(writer, number):
            return False
        key = list(ROLLUP_KEY)
        if "merged_to" in txn.mark["notes"]:
            batch = batch.where(F.col("window_start_1m") >= txn.mark["notes"]["merged_to"])
        if txn.has("rollup"):
            low, high = batch.agg(F.min("window_start_1m"), F.max("window_start_1m")).first()
            if low is None:
                return False
            stored = self.store.read(spark, "rollup", low, high)
            batch = batch.join(stored.select(*key), key, "left_anti")
        txn.put("rollup", batch)
        new = txn.last("rollup")
        if new.isEmpty():
            return False
        self._leave_customers(txn)
        whole = new
        if self.exists(spark):
            low, high = new.agg(F.min("window_start_1m"), F.max("window_start_1m")).first()
            before = self.store.read(spark, "rollup", low, high).join(new.select("window_start_1m").distinct(), "window_start_1m", "left_semi")
            whole = new.unionByName(before)
        self._fill(txn, whole, new, mode)
        folded = [d for t in ("rollup", "restaurant_topk", "global_topk") for d in txn.fold(t)]
        txn.commit(writer, number)
        if folded:
            self.store.vacuum(spark)
        return True

    def _fill(self, txn: Transaction, windows: DataFrame, new: DataFrame | None, mode: str, replace: str | None = None) -> None:
        """Ranks whole windows and grows the tree: three tables from the one that is stored, at the same time."""
        with ThreadPoolExecutor(3) as pool:
            jobs = [
                pool.submit(txn.put, "restaurant_topk", top_k_per_restaurant(windows, self.k), replace=replace),
                pool.submit(txn.put, "global_topk", top_k_global(windows, self.k, mode), replace=replace),
                pool.submit(self._grow, txn, new),
            ]
            for j in jobs:
                j.result()

    def _grow(self, txn: Transaction, new: DataFrame | None) -> None:
        """Adds new windows to the levels that they touch; without ``new``, and when many such additions lie there, makes the tree anew."""
        if new is not None and len(txn.mark["tables"].get("tree", {}).get("", [])) in range(1, self.fold + 1):
            stored = txn.read("tree")
            divided = stored.where((F.col("records") > self.limit) & (F.col("level") % 2 == 1))
            finest = startree.records(new)
            txn.put("tree", finest.unionByName(startree.levels(finest, divided, txn.mark["notes"]["divided"], base=False)))
            # of new restaurants' nodes nothing is known, but that the root is divided
            txn.mark["notes"]["whole"] = [x for x in txn.mark["notes"]["whole"] if startree.above(x) == startree.ROOT]
            return
        if new is None or not txn.has("tree"):
            parts = [startree.records(txn.read(t)) for t in ("rollup", "rollup_hours") if txn.has(t)]
            finest = _records_of(parts)
        else:
            finest = _records_of([txn.read("tree").where("level = 0"), startree.records(new)])
        txn.put("tree", finest, replace="all", by=list(CUBE_DIMS))
        finest = txn.last("tree")
        counts = startree.nodes(finest).cache()
        of = {r.level: (r.n, r.d) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("records") > self.limit).alias("d")).collect()}  # 16 levels
        divided = [x for x, (_, d) in of.items() if d]
        whole = [x for x in range(1, startree.ROOT) if of.get(startree.above(x), (1, 0))[0] == of.get(startree.above(x), (1, 0))[1]]
        txn.put("tree", startree.levels(finest, counts.where(F.col("records") > self.limit), divided))
        counts.unpersist()
        txn.mark["notes"] |= {"divided": divided, "whole": whole}

    def merge(self, spark: SparkSession, now_ms: int, *, buffer_ms: int = 86_400_000) -> int:
        """The merge job: windows closed for ``buffer_ms`` become rows of their hours, in the place of the finer ones; up to which instant that is so.

        Coarse rows, the remaining fine ones and the instant are one commit: a run that is killed has changed nothing, and running it again
        does nothing more. Whole hours alone are merged. Sums add and sketches unite, so all sums stay the same.
        """
        hour, day = 3_600_000, 86_400_000
        txn = self.store.begin(spark)
        before, cut = txn.mark["notes"].get("merged_to", 0), (now_ms - buffer_ms) // hour * hour
        if cut <= before:
            return before
        old = txn.read("rollup", None, cut).where(F.col("window_start_1m") < cut)
        if not old.isEmpty():
            txn.put("rollup_hours", merge_rollup(old, "hour"))
            rest = txn.read("rollup", cut, cut).where(F.col("window_start_1m") >= cut)
            border = rest if cut % day and not rest.isEmpty() else None
            gone = [d for d in txn.dates("rollup") if d and starts_ms(d) < cut]
            if border is not None:
                txn.put("rollup", border, replace="dates")
                gone = [d for d in gone if starts_ms(d) + day <= cut]
            txn.drop("rollup", gone)
        txn.mark["notes"]["merged_to"] = cut
        txn.commit()
        return cut

    def rolled(self, spark: SparkSession, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rollup rows that start in [start, end]: of hours where they are merged, else as fine as they came."""
        parts = [self.store.read(spark, t, start, end) for t in ("rollup", "rollup_hours") if t in self.store.mark(spark)["schemas"]]
        columns = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        return parts[0].select(*columns) if len(parts) == 1 else parts[0].select(*columns).unionByName(parts[1].select(*columns))

    def expire(self, spark: SparkSession, now_ms: int, days: int = 30) -> list[str]:
        """Drops the dates that are wholly older, from all tables in one commit, and makes the tree of what stays; the dates."""
        txn, before = self.store.begin(spark), now_ms - days * 86_400_000
        gone = {t: [d for d in txn.dates(t) if d and starts_ms(d) + 86_400_000 <= before] for t in ("rollup", "rollup_hours", "customers", "restaurant_topk", "global_topk")}
        for t, dates in gone.items():
            txn.drop(t, dates)
        if any(gone.values()):
            self._grow(txn, None)
            txn.commit()
        return sorted({d for dates in gone.values() for d in dates})

    def top(self, spark: SparkSession, start: int, end: int, k: int, restaurant: str | None = None, *, by_revenue: bool = False) -> DataFrame:
        """The answer of a request, from the files of its dates."""
        rows = self.store.read(spark, "global_topk" if restaurant is None else "restaurant_topk", start, end)
        return (top_by_revenue if by_revenue else recent_top)(rows, start, end, k, restaurant)

    def engine(self, spark: SparkSession) -> Engine:
        return Engine(lambda s, e: self.store.read(spark, "restaurant_topk", s, e), lambda s, e: self.store.read(spark, "global_topk", s, e))

    def sums(self, spark: SparkSession, dims: list[str], start: int | None = None, end: int | None = None, *, customers: bool | str = False) -> DataFrame:
        """Revenue, quantity and orders by ``dims``, from the smallest table that has them: a level of the tree, or the rollup's dates.

        ``customers``: with the number of distinct ones, estimated from the sketches that are stored beside the sums, or "exact", counted from
        the stored customers, who have no category.
        """
        if customers == "exact":
            return self._with_exact(spark, self.sums(spark, dims, start, end), dims, start, end)
        kind = route(set(dims), time_range=start is not None or end is not None)
        if kind == "cube":
            rows = startree.served(self.store.read(spark, "tree"), dims, self.limit, whole=startree.level_of(set(dims)) in self.store.mark(spark)["notes"]["whole"])
        elif kind == "rollup":
            rows = self.rolled(spark, start, end)
            sketch = [F.hll_union_agg(startree.SKETCH).alias(startree.SKETCH)] if customers else []
            rows = rows.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in startree.SUMS], *sketch)
        else:
            raise ValueError(f"no stored table has {sorted(set(dims))}")
        estimate = [F.hll_sketch_estimate(startree.SKETCH).alias("unique_customers")] if customers else []
        return rows.select(*dims, *startree.SUMS, *estimate)

    def _with_exact(self, spark: SparkSession, sums: DataFrame, dims: list[str], start: int | None, end: int | None) -> DataFrame:
        tables = self.store.mark(spark)["tables"]
        lacking = sorted((tables.get("rollup", {}).keys() | tables.get("rollup_hours", {}).keys()) - tables.get("customers", {}).keys())
        if lacking:
            raise ValueError(f"customers of {len(lacking)} dates aren't stored, {lacking[0]} the first")
        if "category_id" in dims:
            raise ValueError("stored customers have no category")
        found = self.store.read(spark, "customers", start, end).groupBy(*[F.col(d).alias(f"_{d}") for d in dims]).agg(F.count_distinct("customer_id").alias("unique_customers"))
        same = reduce(Column.__and__, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims], F.lit(True))
        return sums.join(found, same, "left").select(*dims, *startree.SUMS, F.coalesce("unique_customers", F.lit(0).cast("bigint")).alias("unique_customers"))


def _records_of(parts: list[DataFrame]) -> DataFrame:
    """The records of several tables' rows, which may lack sketches."""
    rows = reduce(DataFrame.unionByName, [p.select(*startree.COLUMNS) for p in parts])
    return rows if len(parts) == 1 else startree.records(rows)


def compact(fine: DataFrame, now_ms: int, *, buffer_ms: int = 86_400_000, bucket: str = "hour") -> DataFrame:
    """The merge job: windows that have been closed for ``buffer_ms`` are merged into buckets; younger ones aren't touched yet.

    Only whole buckets are merged, so running it again later gives the same rows for them. Sums add, sketches unite.
    """
    cut = F.date_trunc(bucket, event_time(F.lit(now_ms - buffer_ms).cast("bigint")))
    return merge_rollup(fine.where(event_time(F.col("window_start_1m")) < cut), bucket)
