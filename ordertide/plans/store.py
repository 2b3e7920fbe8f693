"""Tables that change together: a commit shows all of its changes or none, and may be repeated.

A transaction writes its rows to new folders and then one mark, a small JSON text that names the folders of every table by date and
the last batch of each writer. Readers take the newest complete mark, so they never see a date half replaced, or one table newer
than another. What a run that was killed has written is in no mark. A store has one writer at a time, and any number of readers.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V = "_v"


@dataclass(frozen=True)
class Kept:
    """How the rows of several commits make a table. ``append``: all of them. ``latest``: of rows of one key those of the last commit. ``add``: sums by key, where columns in ``sketches`` unite and those in ``last`` take the last commit's value.

    ``time``: a column of epoch milliseconds by whose date the folders are divided.
    """

    how: str
    key: tuple[str, ...] = ()
    time: str | None = None
    sort: tuple[str, ...] = ()
    sketches: tuple[str, ...] = ()
    last: tuple[str, ...] = ()


@dataclass(frozen=True)
class Store:
    """``fold``: folders of a date beyond which a commit makes one of them. ``history``: marks whose folders are kept for readers."""

    root: str
    tables: Mapping[str, Kept]
    fold: int = 16
    history: int = 3
    _open: dict = field(default_factory=dict, compare=False, repr=False)

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _marks(self, spark: SparkSession, pattern: str = "*/_SUCCESS") -> list[int]:
        fs, path = self._fs(spark)
        up = (lambda p: p.getParent()) if "/" in pattern else (lambda p: p)
        return sorted(int(up(s.getPath()).getName()) for s in fs.globStatus(path(f"{self.root}/_marks/{pattern}")) or [])

    def mark(self, spark: SparkSession) -> dict:
        """The newest complete mark."""
        done = self._marks(spark)
        if not done:
            return {"n": -1, "batches": {}, "tables": {}, "schemas": {}, "notes": {}}
        if self._open.get("n") != done[-1]:
            text = spark.read.text(f"{self.root}/_marks/{done[-1]:010d}", wholetext=True).first()[0]
            self._open.clear()
            self._open.update(n=done[-1], mark=json.loads(text), frames={})
        return self._open["mark"]

    def exists(self, spark: SparkSession) -> bool:
        return bool(self._marks(spark))

    def begin(self, spark: SparkSession) -> Transaction:
        return Transaction(self, spark, copy.deepcopy(self.mark(spark)))

    def read(self, spark: SparkSession, name: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """The table as of the newest commit, or what lies in the dates of [start, end], by its time column; both ends are optional.

        The files of a table are listed once for each commit and range of dates.
        """
        mark, days = self.mark(spark), None
        if start_ms is not None or end_ms is not None:
            days = (None if start_ms is None else int(start_ms // 86_400_000), None if end_ms is None else int(end_ms // 86_400_000))
        at = (spark.sparkContext.applicationId, name, days)
        if at not in self._open["frames"] if mark["n"] >= 0 else True:
            df = self._frame(spark, mark, name, days)
            if mark["n"] < 0:
                return df
            if len(self._open["frames"]) > 256:
                self._open["frames"].clear()
            self._open["frames"][at] = df
        df = self._open["frames"][at]
        time = self.tables[name].time
        if start_ms is not None:
            df = df.where(F.col(time) >= start_ms)
        return df if end_ms is None else df.where(F.col(time) <= end_ms)

    def _frame(self, spark: SparkSession, mark: dict, name: str, days: tuple | None = None) -> DataFrame:
        kept, dates = self.tables[name], mark["tables"].get(name, {})
        if name not in mark["schemas"]:
            raise ValueError(f"nothing is stored in {name}")
        schema = T.StructType.fromJson(mark["schemas"][name])
        if days is not None:
            low, high = days
            dates = {d: f for d, f in dates.items() if d and (low is None or _day(d) >= low) and (high is None or _day(d) <= high)}
        once, often = [f[0] for f in dates.values() if len(f) == 1], [x for f in dates.values() if len(f) > 1 for x in f]

        def of(folders: list) -> DataFrame | None:
            return spark.read.schema(T.StructType([*schema.fields, T.StructField(_V, T.LongType())])).parquet(*[f"{self.root}/{p}" for _, p in folders]) if folders else None

        parts = [x for x in (of(once), of(often)) if x is not None]
        if not parts:
            return spark.createDataFrame([], schema)
        if kept.how == "append":
            return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).drop(_V)
        merged = [_merged(of(often), kept, schema.names)] if often else []
        merged += [of(once).drop(_V)] if once else []
        return merged[0] if len(merged) == 1 else merged[0].unionByName(merged[1])

    def expire(self, spark: SparkSession, name: str, before_ms: int) -> list[str]:
        """Drops the dates that lie wholly before an instant; their names."""
        txn = self.begin(spark)
        dates = txn.mark["tables"].get(name, {})
        gone = sorted(d for d in dates if d and (_day(d) + 1) * 86_400_000 <= before_ms)
        txn.drop(name, gone)
        if gone:
            txn.commit()
        return gone

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes folders that none of the last ``history`` marks names, and marks before them; the number of folders."""
        fs, path = self._fs(spark)
        done = self._marks(spark)
        held = set()
        for n in done[-self.history :]:
            m = json.loads(spark.read.text(f"{self.root}/_marks/{n:010d}", wholetext=True).first()[0])
            held |= {p.split("/")[1] for dates in m["tables"].values() for f in dates.values() for _, p in f}
        gone = [s.getPath() for name in self.tables for s in fs.globStatus(path(f"{self.root}/{name}/*")) or [] if s.getPath().getName() not in held]
        old = [path(f"{self.root}/_marks/{n:010d}") for n in self._marks(spark, "*") if done and n < done[-self.history :][0]]
        for p in [*gone, *old]:
            fs.delete(p, True)
        return len(gone)


def _day(text: str) -> int:
    return (date.fromisoformat(text) - date(1970, 1, 1)).days


def starts_ms(text: str) -> int:
    """The first instant of a date."""
    return _day(text) * 86_400_000


def _merged(rows: DataFrame, kept: Kept, columns: list[str]) -> DataFrame:
    if kept.how == "append":
        return rows.drop(_V)
    if kept.how == "latest":
        newest = rows.groupBy(*kept.key).agg(F.max(_V).alias("_w"))
        same = [rows[k].eqNullSafe(newest[k]) for k in kept.key]
        return rows.join(newest, [*same, F.col(_V) == F.col("_w")], "left_semi").select(*columns)
    rest = [c for c in columns if c not in kept.key]
    total = lambda c: (F.hll_union_agg(c) if c in kept.sketches else F.max_by(c, _V) if c in kept.last else F.sum(c)).alias(c)
    return rows.groupBy(*kept.key).agg(*[total(c) for c in rest]).select(*columns)


class Transaction:
    """Changes that ``commit`` shows at once. ``read`` sees what the transaction has put."""

    def __init__(self, store: Store, spark: SparkSession, mark: dict):
        self.store, self.spark, self.mark = store, spark, mark
        taken = store._marks(spark, "*")
        self.n = max([mark["n"], *taken]) + 1  # a killed run leaves a number taken

    def done(self, writer: str, batch: int) -> bool:
        """Whether this writer's batch is in: a replay need not do it again."""
        return self.mark["batches"].get(writer, -1) >= batch

    def read(self, name: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """The table, or the dates that [start, end] touches, whole."""
        days = None if start_ms is None and end_ms is None else tuple(None if x is None else int(x // 86_400_000) for x in (start_ms, end_ms))
        return self.store._frame(self.spark, self.mark, name, days)

    def dates(self, name: str) -> list[str]:
        return sorted(self.mark["tables"].get(name, {}))

    def has(self, name: str) -> bool:
        return name in self.mark["schemas"]

    def drop(self, name: str, dates: list[str]) -> None:
        """Leaves dates out of the table."""
        for d in dates:
            self.mark["tables"].get(name, {}).pop(d, None)

    def last(self, name: str) -> DataFrame:
        """What the transaction has put there."""
        dates = {d: [x for x in f if x[0] == self.n] for d, f in self.mark["tables"].get(name, {}).items()}
        return self.store._frame(self.spark, {"schemas": self.mark["schemas"], "tables": {name: {d: f for d, f in dates.items() if f}}}, name)

    def put(self, name: str, rows: DataFrame, *, replace: str | None = None, by: list[str] | None = None) -> None:
        """Adds rows. ``replace`` "dates": the dates that ``rows`` holds hold nothing else then; "all": nor does any other.

        A date's rows lie together, those of a large one in several files of about the advised size; rows without dates are dealt to ranges of ``by``.
        """
        kept = self.store.tables[name]
        folder = f"{name}/{self.n}-{uuid.uuid4().hex}"
        schema = rows.schema if not self.has(name) else T.StructType.fromJson(self.mark["schemas"][name])
        out = rows.select(*schema.names).withColumn(_V, F.lit(self.n).cast("bigint"))
        if kept.time:
            out = out.withColumn("dt", F.date_from_unix_date(F.floor(F.col(kept.time) / 86_400_000).cast("int"))).hint("rebalance", F.col("dt"))
        elif by:
            out = out.repartitionByRange(*by)
        if kept.sort:
            out = out.sortWithinPartitions(*(["dt"] if kept.time else []), *kept.sort)
        w = out.write.option("compression", "zstd")
        (w.partitionBy("dt") if kept.time else w).parquet(f"{self.store.root}/{folder}")
        fs, path = self.store._fs(self.spark)
        dates = self.mark["tables"].setdefault(name, {})
        if kept.time:
            found = {s.getPath().getName().partition("=")[2]: f"{folder}/{s.getPath().getName()}" for s in fs.globStatus(path(f"{self.store.root}/{folder}/dt=*")) or []}
            found = {("" if d.startswith("__") else d): p for d, p in found.items()}
        else:
            found = {"": folder}
        if replace == "all":
            dates.clear()
        for d, p in found.items():
            dates[d] = [*([] if replace else dates.get(d, [])), [self.n, p]]
        self.mark["schemas"][name] = schema.jsonValue()

    def fold(self, name: str) -> list[str]:
        """Makes one folder of each date that has more than ``fold``; the dates."""
        dates = self.mark["tables"].get(name, {})
        many = {d: f for d, f in dates.items() if len(f) > self.store.fold}
        for d, folders in many.items():
            one = {"schemas": self.mark["schemas"], "tables": {name: {d: folders}}}
            self.put(name, self.store._frame(self.spark, one, name), replace="dates")
        return sorted(many)

    def commit(self, writer: str | None = None, batch: int = 0) -> int:
        """Shows the changes; the number of the mark. Raises if another writer has taken it."""
        if writer is not None:
            self.mark["batches"][writer] = batch
        self.mark["n"] = self.n
        text = self.spark.createDataFrame([(json.dumps(self.mark),)], "mark string")
        text.coalesce(1).write.mode("error").text(f"{self.store.root}/_marks/{self.n:010d}")
        return self.n
