"""Stored ``market_data`` and ``assets``: loads that count whole or not at all.

``<root>/loads/load_id=<id>/trade_date=<day>/`` holds the rows of one load. A load counts once it is committed (``commits``),
and until it is retracted; what a job that died left behind is never read, and a retry with the same id replaces it. Assets are
committed the same way, so two jobs that meet a new symbol agree on one asset.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import times

from .commits import Commits
from .schemas import columns, conform


class MarketStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.loads, self.assets = Commits(spark, f"{self.root}/loads"), Commits(spark, f"{self.root}/assets")

    # ---- rows

    def committed(self) -> dict[str, list[str]]:
        """The loads that count, each with its days."""
        out: dict[str, list[str]] = {}
        for c in self.loads.read():
            if "add" in c:
                out[c["add"]] = c["days"]
            else:
                out.pop(c["retract"], None)
        return out

    def append(self, bars: DataFrame, load_id: str | None = None) -> str:
        """Store the rows as one load, partitioned by day and clustered by asset, and commit it. Nothing is added where a load
        of this id was committed before, retracted or not; loads of different ids may repeat rows. No row, no load."""
        load_id = load_id or uuid.uuid4().hex
        if any(load_id == c.get("add") for c in self.loads.read()):
            return load_id
        path = f"{self.loads.root}/load_id={load_id}"
        write_days(conform(bars, "market_data").drop("id"), path, "overwrite")
        days = self._days_of(path)
        if days:
            self.loads.add(lambda before: None if any(load_id == c.get("add") for c in before) else {"add": load_id, "days": days})
        return load_id

    def _days_of(self, path: str) -> list[str]:
        """The partitions that a load wrote; a load without rows has none."""
        return sorted(n.removeprefix("trade_date=") for n in self.loads.listed(path) if n.startswith("trade_date="))

    def retract(self, load_id: str) -> None:
        """Take a committed load back; its rows are no longer read. Nothing happens where it doesn't count."""
        def change(before: list[dict]) -> dict | None:
            last = [c for c in before if load_id in (c.get("add"), c.get("retract"))]
            return {"retract": load_id, "days": last[-1]["days"]} if last and "add" in last[-1] else None

        self.loads.add(change)

    def market_data(self, days: list[dt.date] | None = None) -> DataFrame:
        """The rows of all loads that count; of some days only, if given, and then no other day's files are listed."""
        wanted = None if days is None else {str(d) for d in days}
        held = {load: [d for d in own if wanted is None or d in wanted] for load, own in self.committed().items()}
        if wanted is None:
            paths = [f"{self.loads.root}/load_id={load}" for load, own in held.items() if own]
        else:
            paths = [f"{self.loads.root}/load_id={load}/trade_date={d}" for load, own in held.items() for d in own]
        kinds = ", ".join(f"{name} {kind}" for name, kind, _ in columns("market_data") if name != "id")
        schema = f"{kinds}, load_id string, trade_date date"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.loads.root).parquet(*paths)

    def days(self) -> list[dt.date]:
        """Days with rows, the newest first, from the commits alone."""
        return sorted({dt.date.fromisoformat(d) for own in self.committed().values() for d in own}, reverse=True)

    def latest(self, asset_id: str, n: int) -> DataFrame:
        """The asset's newest ``n`` rows, newest first; seq breaks ties. Days are read from the newest back, twice as many each time,
        until they hold so many rows of it: one that trades often costs the last days' files, however long its history."""
        days, taken, count, step = self.days(), 0, 0, 1
        while taken < len(days) and count < n:
            some = days[taken : taken + step]
            count += self.market_data(some).filter(F.col("asset_id") == asset_id).limit(n - count).count()
            taken, step = taken + len(some), step * 2
        return self.market_data(days[:taken]).filter(F.col("asset_id") == asset_id).orderBy(F.desc("ts"), F.desc("seq")).limit(n)

    def changed_days(self, after: int) -> tuple[list[dt.date], int]:
        """(days that loads and retractions above a commit number touched, the last number)."""
        new = self.loads.read(after)
        return sorted({dt.date.fromisoformat(d) for c in new for d in c["days"]}), new[-1]["number"] if new else after

    # ---- assets

    def all_assets(self) -> DataFrame:
        paths = [f"{self.assets.root}/{c['add']}" for c in self.assets.read()]
        return conform(self.spark.read.parquet(*paths) if paths else self.spark.range(0).select(), "assets")

    def get_or_create(self, incoming: DataFrame, make: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """The asset of every incoming symbol, new ones stored. ``make(existing, incoming)`` gives (found, new). Where another job
        committed assets meanwhile, new ones are made again beside what it committed, so a symbol has one asset."""
        while True:
            known = len(self.assets.numbers())
            found, new = make(self.all_assets(), incoming)
            name = f"part-{uuid.uuid4().hex}"
            path = f"{self.assets.root}/{name}"
            new.write.parquet(path)
            nothing = self.spark.read.parquet(path).isEmpty()
            if not nothing and self.assets.add(lambda before, known=known, name=name: {"add": name} if len(before) == known else None):
                return make(self.all_assets(), incoming)[0]
            self.assets.drop(path)
            if nothing:
                return found


#: A read of one asset skips row groups whose bloom filter lacks it.
CLUSTERED = {"parquet.bloom.filter.enabled#asset_id": "true", "parquet.bloom.filter.expected.ndv#asset_id": "10000"}


def write_days(bars: DataFrame, path: str, mode: str) -> None:
    """Write rows by day, clustered by asset and time. They are rebalanced by day first: small days share a task, a large one is
    split among several, and no day has a file of each task."""
    dealt = bars.withColumn("trade_date", times.day(F.col("ts"))).hint("rebalance", "trade_date")
    dealt.sortWithinPartitions("trade_date", "asset_id", "ts").write.options(**CLUSTERED).mode(mode).partitionBy("trade_date").parquet(path)
