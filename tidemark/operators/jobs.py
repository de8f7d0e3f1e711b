"""Jobs: assets, ingest, pattern update, refresh of the stored views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.candle import candle_pattern
from tidemark.sources.bars_csv import append_market_data, parse_bars, read_bars_csv, read_bars_files
from tidemark.sources.commits import Commits
from tidemark.sources.market_store import CLUSTERED, MarketStore
from tidemark.sources.schemas import conform
from tidemark.sources.storage import stored

from . import views


ATTRIBUTES = ["name", "asset_class", "currency", "exchange", "timezone"]


def assets_get_or_create(existing: DataFrame, incoming: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(asset of every incoming symbol, the new ones to append), both as ``assets`` rows. Of a symbol that ``existing`` holds
    twice, the one listed first counts, then the least id. Incoming symbols may repeat and may come with ATTRIBUTES, of which
    the least of each counts; null symbols are dropped."""
    listed = F.coalesce(now, F.current_timestamp()) if now is not None else F.current_timestamp()
    given = [F.min(c).alias(c) for c in ATTRIBUTES if c in incoming.columns]
    wanted = incoming.filter(F.col("symbol").isNotNull())
    wanted = wanted.groupBy("symbol").agg(*given) if given else wanted.select("symbol").distinct()
    new = wanted.join(existing.select("symbol"), "symbol", "left_anti").withColumns({
        "id": F.concat(F.lit("asset:"), "symbol"),
        "tick_size": F.lit(0.1),
        "lot_size": F.lit(0.1),
        "price_decimals": F.lit(1).cast("short"),
        "active": F.lit(True),
        "first_listed_ts": listed,
    })
    new = conform(new, "assets")
    first = W.partitionBy("symbol").orderBy("first_listed_ts", "id")
    known = existing.join(wanted.select("symbol"), "symbol", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return conform(known, "assets").unionByName(new), new


def ingest_csv(spark: SparkSession, path: str, symbol: str, assets_path: str, market_path: str, source: str = "csv", **attributes: str) -> None:
    """Asset first, in a write of its own, then the file's rows: a bad file leaves the asset and no rows. A file of
    only a header writes no rows. ``attributes`` are any of ATTRIBUTES, for an asset that is new."""
    if unknown := set(attributes) - set(ATTRIBUTES):
        raise ValueError(f"not an attribute of an asset: {sorted(unknown)}")
    incoming = spark.range(1).select(F.lit(symbol).alias("symbol"), *[F.lit(v).alias(k) for k, v in attributes.items()])
    existing = stored(spark, assets_path)
    if existing is None:
        existing = conform(incoming.limit(0), "assets")
    found, new = assets_get_or_create(existing, incoming)
    asset_id = found.select("id").first()[0]
    new.write.mode("append").parquet(assets_path)
    append_market_data(read_bars_csv(spark, path, asset_id, source), market_path)


def ingest_files(store: MarketStore, files: list[dict[str, str]], source: str = "csv", load_id: str | None = None) -> str:
    """Many bar files in one load: ``files`` has a path (a file, or a folder of such), a symbol and any of ATTRIBUTES for each. The
    assets come first, all in one commit, then all rows, in another: one bad row in any file leaves the assets and no
    rows. A retry with the same id adds nothing twice."""
    spark = store.spark
    if unknown := {k for f in files for k in f} - {"path", "symbol", *ATTRIBUTES}:
        raise ValueError(f"not an attribute of an asset: {sorted(unknown)}")
    kinds = ", ".join(f"{c} string" for c in ("path", "symbol", *ATTRIBUTES))
    given = spark.createDataFrame([tuple(f.get(c) for c in ("path", "symbol", *ATTRIBUTES)) for f in files], kinds)
    assets = store.get_or_create(given.drop("path"), assets_get_or_create)
    named = given.select("path", "symbol").join(assets.select("symbol", F.col("id").alias("asset_id")), "symbol").drop("symbol")
    rows = read_bars_files(spark, [f["path"] for f in files]).join(F.broadcast(named), "path")
    return store.append(parse_bars(rows, F.col("asset_id"), source), load_id)


def update_daily_patterns(daily: DataFrame) -> DataFrame:
    """Daily bars with ``day_candle_pattern``."""
    return daily.withColumn("day_candle_pattern", candle_pattern(*[F.col(c) for c in ("open", "high", "low", "close")]))


def of_days(md: DataFrame, dates: list[dt.date]) -> DataFrame:
    """Rows of some days: by the stored partition where there is one, and by a range of times that reaches the scan."""
    if "trade_date" in md.columns:
        md = md.filter(F.col("trade_date").isin(dates))
    first, after = (dt.datetime.combine(d, dt.time()) for d in (min(dates), max(dates) + dt.timedelta(days=1)))
    ts = F.col("ts")
    return md.filter((ts >= F.lit(first).cast(md.schema["ts"].dataType)) & (ts < F.lit(after).cast(md.schema["ts"].dataType)) & times.day(ts).isin(dates))


#: The stored views with the column that each is partitioned by.
STORED = {"session_agg": "trade_date", "daily_agg": "trade_date", "weekday_agg": "week_start", "weekly_agg": "week_start", "monthly_agg": "month_start"}


def refresh(md: DataFrame, out: str, dates: list[dt.date] | None = None) -> None:
    """Recompute the stored views, each with its labels, clustered by asset within its partitions. With ``dates``, only those dates'
    session and day partitions and the weeks and months that they lie in are replaced, and only their rows and days are
    read; a partition that has no rows any more goes."""
    spark = md.sparkSession
    if dates is not None and not dates:
        return
    mode = {"partitionOverwriteMode": "dynamic" if dates is not None else "static"}

    def store(name: str, view: DataFrame, touched: list[dt.date] | None) -> DataFrame:
        path, by, rows = f"{out}/{name}", STORED[name], views.with_labels(view)
        rows.hint("rebalance", by).sortWithinPartitions(by, "asset_id").write.options(**mode, **CLUSTERED).mode("overwrite").partitionBy(by).parquet(path)
        made = spark.read.schema(rows.schema).parquet(path)
        if touched is not None:
            # at most one row for each of the dates
            kept = {r[0] for r in view.filter(F.col(by).isin(touched)).select(by).distinct().collect()}
            for gone in sorted(set(touched) - kept):
                Commits(spark, out).drop(f"{out.rstrip('/')}/{name}/{by}={gone}")
            made = spark.read.schema(rows.schema).parquet(path).filter(F.col(by).isin(touched))
        return made

    sessions = store("session_agg", views.session_agg(md if dates is None else of_days(md, dates)), dates)
    store("daily_agg", update_daily_patterns(views.daily_agg(views.by_one_asset(sessions))), dates)
    daily = spark.read.schema(update_daily_patterns(views.with_labels(views.daily_agg(sessions))).schema).parquet(f"{out}/daily_agg")
    weeks, months, mondays, firsts = daily, daily, None, None
    if dates is not None:
        mondays = sorted({d - dt.timedelta(days=d.weekday()) for d in dates})
        firsts = sorted({d.replace(day=1) for d in dates})
        days = {m + dt.timedelta(days=i) for m in mondays for i in range(7)}
        weeks = daily.filter(F.col("trade_date").isin(sorted(days)))
        in_month = F.lit(False)
        for f in firsts:
            in_month = in_month | ((F.col("trade_date") >= F.lit(f)) & (F.col("trade_date") < F.add_months(F.lit(f), 1)))
        months = daily.filter(in_month)
    weeks, months = views.by_one_asset(weeks), views.by_one_asset(months)
    store("weekday_agg", views.weekday_agg(weeks), mondays)
    store("weekly_agg", views.weekly_agg(weeks), mondays)
    store("monthly_agg", views.monthly_agg(months), firsts)


def refresh_changed(store: MarketStore, out: str) -> list[dt.date]:
    """Bring the stored views up to date with the loads and retractions since the last call, which the views' own commits name;
    the days that were looked at. A refresh that dies is done again by the next."""
    marks = Commits(store.spark, out)
    done = marks.read()
    days, number = store.changed_days(done[-1]["loads"] if done else 0)
    if days:
        refresh(store.market_data(days), out, days)
        marks.add(lambda before: {"loads": number})
    return days
