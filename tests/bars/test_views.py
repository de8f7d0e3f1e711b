import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import bars, jobs, reads, views
from tidemark.sources.adapters import md_events, md_orders
from tidemark.sources.bars_csv import append_market_data

SF = "/root/testdata/sf0.001"
COLS = ["open", "high", "low", "close", "volume", "high_ts", "low_ts"]


def rows(df, keys):
    return sorted(map(tuple, df.select(*keys, *COLS).collect()), key=str)


def test_roll_up_from_children_equals_base(spark):
    md = md_orders(spark, SF)
    daily = views.daily_agg(views.session_agg(md))
    week = F.to_date(F.date_trunc("week", "ts")).alias("week_start")
    assert rows(views.weekly_agg(daily), ["asset_id", "week_start"]) == rows(bars.base_bars(md, ["asset_id", week]), ["asset_id", "week_start"])
    assert views.weekday_agg(daily).count() == daily.count()
    assert views.monthly_agg(daily).agg(F.sum("volume")).first()[0] == md.count()


def test_row_order_and_partitions_do_not_matter(spark):
    md = md_events(spark, SF)
    assert rows(views.session_agg(md), ["asset_id", "trade_date", "session"]) == rows(views.session_agg(md.orderBy(F.desc("volume")).repartition(7)), ["asset_id", "trade_date", "session"])


def test_ties_nulls_and_extra_columns(spark):
    t = dt.datetime(2024, 1, 1, 9)
    u = dt.datetime(2024, 1, 1, 10)
    data = [("a", t, 1.0, 5.0, 1.0, 2.0, 1.0, 1, "x"), ("a", t, 9.0, 5.0, None, 3.0, 1.0, 0, "x"), ("a", u, None, None, 1.0, 7.0, None, 2, "x"), ("b", t, 1.0, None, None, 1.0, None, None, "x")]
    md = spark.createDataFrame(data, "asset_id string, ts timestamp, open double, high double, low double, close double, volume double, seq long, trade_date string")
    a, b = sorted(views.session_agg(md).collect())
    assert (a.open, a.high, a.low, a.close, a.volume, a.high_ts, a.low_ts) == (9.0, 5.0, 1.0, 7.0, 2.0, t, t)
    assert (b.high, b.volume, b.high_ts) == (None, None, None)
    assert views.session_agg(md.limit(0)).count() == 0


def test_a_nan_high_has_its_own_time(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in (9, 10, 11)]
    nan = float("nan")
    data = [("a", t[0], 1.0, 5.0, 1.0, 2.0, 1.0, 1), ("a", t[1], 1.0, nan, nan, 2.0, 1.0, 2), ("a", t[2], 1.0, nan, 0.5, 2.0, 1.0, 3)]
    md = spark.createDataFrame(data, "asset_id string, ts timestamp, open double, high double, low double, close double, volume double, seq long")
    day = views.daily_agg(views.session_agg(md)).first()
    assert day.high != day.high and day.high_ts == t[1] and (day.low, day.low_ts) == (0.5, t[2])


def test_all_rows_share_the_session_bars(spark):
    rows = views.all_rows(views.define_views(md_events(spark, SF)))
    counts = {r.view: r["count"] for r in rows.groupBy("view").count().collect()}
    assert counts["daily_agg"] == counts["weekday_agg"] and set(counts) == set(jobs.STORED)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "candle_pattern" in plan


def test_reads_and_projections(spark):
    md = md_events(spark, SF)
    md.createOrReplaceTempView("md_events")
    assert reads.latest_n(md, "click", 5).collect() == reads.latest_n_sql(spark, "md_events", "click", 5).collect()
    assert "TakeOrderedAndProject" in reads.latest_n(md, "click", 5)._jdf.queryExecution().executedPlan().toString()
    labelled = views.define_views(md)["session_agg"]
    assert views.projection(labelled, "ts").columns == ["asset_id", "trade_date", "session", "high", "low", "volume", "candle_pattern", "high_ts", "low_ts"]


def test_filters_and_columns_reach_the_scan(spark):
    plan = reads.by_asset(md_orders(spark, SF).select("asset_id", "ts", "open"), "1-URGENT")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_custkey" not in plan


def test_assets(spark):
    kind = "id string, symbol string, tick_size double, lot_size double, price_decimals short, active boolean, first_listed_ts timestamp"
    at = dt.datetime(2020, 1, 1)
    old = spark.createDataFrame([("1", "X", 0.5, 0.5, 2, True, at), ("0", "X", 0.7, 0.5, 2, True, at)], kind)
    found, new = jobs.assets_get_or_create(old, spark.createDataFrame([("X",), ("Y",), ("Y",), (None,)], "symbol string"))
    assert sorted((r.symbol, r.id, r.tick_size) for r in found.collect()) == [("X", "0", 0.7), ("Y", "asset:Y", 0.1)]
    assert [r.symbol for r in new.collect()] == ["Y"]


def test_refresh_of_touched_days(spark, tmp_path):
    out = str(tmp_path / "views")
    md = md_events(spark, SF)
    jobs.refresh(md, out)
    before = {r.trade_date: r.volume for r in spark.read.parquet(f"{out}/daily_agg").groupBy("trade_date").agg(F.sum("volume").alias("volume")).collect()}
    day = min(before)
    stored = spark.read.parquet(f"{out}/session_agg")
    assert {"candle_pattern", "high_hm", "low_hm"} <= set(stored.columns) and "day_candle_pattern" in spark.read.parquet(f"{out}/daily_agg").columns
    twice = md.withColumn("volume", F.when(F.to_date("ts") == F.lit(day), F.col("volume") * 2).otherwise(F.col("volume")))
    jobs.refresh(twice, out, [day])
    after = {r.trade_date: r.volume for r in spark.read.parquet(f"{out}/daily_agg").groupBy("trade_date").agg(F.sum("volume").alias("volume")).collect()}
    assert after == before | {day: before[day] * 2}
    assert spark.read.parquet(f"{out}/weekly_agg").agg(F.sum("volume")).first()[0] == sum(after.values())


def test_a_refresh_of_one_day_reads_one_partition(spark, tmp_path):
    path, out = str(tmp_path / "md"), str(tmp_path / "views")
    append_market_data(md_events(spark, SF), path)
    md = spark.read.parquet(path)
    jobs.refresh(md, out)
    day = dt.date(2024, 1, 9)
    one = jobs.of_days(md, [day])
    assert {f.split("trade_date=")[1][:10] for f in one.inputFiles()} > {"2024-01-09"}  # files of the table, before pruning
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "2024-01-09" in scan.split("PartitionFilters")[1][:200] and "GreaterThanOrEqual(ts" in scan
    before = {(r.week_start, r.asset_id): r.volume for r in spark.read.parquet(f"{out}/weekly_agg").collect()}
    jobs.refresh(md.withColumn("volume", F.when(F.to_date("ts") == F.lit(day), F.col("volume") + 1).otherwise(F.col("volume"))), out, [day])
    after = {(r.week_start, r.asset_id): r.volume for r in spark.read.parquet(f"{out}/weekly_agg").collect()}
    assert {w for w, _ in before if any(after[k] != before[k] for k in before if k[0] == w)} == {dt.date(2024, 1, 8)}
