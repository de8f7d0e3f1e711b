from pyspark.sql import functions as F

from tidemark.operators import views
from tidemark.sources.adapters import md_events
from tidemark.streaming import bars as streams

SF = "/root/testdata/sf0.001"


def stream_of(spark, tmp_path):
    src = str(tmp_path / "src")
    md_events(spark, SF).coalesce(1).write.parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)


def collected(spark, df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_closed_days_agree_with_batch(spark, tmp_path):
    got = collected(spark, streams.session_bars(stream_of(spark, tmp_path)), "s1")
    batch = views.session_agg(md_events(spark, SF))
    keys = ["asset_id", "trade_date", "session", "open", "high", "low", "close", "volume"]
    a, b = {tuple(r) for r in got.select(keys).collect()}, {tuple(r) for r in batch.select(keys).collect()}
    assert a and a <= b and {r for r in b if r[1] < max(r[1] for r in b)} - a == set()


def test_weeks_start_on_monday(spark, tmp_path):
    got = collected(spark, streams.weekly_bars(stream_of(spark, tmp_path)), "s2")
    assert got.count() and {r[0] for r in got.select(F.dayofweek("week_start")).collect()} == {2}


def test_months_merge_once(spark, tmp_path):
    write, out = streams.merge_months(str(tmp_path / "m")), str(tmp_path / "m")
    daily = views.daily_agg(views.session_agg(md_events(spark, SF)))
    write(daily.filter("trade_date < '2024-01-10'"), 0)
    write(daily.filter("trade_date >= '2024-01-10'"), 1)
    write(daily.filter("trade_date >= '2024-01-10'"), 1)
    cols = ["asset_id", "month_start", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, streams.months(spark, out).select(cols).collect())) == sorted(map(tuple, views.monthly_agg(daily).select(cols).collect()))
