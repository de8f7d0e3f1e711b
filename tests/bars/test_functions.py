import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.candle import Thresholds, candle_pattern, register_sql_functions
from tidemark.functions.session import session_label, session_parse

NAN, INF = math.nan, math.inf
PATTERNS = [
    (5.0, 5.0, 5.0, 5.0, "Unknown"),
    (1.0, 0.0, 5.0, 2.0, "Unknown"),
    (5.0, 10.0, 0.0, 5.5, "Doji/SpinningTop"),
    (5.0, 10.0, 0.0, 6.0, "Doji/SpinningTop"),  # body 0.1, the edge
    (7.0, 10.0, 0.0, 9.0, "Bullish Hammer"),
    (9.0, 10.0, 0.0, 7.0, "Bearish Hammer"),
    (1.0, 10.0, 0.0, 3.0, "Bullish Shooting Star"),
    (3.0, 10.0, 0.0, 1.0, "Bearish Shooting Star"),
    (1.0, 10.0, 0.0, 9.0, "Bullish Long Body"),
    (9.0, 10.0, 0.0, 1.0, "Bearish Long Body"),
    (2.0, 10.0, 0.0, 7.0, "Bullish Long Body"),  # body 0.5, the edge
    (3.0, 10.0, 0.0, 7.0, "Mild Bullish"),
    (7.0, 10.0, 0.0, 3.0, "Mild Bearish"),
    (4.0, 10.0, 0.0, 6.0, "Mild Bullish"),
    (1.0, 2.0, 0.0, NAN, "Mild Bearish"),
    (NAN, 1.0, 1.0, 2.0, "Unknown"),
    (None, 2.0, 1.0, 1.0, None),
]


def test_patterns(spark):
    df = spark.createDataFrame(PATTERNS, "o double, h double, l double, c double, expected string")
    register_sql_functions(spark)
    got = df.select("*", candle_pattern(F.col("o"), F.col("h"), F.col("l"), F.col("c")).alias("p"), F.expr("candle_pattern(o, h, l, c)").alias("s")).collect()
    assert [r.p for r in got] == [r.expected for r in got]
    assert [r.s for r in got] == [r.expected for r in got]


def test_custom_thresholds(spark):
    df = spark.createDataFrame([(4.0, 10.0, 0.0, 6.0)], "o double, h double, l double, c double")
    cols = [F.col(c) for c in "ohlc"]
    assert df.select(candle_pattern(*cols, Thresholds(doji=0.2))).first()[0] == "Doji/SpinningTop"
    assert df.select(candle_pattern(*cols, Thresholds(long=0.2))).first()[0] == "Bullish Long Body"


def test_every_hour_has_its_session(spark):
    register_sql_functions(spark)
    df = spark.range(25).select("id", F.when(F.col("id") < 24, F.expr("timestamp'2024-01-05 00:30:00' + make_interval(0,0,0,0,int(id),0,0)")).alias("ts"))
    got = df.select(session_label(F.col("ts")).alias("a"), F.expr("session_from_timestamp(ts)").alias("b")).collect()
    expected = ["AS"] * 8 + ["LN"] * 7 + ["NYAM"] * 3 + ["NYL"] * 2 + ["NYPM"] * 4 + [None]
    assert [r.a for r in got] == expected == [r.b for r in got]


def test_parse_session(spark):
    df = spark.createDataFrame([("as",), ("NyAm",), ("None",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(session_parse(F.col("s"))).collect()] == ["AS", "NYAM", None, None, None]
    with pytest.raises(Exception, match="not a session"):
        df.select(session_parse(F.col("s"), strict=True)).collect()


def test_times(spark):
    df = spark.createDataFrame([("2021.01.03 13:45:10",)], "s string").select(times.parse_ymd_hms(F.col("s")).alias("t"))
    t = F.col("t")
    row = df.select(times.week_label(t), times.week_start(t), times.month_start(t), times.weekday_name(t), times.month_name(t), times.hour_minute(t), times.iso_seconds(t)).first()
    assert row[0] == "Week 53" and str(row[1]) == "2020-12-28" and str(row[2]) == "2021-01-01"
    assert list(row[3:]) == ["Sun", "Jan", "13:45", "2021-01-03T13:45:10Z"]
