"""Bars as streams: session, day and week windows, and month bars merged batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import session_label
from tidemark.operators.bars import bar_aggregates, grouped, roll_up, tick_aggregates

#: A week's window starts on Monday; plain weeks start on Thursday, as the epoch did.
WEEK = ("7 days", "7 days", "4 days")


def _windowed(ticks: DataFrame, window: Column, keys: list[Column | str], late: str) -> DataFrame:
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return grouped(ticks, [window.alias("w"), "asset_id", *keys], tick_aggregates())


def session_bars(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Session bars; a day's rows come out once the watermark has passed the day."""
    bars = _windowed(ticks, F.window("ts", "1 day"), [session_label(F.col("ts").cast("timestamp")).alias("session")], late)
    return bars.withColumn("trade_date", F.to_date("w.start")).drop("w")


def daily_bars(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    return _windowed(ticks, F.window("ts", "1 day"), [], late).withColumn("trade_date", F.to_date("w.start")).drop("w")


def weekly_bars(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    return _windowed(ticks, F.window("ts", *WEEK), [], late).withColumn("week_start", F.to_date("w.start")).drop("w")


def merge_months(out: str):
    """A ``foreachBatch`` function for closed daily bars. Each batch's days are rolled up to a bar for each month that they lie in,
    with its first day, and stored under the batch's id, so a batch that runs twice replaces itself. Days close in order, so batches'
    bars of a month do too."""

    def write(batch: DataFrame, batch_id: int) -> None:
        month = F.trunc("trade_date", "MM")
        parts = grouped(batch, ["asset_id", month.alias("month_start")], bar_aggregates("trade_date") | {"first_day": "min(trade_date)"})
        parts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def months(spark, out: str) -> DataFrame:
    """Month bars of all batches: an asset has a row for each batch and month, not for each day."""
    return roll_up(spark.read.parquet(out), ["asset_id", "month_start"], "first_day")
