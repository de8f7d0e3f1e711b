"""The given tables as ``market_data``: asset_id, ts, open, high, low, close, volume, seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ticks(df: DataFrame, asset: Column, ts: Column, price: Column, volume: Column, seq: Column) -> DataFrame:
    return df.select(asset.alias("asset_id"), ts.alias("ts"), *[price.alias(n) for n in ("open", "high", "low", "close")], volume.alias("volume"), seq.alias("seq"))


def md_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: one asset for each type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _ticks(e, F.col("event_type"), F.col("ts"), F.col("value"), F.get_json_object("props", "$.k").cast("double"), F.col("event_id"))


def md_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ticks of volume 1: one asset for each priority, many ties in a day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _ticks(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1.0), F.col("o_orderkey"))


def md_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks: one asset for each return flag. seq isn't unique; equal prices end the order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _ticks(li, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_orderkey") * 10 + F.col("l_linenumber"))
