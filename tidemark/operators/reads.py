"""Reads by asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_n(md: DataFrame, asset_id: str, n: int) -> DataFrame:
    """The asset's newest ``n`` bars, newest first; seq breaks ties."""
    return md.filter(F.col("asset_id") == asset_id).orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def latest_n_sql(spark: SparkSession, view: str, asset_id: str, n: int) -> DataFrame:
    """The same over a named view, with bound parameters."""
    return spark.sql("SELECT * FROM IDENTIFIER(:view) WHERE asset_id = :asset_id ORDER BY ts DESC, seq DESC LIMIT :n", args={"view": view, "asset_id": asset_id, "n": n})


def by_asset(view: DataFrame, asset_id: str) -> DataFrame:
    """Rows of any view for one asset."""
    return view.filter(F.col("asset_id") == asset_id)


def daily_ordered(daily: DataFrame, asset_id: str) -> DataFrame:
    return by_asset(daily, asset_id).orderBy("trade_date")


def by_symbol(assets: DataFrame, symbol: str) -> DataFrame:
    return assets.filter(F.col("symbol") == symbol)


def with_is_buy(orders: DataFrame) -> DataFrame:
    return orders.withColumn("is_buy", F.col("side") == "Buy")
