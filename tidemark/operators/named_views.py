"""The five calendar views by name in the catalogue, each defined over the one before, for every session that shares it."""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import SparkSession

from tidemark.functions.candle import pattern_sql
from tidemark.functions.session import session_sql

from .bars import bar_aggregates, tick_aggregates, total


@dataclass(frozen=True)
class View:
    """``keys`` name SQL text over the rows of ``source``; ``aggregates`` make a group's bar."""

    source: str
    keys: dict[str, str]
    aggregates: dict[str, str]

    def sql(self, source: str) -> str:
        keys = ", ".join(f"{text} AS {name}" for name, text in self.keys.items())
        bars = ", ".join(f"{text} AS {name}" for name, text in self.aggregates.items())
        rows = f"SELECT asset_id, {keys}, {bars} FROM {source} GROUP BY asset_id, {', '.join(self.keys.values())}"
        shown = f"asset_id, {', '.join(self.keys)}, open, high, low, close, {total('volume_sum')} AS volume, high_ts, low_ts, volume_sum"
        return f"SELECT {shown}, {pattern_sql()} AS candle_pattern, date_format(high_ts, 'HH:mm') AS high_hm, date_format(low_ts, 'HH:mm') AS low_hm FROM ({rows}) AS bars"


VIEWS = {
    "session_agg": View("market_data", {"trade_date": "to_date(ts)", "session": session_sql("ts")}, tick_aggregates()),
    "daily_agg": View("session_agg", {"trade_date": "trade_date", "weekday": "date_format(trade_date, 'E')"}, bar_aggregates("session")),
    "weekday_agg": View("daily_agg", {"week_start": "to_date(date_trunc('week', trade_date))", "weekday": "weekday"}, bar_aggregates("trade_date")),
    "weekly_agg": View("daily_agg", {"week_start": "to_date(date_trunc('week', trade_date))"}, bar_aggregates("trade_date")),
    "monthly_agg": View("daily_agg", {"month_start": "trunc(trade_date, 'MM')"}, bar_aggregates("trade_date")),
}


def order() -> list[str]:
    """The views, each after what it is defined over."""
    names = TopologicalSorter({name: {v.source} for name, v in VIEWS.items()}).static_order()
    return [n for n in names if n in VIEWS]


def define(spark: SparkSession, rows: str, prefix: str = "") -> list[str]:
    """Define all views, named with ``prefix``, over ``rows``, a table's name or SQL such as parquet.`/folder`; existing ones are
    replaced. Their names, in order."""
    made = {"market_data": rows}
    for name in order():
        v = VIEWS[name]
        made[name] = f"{prefix}{name}"
        spark.sql(f"CREATE OR REPLACE VIEW {made[name]} COMMENT 'bars over {v.source}' TBLPROPERTIES ('over' = '{made[v.source].replace(chr(39), '')}') AS {v.sql(made[v.source])}")
    return [made[name] for name in order()]


def drop(spark: SparkSession, prefix: str = "") -> None:
    """Drop all views, those that others are defined over last."""
    for name in reversed(order()):
        spark.sql(f"DROP VIEW IF EXISTS {prefix}{name}")
