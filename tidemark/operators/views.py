"""The derived tables, each at calendar grain (real dates) and most also at profile grain (names, years merged)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.session import session_label

from .bars import base_bars, roll_up, shown, with_labels

THIN = ["high", "low", "volume"]


def session_agg(md: DataFrame) -> DataFrame:
    """Bars by asset, date and session: the only view that reads base rows at calendar grain."""
    ts = F.col("ts")
    return base_bars(md, ["asset_id", times.day(ts).alias("trade_date"), session_label(ts).alias("session")])


def session_profile(md: DataFrame) -> DataFrame:
    """Bars by asset, weekday name and session."""
    ts = F.col("ts")
    return base_bars(md, ["asset_id", times.weekday_name(ts).alias("weekday"), session_label(ts).alias("session")])


def daily_agg(sessions: DataFrame) -> DataFrame:
    """By asset and date, from session bars; session names sort as the day runs."""
    return roll_up(sessions, ["asset_id", "trade_date"], "session").withColumn("weekday", times.weekday_name(F.col("trade_date")))


def daily_profile(daily: DataFrame) -> DataFrame:
    return roll_up(daily, ["asset_id", "weekday"], "trade_date")


def weekday_agg(daily: DataFrame) -> DataFrame:
    """By asset, week and weekday: with real dates, one row a day."""
    return roll_up(daily, ["asset_id", times.week_start(F.col("trade_date")).alias("week_start"), "weekday"], "trade_date")


def weekly_agg(daily: DataFrame) -> DataFrame:
    return roll_up(daily, ["asset_id", times.week_start(F.col("trade_date")).alias("week_start")], "trade_date")


def week_of_year_profile(daily: DataFrame) -> DataFrame:
    return roll_up(daily, ["asset_id", times.week_label(F.col("trade_date")).alias("week")], "trade_date")


def monthly_agg(daily: DataFrame) -> DataFrame:
    return roll_up(daily, ["asset_id", times.month_start(F.col("trade_date")).alias("month_start")], "trade_date")


def month_of_year_profile(daily: DataFrame) -> DataFrame:
    return roll_up(daily, ["asset_id", times.month_name(F.col("trade_date")).alias("month")], "trade_date")


def by_one_asset(sessions: DataFrame) -> DataFrame:
    """Session bars dealt out by asset: day, week and month bars of these need no further exchange. An asset's bars are some
    five a day, however many its rows."""
    return sessions.repartition("asset_id")


def define_views(md: DataFrame) -> dict[str, DataFrame]:
    """The five calendar views, labelled, over one shared plan of session bars, which all the others take as they lie."""
    sessions = by_one_asset(session_agg(md))
    daily = daily_agg(sessions)
    views = {"session_agg": sessions, "daily_agg": daily, "weekday_agg": weekday_agg(daily), "weekly_agg": weekly_agg(daily), "monthly_agg": monthly_agg(daily)}
    return {name: with_labels(v) for name, v in views.items()}


KEYS = ["asset_id", "trade_date", "session", "week_start", "weekday", "month_start", "week", "month"]


def all_rows(views: dict[str, DataFrame]) -> DataFrame:
    """Every row of several labelled views under one another, led by the view's name; keys that a view lacks are null. The
    views share what they are built from: session bars are aggregated and exchanged once."""
    out = None
    for name, v in views.items():
        rows = shown(v).withColumn("view", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("view", *[c for c in KEYS if c in out.columns], *[c for c in out.columns if c not in ("view", *KEYS)])


def projection(view: DataFrame, variant: str) -> DataFrame:
    """A labelled view's columns as ``thin`` (high, low, volume), ``hm`` (pattern, HH:mm times) or ``ts`` (pattern, timestamps)."""
    extra = {"thin": THIN, "hm": [*THIN, "candle_pattern", "high_hm", "low_hm"], "ts": [*THIN, "candle_pattern", "high_ts", "low_ts"]}[variant]
    return view.select(*[c for c in KEYS if c in view.columns], *extra)
