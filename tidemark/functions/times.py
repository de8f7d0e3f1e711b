"""Buckets, labels and parsing of times; everything is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column) -> Column:
    return F.to_date(ts)


def week_start(ts: Column) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", ts))


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "E")


def month_name(ts: Column) -> Column:
    return F.date_format(ts, "MMM")


def hour_minute(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def week_label(ts: Column) -> Column:
    """"Week N" with the ISO week number."""
    return F.concat(F.lit("Week "), F.weekofyear(ts).cast("string"))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_bar_time(date: Column, time: Column) -> Column:
    """``yyyy.MM.dd`` and ``HH:mm`` as a timestamp; bad text is an error."""
    return F.to_timestamp(F.concat_ws(" ", date, time), "yyyy.MM.dd HH:mm")


def parse_ymd_hms(text: Column) -> Column:
    """``yyyy.MM.dd HH:mm:ss`` as a timestamp; bad text is an error."""
    return F.to_timestamp(text, "yyyy.MM.dd HH:mm:ss")
