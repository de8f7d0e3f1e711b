"""Candlestick patterns as one conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .session import session_sql

# The labels.
DOJI, UNKNOWN = "Doji/SpinningTop", "Unknown"


@dataclass(frozen=True)
class Thresholds:
    """Shares of a bar's range; ``eps`` is the least range that has a shape."""

    doji: float = 0.1
    long: float = 0.5
    short: float = 0.3
    ratio: float = 0.6
    eps: float = 1e-9


def _sided(bull: Column, shape: str) -> Column:
    return F.when(bull, F.lit(f"Bullish {shape}")).otherwise(F.lit(f"Bearish {shape}"))


def candle_pattern(o: Column, h: Column, l: Column, c: Column, at: Thresholds = Thresholds()) -> Column:  # noqa: E741, B008
    """The pattern of a bar; null if any of its four prices is."""
    extent = h - l
    body = F.try_divide(F.abs(c - o), extent)
    upper = F.try_divide(h - F.greatest(o, c), extent)
    lower = F.try_divide(F.least(o, c) - l, extent)
    bull = (c > o) & ~F.isnan(c)
    mild = F.when(bull, F.lit("Mild Bullish")).otherwise(F.lit("Mild Bearish"))
    return (
        F.when(o.isNull() | h.isNull() | l.isNull() | c.isNull(), F.lit(None).cast("string"))
        .when(extent < at.eps, F.lit(UNKNOWN))
        .when(F.isnan(body), mild)
        .when(body <= at.doji, F.lit(DOJI))
        .when((body < at.short) & (F.try_divide(upper, lower + at.eps) < at.ratio), _sided(bull, "Hammer"))
        .when((body < at.short) & (F.try_divide(lower, upper + at.eps) < at.ratio), _sided(bull, "Shooting Star"))
        .when(body >= at.long, _sided(bull, "Long Body"))
        .otherwise(mild)
    )


def pattern_sql(o: str = "open", h: str = "high", l: str = "low", c: str = "close", at: Thresholds = Thresholds()) -> str:  # noqa: E741, B008
    """``candle_pattern`` as SQL text."""
    body, upper, lower = f"try_divide(abs({c} - {o}), {h} - {l})", f"try_divide({h} - greatest({o}, {c}), {h} - {l})", f"try_divide(least({o}, {c}) - {l}, {h} - {l})"
    bull = f"CASE WHEN {c} > {o} AND NOT isnan({c}) THEN 'Bullish' ELSE 'Bearish' END"
    return f"""CASE WHEN {o} IS NULL OR {h} IS NULL OR {l} IS NULL OR {c} IS NULL THEN NULL
             WHEN {h} - {l} < {at.eps} THEN '{UNKNOWN}'
             WHEN isnan({body}) THEN concat('Mild ', {bull})
             WHEN {body} <= {at.doji} THEN '{DOJI}'
             WHEN {body} < {at.short} AND try_divide({upper}, {lower} + {at.eps}) < {at.ratio} THEN concat({bull}, ' Hammer')
             WHEN {body} < {at.short} AND try_divide({lower}, {upper} + {at.eps}) < {at.ratio} THEN concat({bull}, ' Shooting Star')
             WHEN {body} >= {at.long} THEN concat({bull}, ' Long Body')
             ELSE concat('Mild ', {bull}) END"""


def register_sql_functions(spark: SparkSession) -> None:
    """``session_from_timestamp`` and ``candle_pattern`` as SQL functions, which Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION session_from_timestamp(ts TIMESTAMP) RETURNS STRING RETURN {session_sql('ts')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION candle_pattern(o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE) RETURNS STRING RETURN {pattern_sql('o', 'h', 'l', 'c')}")
