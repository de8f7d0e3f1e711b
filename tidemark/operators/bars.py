"""Bars of any key, from ticks or from smaller bars.

A bar is open, high, low, close, volume and the first times at which the high and low were reached. Building from
children gives the same bar as building from ticks, volume included: bars carry their exact volume in ``volume_sum``. So only
the first level shuffles base rows. Aggregates are one description in SQL text, for frames and for named views alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.candle import Thresholds, candle_pattern

#: An exact sum of doubles: whole numbers of 2^30, 1, 2^-30, 2^-60 and 2^-90, and in ``rest`` what they can't hold (2^60 and more,
#: finer than 2^-90, NaN), which is summed as doubles. Whole sums don't depend on the rows' order or partitions.
LIMBS = ["g", "u", "n", "a", "r"]
_POWER = {30: "1073741824D", 60: "1152921504606846976D", 90: f"{2.0**90!r}D"}


def limbs(v: str) -> dict[str, str]:
    """A double's limbs; null for null. Remainders and products by powers of two are exact."""
    fits = f"abs({v}) < {_POWER[60]} AND ({v} * {_POWER[90]}) % 1D = 0D"
    parts = {
        "g": f"{v} / {_POWER[30]}",
        "u": f"{v} % {_POWER[30]}",
        "n": f"({v} % 1D) * {_POWER[30]}",
        "a": f"(({v} * {_POWER[30]}) % 1D) * {_POWER[30]}",
        "r": f"(({v} * {_POWER[60]}) % 1D) * {_POWER[30]}",
    }
    out = {k: f"CASE WHEN {v} IS NULL THEN NULL WHEN {fits} THEN CAST({x} AS BIGINT) ELSE 0L END" for k, x in parts.items()}
    return out | {"rest": f"CASE WHEN {fits} THEN 0D ELSE {v} END"}


def limbs_sum(parts: dict[str, str]) -> str:
    return "named_struct({})".format(", ".join(f"'{k}', sum({x})" for k, x in parts.items()))


def total(sums: str) -> str:
    """The double that limbs add up to; null if nothing was added."""
    big = lambda k, power: f"CAST({sums}.{k} AS DECIMAL(19,0)) * CAST({2**power} AS DECIMAL(19,0))"
    whole = f"{big('g', 30)} + {sums}.u"
    part = f"({big('n', 60)} + {big('a', 30)} + {sums}.r)"
    unit = f"CAST({2**90} AS DECIMAL(28,0))"
    return f"CAST({whole} + ({part} div {unit}) AS DOUBLE) + CAST({part} % {unit} AS DOUBLE) / {_POWER[90]} + {sums}.rest"


def aggregates(first: str, last: str, high_ts: str, low_ts: str, volume: str) -> dict[str, str]:
    """A group's bar: ``first`` and ``last`` order its rows, high_ts and low_ts are the rows' times of their high and low, ``volume`` is
    the exact sum. NaN is the largest price, so a NaN high is the group's high and its time is that of the first NaN."""
    return {
        "open": f"min_by(open, {first})",
        "high": "max(high)",
        "low": "min(low)",
        "close": f"max_by(close, {last})",
        "volume_sum": volume,
        "high_ts": f"min_by({high_ts}, CASE WHEN high IS NOT NULL THEN struct(NOT isnan(high) AS n, -high AS h, {high_ts} AS t) END)",
        "low_ts": f"min_by({low_ts}, CASE WHEN low IS NOT NULL THEN struct(low AS l, {low_ts} AS t) END)",
    }


def tick_aggregates() -> dict[str, str]:
    """Of ticks. Ties in time go by seq, then by the price itself, so row order never matters."""
    return aggregates("struct(ts, seq, open)", "struct(ts, seq, close)", "ts", "ts", limbs_sum(limbs("volume")))


def bar_aggregates(order: str) -> dict[str, str]:
    """Of smaller bars, of which ``order`` says which comes first in a group."""
    return aggregates(order, order, "high_ts", "low_ts", limbs_sum({k: f"volume_sum.{k}" for k in [*LIMBS, "rest"]}))


def grouped(rows: DataFrame, keys: list[Column | str], of: dict[str, str]) -> DataFrame:
    bars = rows.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in of.items()])
    own = [c for c in bars.columns if c not in of]
    return bars.select(*own, "open", "high", "low", "close", F.expr(total("volume_sum")).alias("volume"), *[c for c in ("high_ts", "low_ts", "volume_sum") if c in of], *[c for c in of if c not in VALUES])


VALUES = ["open", "high", "low", "close", "volume", "high_ts", "low_ts", "volume_sum"]


def base_bars(ticks: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Bars from ticks."""
    return grouped(ticks, keys, tick_aggregates())


def roll_up(bars: DataFrame, keys: list[Column | str], order: str) -> DataFrame:
    """Bars from smaller bars, of which ``order`` says which comes first in a group."""
    return grouped(bars, keys, bar_aggregates(order))


def shown(bars: DataFrame) -> DataFrame:
    """Bars without what only further bars need."""
    return bars.drop("volume_sum")


def with_labels(bars: DataFrame, name: str = "candle_pattern", at: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Adds the pattern and the times of high and low as HH:mm."""
    return bars.withColumns({
        name: candle_pattern(F.col("open"), F.col("high"), F.col("low"), F.col("close"), at),
        "high_hm": times.hour_minute(F.col("high_ts")),
        "low_hm": times.hour_minute(F.col("low_ts")),
    })


def hourly_bars(ticks: DataFrame) -> DataFrame:
    """Ticks to ``market_data`` rows by the hour; seq is the least of the hour."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts")
    of = {k: v for k, v in tick_aggregates().items() if k not in ("high_ts", "low_ts")}
    bars = grouped(ticks, ["asset_id", hour], of | {"seq": "min(seq)"})
    return shown(bars).withColumnRenamed("hour_ts", "ts")
