"""Bar files: Date, Time, Open, High, Low, Close, Volume with a header, matched by name."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import times

from .market_store import write_days

# The columns of a bar file.
PRICES = ["Open", "High", "Low", "Close", "Volume"]


def _number(name: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"bad {name}: "), F.coalesce(F.col(name), F.lit("empty")))).cast("double")
    return F.coalesce(F.col(name).try_cast("double"), bad).alias(name.lower())


def parse_bars(rows: DataFrame, asset_id: str | Column, source: str = "csv") -> DataFrame:
    """``market_data`` rows of text columns; any value that can't be read is an error, so nothing is written."""
    at = times.parse_bar_time(F.col("Date"), F.col("Time"))
    asset = F.lit(asset_id) if isinstance(asset_id, str) else asset_id
    return rows.select(
        asset.alias("asset_id"),
        F.coalesce(at, F.raise_error(F.lit("bad Date or Time")).cast("timestamp")).alias("ts"),
        *[_number(p) for p in PRICES],
        F.lit(0).cast("long").alias("seq"),
        F.lit(source).alias("source"),
    )


def checked(rows: DataFrame) -> DataFrame:
    """Adds what text columns say (ts and numbers; null where they can't be read) and ``reason``, the names of those that can't be
    read, or null."""
    ts = F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit("yyyy.MM.dd HH:mm"))
    values = {"ts": ts} | {p.lower(): F.col(p).try_cast("double") for p in PRICES}
    names = {"ts": "Date and Time"} | {p.lower(): p for p in PRICES}
    bad = F.concat_ws(", ", *[F.when(v.isNull(), F.lit(names[k])) for k, v in values.items()])
    return rows.withColumns({**values, "reason": F.when(bad != "", bad)})


def read_bars_csv(spark: SparkSession, path: str, asset_id: str, source: str = "csv", mode: str = "strict") -> DataFrame:
    """A bar file as ``market_data`` rows. ``strict`` fails on any bad row; ``quarantine`` keeps every row, with
    ``bad`` true, null values and a ``reason`` where something can't be read. The texts NaN and Infinity are numbers."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST" if mode == "strict" else "PERMISSIVE")
    raw = raw.select("Date", "Time", *PRICES)
    if mode == "strict":
        return parse_bars(raw, asset_id, source)
    made = checked(raw)
    return made.select(F.lit(asset_id).alias("asset_id"), "ts", *[p.lower() for p in PRICES], F.lit(0).cast("long").alias("seq"), F.lit(source).alias("source"), F.col("reason").isNotNull().alias("bad"), "reason")


def read_bars_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of many bar files and folders of such as text, with ``path``, the one of ``paths`` that a row is from. Columns go by
    each file's own header: the headers are looked up first, and files that have the same are read together, whatever
    their number. A file without a header that has all columns is an error; one without a line has no rows."""
    given = sorted({_full(spark, p): p for p in paths}.items())
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    names = F.split(F.regexp_replace("value", '"', ""), r"\s*,\s*")
    header = F.when(F.forall(F.array(*[F.lit(c) for c in ("Date", "Time", *PRICES)]), lambda c: F.array_contains(names, c)), names)
    heads = lines.groupBy("file").agg(F.max(header).alias("names")).collect()
    if lost := [r.file for r in heads if r.names is None]:
        raise ValueError(f"{len(lost)} files have no header with all columns, such as {min(lost)}")
    layouts: dict[tuple, list[str]] = {}
    for r in heads:
        layouts.setdefault(tuple(r.names), []).append(r.file)
    out = spark.createDataFrame([], "file string, " + ", ".join(f"`{c}` string" for c in ("Date", "Time", *PRICES)))
    for layout, files in sorted(layouts.items()):
        kinds = ", ".join(f"`{c}` string" for c in layout)
        rows = spark.read.schema(kinds).csv([unquote(f) for f in files], header=True, mode="FAILFAST")
        out = out.unionByName(rows.select(F.col("_metadata.file_path").alias("file"), "Date", "Time", *PRICES))
    # a file belongs to the longest of the given paths that leads to it
    owner = []
    for r in heads:
        at = _plain(r.file)
        owner.append((r.file, max((f, p) for f, p in given if at == f or at.startswith(f"{f}/"))[1]))
    return out.join(F.broadcast(spark.createDataFrame(owner, "file string, path string")), "file").drop("file")


def _full(spark: SparkSession, path: str) -> str:
    """The path with its file system, as ``_plain`` writes those of scans."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _plain(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString())


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", unquote(path))


def append_market_data(bars: DataFrame, path: str) -> None:
    """Append to a stored table at once; loading a file twice doubles its rows. ``MarketStore`` has loads that count whole or
    not at all."""
    write_days(bars, path, "append")
