"""Every operator of the library as a query over the given tables, with the SQL that checks it."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.candle import Thresholds, candle_pattern, register_sql_functions
from tidemark.functions.session import session_label, session_parse
from tidemark.operators import bars, jobs, named_views, reads, views
from tidemark.sources.adapters import md_events, md_lineitem, md_orders
from tidemark.sources.bars_csv import checked, parse_bars
from tidemark.sources.market_store import MarketStore
from tidemark.sources.schemas import ALLOWED, conform
from tidemark.sources.storage import shared_dir

NTZ = "timestamp_ntz"
WIDE = Thresholds(doji=0.2, long=0.7, short=0.4, ratio=0.9, eps=1e-6)

# ---- SQL parts

EVENTS = """SELECT event_type AS asset_id, ts, value AS open, value AS high, value AS low, value AS close,
 CAST(json_extract(props, '$.k') AS DOUBLE) AS volume, event_id AS seq FROM events"""
ORDERS = """SELECT o_orderpriority AS asset_id, o_orderdate AS ts, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low,
 o_totalprice AS close, 1.0::DOUBLE AS volume, o_orderkey AS seq FROM orders"""
LINES = """SELECT l_returnflag AS asset_id, l_shipdate AS ts, l_extendedprice / l_quantity AS open, l_extendedprice / l_quantity AS high,
 l_extendedprice / l_quantity AS low, l_extendedprice / l_quantity AS close, l_quantity AS volume, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"""
SESSION = """CASE WHEN hour(ts) >= 20 THEN 'NYPM' WHEN hour(ts) >= 18 THEN 'NYL' WHEN hour(ts) >= 15 THEN 'NYAM' WHEN hour(ts) >= 8 THEN 'LN'
 WHEN hour(ts) >= 0 THEN 'AS' END"""
DAY, WEEKDAY, WEEK, MONTH = "CAST(ts AS DATE)", "strftime(ts, '%a')", "CAST(date_trunc('week', ts) AS DATE)", "CAST(date_trunc('month', ts) AS DATE)"


def candle_sql(at: Thresholds = Thresholds()) -> str:  # noqa: B008
    body, up, lo = "abs(close - open) / nullif(high - low, 0)", "(high - greatest(open, close)) / nullif(high - low, 0)", "(least(open, close) - low) / nullif(high - low, 0)"
    side = "CASE WHEN close > open THEN 'Bullish' ELSE 'Bearish' END"
    return f"""CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN NULL
 WHEN high - low < {at.eps} THEN 'Unknown'
 WHEN {body} <= {at.doji} THEN 'Doji/SpinningTop'
 WHEN {body} < {at.short} AND {up} / nullif({lo} + {at.eps}, 0) < {at.ratio} THEN {side} || ' Hammer'
 WHEN {body} < {at.short} AND {lo} / nullif({up} + {at.eps}, 0) < {at.ratio} THEN {side} || ' Shooting Star'
 WHEN {body} >= {at.long} THEN {side} || ' Long Body'
 ELSE 'Mild ' || {side} END"""


def bars_sql(md: str, keys: dict[str, str], last: str = "") -> str:
    """Bars straight from ticks, whatever level they were rolled up from."""
    cols = ", ".join(f"{v} AS {k}" for k, v in keys.items())
    return f"""SELECT asset_id, {cols}, first(open ORDER BY ts, seq, open) AS open, max(high) AS high, min(low) AS low,
 last(close ORDER BY ts, seq, close) AS close, sum(volume) AS volume,
 first(ts ORDER BY high DESC, ts) FILTER (WHERE high IS NOT NULL) AS high_ts, first(ts ORDER BY low, ts) FILTER (WHERE low IS NOT NULL) AS low_ts
 FROM ({md}) AS md GROUP BY asset_id, {", ".join(keys.values())} {last}"""


def labelled_sql(inner: str) -> str:
    return f"SELECT *, {candle_sql()} AS candle_pattern, strftime(high_ts, '%H:%M') AS high_hm, strftime(low_ts, '%H:%M') AS low_hm FROM ({inner}) AS b"


HOURLY = f"""SELECT asset_id, date_trunc('hour', ts) AS ts, first(open ORDER BY ts, seq, open) AS open, max(high) AS high, min(low) AS low,
 last(close ORDER BY ts, seq, close) AS close, sum(volume) AS volume, min(seq) AS seq FROM ({EVENTS}) AS md GROUP BY asset_id, date_trunc('hour', ts)"""

ASSETS = """SELECT 'asset:' || symbol AS id, symbol, min(name) AS name, min(kind) AS asset_class, min(currency) AS currency, 0.1::DOUBLE AS tick_size, 0.1::DOUBLE AS lot_size, 1 AS price_decimals,
 min(exchange) AS exchange, min(zone) AS timezone, TRUE AS active, min(listed) AS first_listed_ts
 FROM (SELECT event_type AS symbol, 'Event ' || event_type AS name, 'index' AS kind, 'USD' AS currency, 'X' AS exchange, 'UTC' AS zone, TIMESTAMP '2020-01-01 00:00:00' AS listed FROM events
 UNION ALL SELECT o_orderpriority, NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-06-01 00:00:00' FROM orders) AS s GROUP BY symbol"""

# ---- queries


def _sessions(md) -> DataFrame:
    return views.session_agg(md)


def _daily(md) -> DataFrame:
    return views.daily_agg(views.session_agg(md))


def q_session_label(spark: SparkSession, d: str) -> DataFrame:
    return md_events(spark, d).select("seq", session_label(F.col("ts")).alias("session"))


def q_session_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(session_label(F.col("ts")))
    text = F.when(F.col("seq") % 7 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    return md_events(spark, d).select("seq", session_parse(text).alias("session"))


def q_hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.hourly_bars(md_events(spark, d))


def _pattern(at: Thresholds):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ohlc = [F.col(c) for c in ("open", "high", "low", "close")]
        return q_hourly_bars(spark, d).select("asset_id", "ts", candle_pattern(*ohlc, at).alias("candle_pattern"))

    return run


def _view(source, build):
    """A view over a source, labelled."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return bars.shown(bars.with_labels(build(source(spark, d))))

    return run


def q_session_agg_thin(spark: SparkSession, d: str) -> DataFrame:
    return views.projection(bars.with_labels(_sessions(md_events(spark, d))), "thin")


def q_weekly_hm(spark: SparkSession, d: str) -> DataFrame:
    return views.projection(bars.with_labels(views.weekly_agg(_daily(md_events(spark, d)))), "hm")


def q_latest_n(spark: SparkSession, d: str) -> DataFrame:
    """The newest 25 bars: the limit is the feature."""
    return reads.latest_n(md_events(spark, d), "click", 25)


def q_bars_by_asset(spark: SparkSession, d: str) -> DataFrame:
    return bars.shown(reads.by_asset(_sessions(md_events(spark, d)), "view"))


def q_daily_ordered(spark: SparkSession, d: str) -> DataFrame:
    return bars.shown(reads.daily_ordered(_daily(md_events(spark, d)), "view"))


def q_daily_pattern_update(spark: SparkSession, d: str) -> DataFrame:
    return bars.shown(jobs.update_daily_patterns(_daily(md_orders(spark, d))))


def q_asset_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    listed = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    events = md_events(spark, d).select(F.col("asset_id").alias("symbol"), F.concat(F.lit("Event "), "asset_id").alias("name"), F.lit("index").alias("asset_class"), F.lit("USD").alias("currency"), F.lit("X").alias("exchange"), F.lit("UTC").alias("timezone"))
    existing = jobs.assets_get_or_create(conform(events.limit(0), "assets"), events, listed)[0]
    incoming = events.select("symbol").union(md_orders(spark, d).select("asset_id"))
    found, _ = jobs.assets_get_or_create(existing, incoming, F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    return found.withColumn("first_listed_ts", F.col("first_listed_ts").cast(NTZ)).withColumn("price_decimals", F.col("price_decimals").cast("int"))


def q_asset_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    """One asset: the filter is the feature."""
    return reads.by_symbol(q_asset_get_or_create(spark, d), "click").select("id", "symbol", "name", "first_listed_ts")


def q_time_formats(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return md_events(spark, d).select("seq", times.weekday_name(ts).alias("weekday"), times.month_name(ts).alias("month"), times.hour_minute(ts).alias("hm"), times.week_label(ts).alias("week"), times.iso_seconds(ts).alias("iso"))


def q_time_floor(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return md_orders(spark, d).select("seq", times.day(ts).alias("day"), times.week_start(ts).alias("week_start"), times.month_start(ts).alias("month_start"))


def q_parse_ymd_hms(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("ts", "yyyy.MM.dd HH:mm:ss")
    return md_events(spark, d).select("seq", times.parse_ymd_hms(text).cast(NTZ).alias("at"))


def q_bar_rows(spark: SparkSession, d: str) -> DataFrame:
    """Bar-file rows, derived as text from hourly bars, through the ingest's parsing."""
    rows = q_hourly_bars(spark, d).select("asset_id", F.date_format("ts", "yyyy.MM.dd").alias("Date"), F.date_format("ts", "HH:mm").alias("Time"), *[F.col(c.lower()).cast("string").alias(c) for c in ("Open", "High", "Low", "Close", "Volume")])
    return parse_bars(rows, F.col("asset_id")).withColumn("ts", F.col("ts").cast(NTZ))


def q_order_is_buy(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    side = F.when(F.col("o_orderstatus") == "O", "Buy").when(F.col("o_orderstatus") == "F", "Sell")
    return reads.with_is_buy(o.select("o_orderkey", side.alias("side")))


def q_all_views(spark: SparkSession, d: str) -> DataFrame:
    """Every row and column of the five views, in one job."""
    return views.all_rows(views.define_views(md_orders(spark, d)))


def _by_asset(build):
    """One asset's rows of a view: the filter is the feature, and reaches the scan."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return bars.shown(reads.by_asset(bars.with_labels(build(_daily(md_orders(spark, d)))), "1-URGENT"))

    return run


def q_latest_n_bound(spark: SparkSession, d: str) -> DataFrame:
    """The same read as SQL text with bound parameters."""
    md_events(spark, d).createOrReplaceTempView("latest_n_events")
    return reads.latest_n_sql(spark, "latest_n_events", "view", 40)


def q_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Both SQL functions, over hourly bars."""
    register_sql_functions(spark)
    return q_hourly_bars(spark, d).select("asset_id", "ts", F.expr("session_from_timestamp(CAST(ts AS TIMESTAMP))").alias("session"), F.expr("candle_pattern(open, high, low, close)").alias("candle_pattern"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars written as bar files with their columns in two orders, one folder for each asset; all loaded in one job with
    their assets, then one of them again with a file of only a header, then the first load once more under its own
    id, which adds nothing; what the store then holds."""
    out = _folder(spark, "csv")
    text = q_hourly_bars(spark, d).select("asset_id", F.date_format("ts", "HH:mm").alias("Time"), F.date_format("ts", "yyyy.MM.dd").alias("Date"), *[F.col(c.lower()).cast("string").alias(c) for c in ("Close", "Open", "High", "Low", "Volume")])
    early = F.col("asset_id") < "p"
    text.filter(early).write.partitionBy("asset_id").csv(f"{out}/files", header=True)
    turned = ["asset_id", "Volume", "Low", "High", "Open", "Close", "Date", "Time"]
    text.filter(~early).select(*turned).write.mode("append").partitionBy("asset_id").csv(f"{out}/files", header=True)
    text.drop("asset_id").limit(0).coalesce(1).write.csv(f"{out}/none", header=True)
    symbols = sorted(r[0] for r in text.select("asset_id").distinct().collect())  # what a user lists: one file for each
    files = [{"path": f"{out}/files/asset_id={s}", "symbol": s, "currency": "USD"} for s in symbols]
    store = MarketStore(spark, f"{out}/store")
    jobs.ingest_files(store, files, source="file", load_id="first")
    jobs.ingest_files(store, [files[0], {"path": f"{out}/none", "symbol": symbols[0]}], source="file")
    jobs.ingest_files(store, files, source="file", load_id="first")
    assets = store.all_assets().select(F.col("id").alias("asset_id"), "symbol", "currency")
    rows = conform(store.market_data(), "market_data")
    return rows.join(assets, "asset_id").select("asset_id", "symbol", "currency", F.col("ts").cast(NTZ).alias("ts"), "open", "high", "low", "close", "volume", "seq", "source")


def q_csv_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Rows of bar files, derived as text from hourly bars and some of them spoiled: what can be read of each, and why others
    are rejected."""
    price = lambda c, n, bad: F.when(F.col("seq") % n == 0, F.lit(bad)).otherwise(F.col(c.lower()).cast("string")).alias(c)
    date = F.when(F.col("seq") % 13 == 0, F.lit("2024.13.01")).otherwise(F.date_format("ts", "yyyy.MM.dd")).alias("Date")
    text = q_hourly_bars(spark, d).select("asset_id", "seq", date, F.date_format("ts", "HH:mm").alias("Time"), price("Open", 11, "x"), price("High", 17, ""), price("Low", 19, "1,5"), F.col("close").cast("string").alias("Close"), price("Volume", 11, None))
    return checked(text).select("asset_id", "seq", F.col("ts").cast(NTZ).alias("ts"), "open", "high", "low", "close", "volume", "reason")


def _loaded(spark: SparkSession, d: str, name: str) -> MarketStore:
    """Events stored as two loads."""
    store, md = MarketStore(spark, _folder(spark, name)), md_events(spark, d)
    store.append(md.filter("seq % 2 = 0"), "even")
    store.append(md.filter("seq % 2 <> 0"), "odd")
    return store


def q_latest_n_stored(spark: SparkSession, d: str) -> DataFrame:
    """The newest 25 bars of stored market data, found from the newest partition back: the limit is the feature."""
    rows = _loaded(spark, d, "latest").latest("click", 25)
    return rows.select("asset_id", F.col("ts").cast(NTZ).alias("ts"), "open", "high", "low", "close", "volume", "seq")


def q_named_views(spark: SparkSession, d: str) -> DataFrame:
    """The five views by their names in the catalogue, as another session reads them, over stored market data."""
    store, prefix = _loaded(spark, d, "named"), f"v{uuid.uuid4().hex}_"
    store.market_data().select("asset_id", F.col("ts").cast(NTZ).alias("ts"), "open", "high", "low", "close", "volume", "seq").write.parquet(f"{store.root}/rows")
    named_views.define(spark, f"parquet.`{store.root}/rows`", prefix)
    other = spark.newSession()
    rows = views.all_rows({name: other.table(f"{prefix}{name}") for name in named_views.order()})
    rows.schema  # names are resolved by now
    named_views.drop(spark, prefix)
    return rows


def q_conform(table: str):
    """The given tables made to conform to a declared schema; every row. Variants are compared as JSON text."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
        if table == "market_data":
            out = conform(md_events(spark, d).drop("open"), table)
        elif table == "orders":
            key = F.col("o_orderkey")
            pick = lambda column: F.element_at(F.array(*[F.lit(v) for v in ALLOWED["orders", column]]), F.pmod(key, F.lit(len(ALLOWED["orders", column]))).cast("int") + 1)
            status = F.when(key % 5 != 0, pick("status"))
            meta = F.concat(F.lit('{"priority":"'), "o_orderpriority", F.lit('","customer":'), F.col("o_custkey").cast("string"), F.lit("}"))
            out = conform(read("orders").select(key.alias("id"), F.col("o_orderpriority").alias("asset_id"), pick("side").alias("side"), F.col("o_totalprice").cast("string").alias("price"), pick("order_type").alias("order_type"), status.alias("status"), F.col("o_orderdate").alias("created_ts"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), meta.alias("meta")), table)
            out = out.withColumns({"tags": F.array_join("tags", "|"), "meta": F.to_json("meta")})
        elif table == "predictions":
            out = conform(read("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("asset_id"), "ts", F.lit(60_000).alias("horizon_ms"), F.col("value").alias("predicted_price")), table)
        elif table == "assets":
            out = conform(read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("symbol"), F.col("s_acctbal").alias("tick_size"), F.pmod("s_suppkey", F.lit(9)).alias("price_decimals"), F.when(F.col("s_suppkey") % 3 == 0, False).alias("active")), table).withColumn("price_decimals", F.col("price_decimals").cast("int"))
        else:
            part = read("part")
            params = F.concat(F.lit('{"size":'), F.col("p_size").cast("string"), F.lit("}"))
            out = conform(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("applicable_assets"), params.alias("params"), F.when(F.col("p_partkey") % 2 == 0, False).alias("active")), table)
            out = out.withColumns({"applicable_assets": F.array_join("applicable_assets", "|"), "params": F.to_json("params")})
        return out.select(*[F.col(c).cast(NTZ).alias(c) if k == "timestamp" else F.col(c) for c, k in out.dtypes])

    return run


def q_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The stored views after a load of most days and one of the rest, a refresh, then a retraction of the rest and a load of one of
    its days with double volumes, and a refresh of what these changed."""
    out, md = _folder(spark, "refresh"), md_events(spark, d)
    store, day = MarketStore(spark, f"{out}/store"), times.day(F.col("ts"))
    store.append(md.filter(~day.isin(TAKEN_BACK)), "most")
    store.append(md.filter(day.isin(TAKEN_BACK)), "rest")
    jobs.refresh_changed(store, f"{out}/views")
    store.retract("rest")
    store.append(md.filter(day == F.lit(AGAIN)).withColumn("volume", F.col("volume") * 2), "again")
    jobs.refresh_changed(store, f"{out}/views")
    rows = views.all_rows({name: spark.read.parquet(f"{out}/views/{name}") for name in jobs.STORED})
    return rows.select(*[F.col(c).cast(NTZ).alias(c) if k == "timestamp" else F.col(c) for c, k in rows.dtypes])


#: Days that are loaded and taken back, two of them all that a week has, and the one that comes again.
TAKEN_BACK = [dt.date(2024, 1, 2), dt.date(2024, 1, 7), dt.date(2024, 1, 29), dt.date(2024, 1, 30)]
AGAIN = dt.date(2024, 1, 7)
REFRESHED_SQL = f"""SELECT * REPLACE (CASE WHEN CAST(ts AS DATE) = DATE '{AGAIN}' THEN 2 * volume ELSE volume END AS volume) FROM ({EVENTS}) AS md
 WHERE CAST(ts AS DATE) = DATE '{AGAIN}' OR CAST(ts AS DATE) NOT IN ({", ".join(f"DATE '{d}'" for d in TAKEN_BACK)})"""


def all_rows_sql(md: str, daily: str = "") -> str:
    """The five views under one another; ``daily`` is what the stored daily view has besides."""
    parts = []
    for name, keys in (("session_agg", S), ("daily_agg", D), ("weekday_agg", {"week_start": WEEK, "weekday": WEEKDAY}), ("weekly_agg", {"week_start": WEEK}), ("monthly_agg", {"month_start": MONTH})):
        more = f", {candle_sql() if name == 'daily_agg' else 'NULL::VARCHAR'} AS day_candle_pattern" if daily else ""
        parts.append(f"SELECT '{name}' AS view, *{more} FROM ({labelled_sql(bars_sql(md, keys))}) AS v")
    return " UNION ALL BY NAME ".join(parts)


def allowed_sql(column: str) -> str:
    values = ALLOWED["orders", column]
    return f"[{', '.join(repr(v) for v in values)}][o_orderkey % {len(values)} + 1]"


S, D = {"trade_date": DAY, "session": SESSION}, {"trade_date": DAY, "weekday": WEEKDAY}
#: name: (query, SQL)
TABLE = {
    "session_agg": (_view(md_events, _sessions), labelled_sql(bars_sql(EVENTS, S))),
    "session_label": (q_session_label, f"SELECT event_id AS seq, {SESSION} AS session FROM events"),
    "session_parse": (q_session_parse, f"SELECT event_id AS seq, CASE WHEN event_id % 7 <> 0 THEN {SESSION} END AS session FROM events"),
    "hourly_bars": (q_hourly_bars, HOURLY),
    "candle_pattern": (_pattern(Thresholds()), f"SELECT asset_id, ts, {candle_sql()} AS candle_pattern FROM ({HOURLY}) AS h"),
    "candle_pattern_custom": (_pattern(WIDE), f"SELECT asset_id, ts, {candle_sql(WIDE)} AS candle_pattern FROM ({HOURLY}) AS h"),
    "session_agg_thin": (q_session_agg_thin, f"SELECT asset_id, trade_date, session, high, low, volume FROM ({bars_sql(EVENTS, S)}) AS b"),
    "session_profile": (_view(md_events, views.session_profile), labelled_sql(bars_sql(EVENTS, {"weekday": WEEKDAY, "session": SESSION}))),
    "daily_agg": (_view(md_events, _daily), labelled_sql(bars_sql(EVENTS, D))),
    "daily_agg_orders": (_view(md_orders, _daily), labelled_sql(bars_sql(ORDERS, D))),
    "daily_agg_lineitem": (_view(md_lineitem, _daily), labelled_sql(bars_sql(LINES, D))),
    "daily_profile": (_view(md_orders, lambda m: views.daily_profile(_daily(m))), labelled_sql(bars_sql(ORDERS, {"weekday": WEEKDAY}))),
    "weekday_agg": (_view(md_events, lambda m: views.weekday_agg(_daily(m))), labelled_sql(bars_sql(EVENTS, {"week_start": WEEK, "weekday": WEEKDAY}))),
    "weekly_agg": (_view(md_orders, lambda m: views.weekly_agg(_daily(m))), labelled_sql(bars_sql(ORDERS, {"week_start": WEEK}))),
    "weekly_agg_hm": (q_weekly_hm, f"SELECT asset_id, week_start, high, low, volume, candle_pattern, high_hm, low_hm FROM ({labelled_sql(bars_sql(EVENTS, {'week_start': WEEK}))}) AS v"),
    "week_of_year_profile": (_view(md_orders, lambda m: views.week_of_year_profile(_daily(m))), labelled_sql(bars_sql(ORDERS, {"week": "'Week ' || CAST(weekofyear(ts) AS VARCHAR)"}))),
    "monthly_agg": (_view(md_lineitem, lambda m: views.monthly_agg(_daily(m))), labelled_sql(bars_sql(LINES, {"month_start": MONTH}))),
    "month_of_year_profile": (_view(md_orders, lambda m: views.month_of_year_profile(_daily(m))), labelled_sql(bars_sql(ORDERS, {"month": "strftime(ts, '%b')"}))),
    "latest_n": (q_latest_n, f"SELECT * FROM ({EVENTS}) AS md WHERE asset_id = 'click' ORDER BY ts DESC, seq DESC LIMIT 25"),
    "bars_by_asset": (q_bars_by_asset, f"SELECT * FROM ({bars_sql(EVENTS, S)}) AS b WHERE asset_id = 'view'"),
    "daily_ordered": (q_daily_ordered, f"SELECT * FROM ({bars_sql(EVENTS, D)}) AS b WHERE asset_id = 'view' ORDER BY trade_date"),
    "daily_pattern_update": (q_daily_pattern_update, f"SELECT *, {candle_sql()} AS day_candle_pattern FROM ({bars_sql(ORDERS, D)}) AS b"),
    "asset_get_or_create": (q_asset_get_or_create, ASSETS),
    "asset_by_symbol": (q_asset_by_symbol, f"SELECT id, symbol, name, first_listed_ts FROM ({ASSETS}) AS a WHERE symbol = 'click'"),
    "time_formats": (q_time_formats, "SELECT event_id AS seq, strftime(ts, '%a') AS weekday, strftime(ts, '%b') AS month, strftime(ts, '%H:%M') AS hm, 'Week ' || CAST(weekofyear(ts) AS VARCHAR) AS week, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events"),
    "time_floor": (q_time_floor, f"SELECT o_orderkey AS seq, {DAY.replace('ts', 'o_orderdate')} AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders"),
    "parse_ymd_hms": (q_parse_ymd_hms, "SELECT event_id AS seq, date_trunc('second', ts) AS at FROM events"),
    "bar_rows": (q_bar_rows, f"SELECT asset_id, ts, open, high, low, close, volume, 0::BIGINT AS seq, 'csv' AS source FROM ({HOURLY}) AS h"),
    "order_is_buy": (q_order_is_buy, "SELECT o_orderkey, side, side = 'Buy' AS is_buy FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Buy' WHEN 'F' THEN 'Sell' END AS side FROM orders) AS o"),
    "all_views": (q_all_views, all_rows_sql(ORDERS)),
    "weekday_by_asset": (_by_asset(views.weekday_agg), f"SELECT * FROM ({labelled_sql(bars_sql(ORDERS, {'week_start': WEEK, 'weekday': WEEKDAY}))}) AS v WHERE asset_id = '1-URGENT'"),
    "weekly_by_asset": (_by_asset(views.weekly_agg), f"SELECT * FROM ({labelled_sql(bars_sql(ORDERS, {'week_start': WEEK}))}) AS v WHERE asset_id = '1-URGENT'"),
    "monthly_by_asset": (_by_asset(views.monthly_agg), f"SELECT * FROM ({labelled_sql(bars_sql(ORDERS, {'month_start': MONTH}))}) AS v WHERE asset_id = '1-URGENT'"),
    "latest_n_bound": (q_latest_n_bound, f"SELECT * FROM ({EVENTS}) AS md WHERE asset_id = 'view' ORDER BY ts DESC, seq DESC LIMIT 40"),
    "sql_functions": (q_sql_functions, f"SELECT asset_id, ts, {SESSION} AS session, {candle_sql()} AS candle_pattern FROM ({HOURLY}) AS h"),
    "csv_round_trip": (
        q_csv_round_trip,
        f"""SELECT 'asset:' || asset_id AS asset_id, asset_id AS symbol, 'USD' AS currency, ts, open, high, low, close, volume, 0::BIGINT AS seq, 'file' AS source
 FROM (SELECT * FROM ({HOURLY}) AS h UNION ALL SELECT * FROM ({HOURLY}) AS h WHERE asset_id = (SELECT min(event_type) FROM events)) AS twice""",
    ),
    "conform_market_data": (q_conform("market_data"), "SELECT NULL::VARCHAR AS id, event_type AS asset_id, ts, NULL::DOUBLE AS open, value AS high, value AS low, value AS close, CAST(json_extract(props, '$.k') AS DOUBLE) AS volume, event_id AS seq, NULL::VARCHAR AS source FROM events"),
    "conform_orders": (
        q_conform("orders"),
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS asset_id, NULL::VARCHAR AS client_order_id, {allowed_sql("side")} AS side, NULL::DOUBLE AS qty, o_totalprice AS price,
 {allowed_sql("order_type")} AS order_type, CASE WHEN o_orderkey % 5 <> 0 THEN {allowed_sql("status")} ELSE 'Pending' END AS status, o_orderdate AS created_ts, NULL::TIMESTAMP AS updated_ts,
 o_orderstatus || '|' || o_orderpriority AS tags, '{{"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '"}}' AS meta FROM orders""",
    ),
    "conform_assets": (
        q_conform("assets"),
        """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS symbol, NULL::VARCHAR AS name, NULL::VARCHAR AS asset_class, NULL::VARCHAR AS currency, s_acctbal AS tick_size, NULL::DOUBLE AS lot_size,
 CAST(s_suppkey % 9 AS INTEGER) AS price_decimals, NULL::VARCHAR AS exchange, NULL::VARCHAR AS timezone, s_suppkey % 3 <> 0 AS active, NULL::TIMESTAMP AS first_listed_ts FROM supplier""",
    ),
    "conform_predictions": (q_conform("predictions"), "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS asset_id, ts, 60000::BIGINT AS horizon_ms, value AS predicted_price, NULL::FLOAT AS confidence, NULL::VARCHAR AS model_id, NULL::VARCHAR AS input_market_data_id, NULL::VARCHAR AS notes FROM events"),
    "conform_strategies": (q_conform("strategies"), """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, NULL::VARCHAR AS description, p_brand || '|' || p_type AS applicable_assets,
 '{"size":' || p_size || '}' AS params, p_partkey % 2 <> 0 AS active, NULL::TIMESTAMP AS created_ts FROM part"""),
    "refresh": (q_refresh, all_rows_sql(REFRESHED_SQL, "daily")),
    "latest_n_stored": (q_latest_n_stored, f"SELECT * FROM ({EVENTS}) AS md WHERE asset_id = 'click' ORDER BY ts DESC, seq DESC LIMIT 25"),
    "named_views": (q_named_views, all_rows_sql(EVENTS)),
    "csv_quarantine": (
        q_csv_quarantine,
        f"""SELECT asset_id, seq, CASE WHEN seq % 13 <> 0 THEN ts END AS ts, CASE WHEN seq % 11 <> 0 THEN open END AS open, CASE WHEN seq % 17 <> 0 THEN high END AS high,
 CASE WHEN seq % 19 <> 0 THEN low END AS low, close, CASE WHEN seq % 11 <> 0 THEN volume END AS volume,
 nullif(concat_ws(', ', CASE WHEN seq % 13 = 0 THEN 'Date and Time' END, CASE WHEN seq % 11 = 0 THEN 'Open' END, CASE WHEN seq % 17 = 0 THEN 'High' END, CASE WHEN seq % 19 = 0 THEN 'Low' END,
 CASE WHEN seq % 11 = 0 THEN 'Volume' END), '') AS reason FROM ({HOURLY}) AS h""",
    ),
}
QUERIES = {name: query for name, (query, _) in TABLE.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in TABLE.items()}
