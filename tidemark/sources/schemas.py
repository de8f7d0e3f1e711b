"""The tables' schemas, and a job that makes a frame conform to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names and types of the five tables; "!" marks columns that must not be null.
TABLES = {
    "assets": "id string, symbol string!, name string, asset_class string, currency string, tick_size double, lot_size double, price_decimals short, exchange string, timezone string, active boolean, first_listed_ts timestamp",
    "market_data": "id string, asset_id string!, ts timestamp!, open double, high double, low double, close double!, volume double, seq long, source string",
    "orders": "id string, asset_id string!, client_order_id string, side string, qty double, price double, order_type string, status string, created_ts timestamp, updated_ts timestamp, tags array<string>, meta variant",
    "predictions": "id string, asset_id string!, ts timestamp!, horizon_ms long, predicted_price double, confidence float, model_id string, input_market_data_id string, notes string",
    "strategies": "id string, name string!, description string, applicable_assets array<string>, params variant, active boolean, created_ts timestamp",
}
ALLOWED = {
    ("orders", "side"): ["Buy", "Sell"],
    ("orders", "order_type"): ["Market", "Limit", "IOC", "FOK"],
    ("orders", "status"): ["Pending", "New", "PartiallyFilled", "Filled", "Cancelled", "Rejected"],
}
DEFAULTS = {("orders", "status"): "Pending", ("assets", "active"): True, ("strategies", "active"): True}


def columns(table: str) -> list[tuple[str, str, bool]]:
    """(name, type, required) of each column."""
    return [(name, kind.rstrip("!"), kind.endswith("!")) for name, kind in (c.split(" ") for c in TABLES[table].split(", "))]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns, cast to its types. Absent columns become null or the default; a required column
    that is null, or a value outside the allowed ones, is an error when the row is computed."""
    out = []
    for name, kind, required in columns(table):
        col = F.col(name) if name in df.columns else F.lit(None)
        text = kind == "variant" and dict(df.dtypes).get(name) == "string"
        col = F.parse_json(col) if text else col.cast(kind)
        if (default := DEFAULTS.get((table, name))) is not None:
            col = F.coalesce(col, F.lit(default))
        if allowed := ALLOWED.get((table, name)):
            bad = F.raise_error(F.concat(F.lit(f"{table}.{name}: not allowed: "), col)).cast("string")
            col = F.when(col.isNull() | col.isin(allowed), col).otherwise(bad)
        if required:
            col = F.coalesce(col, F.raise_error(F.lit(f"{table}.{name} is null")).cast(kind))
        out.append(col.alias(name))
    return df.select(*out)
