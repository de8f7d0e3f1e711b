"""Trading sessions by UTC hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sessions with their first hours, in order of the day.
SESSION_STARTS = [("AS", 0), ("LN", 8), ("NYAM", 15), ("NYL", 18), ("NYPM", 20)]
SESSIONS = [name for name, _ in SESSION_STARTS]


def session_label(ts: Column) -> Column:
    """The session of a timestamp; null for null."""
    hour = F.hour(ts)
    label = F.lit(None).cast("string")
    for name, start in SESSION_STARTS:
        label = F.when(hour >= start, F.lit(name)).otherwise(label)
    return label


def session_sql(ts: str) -> str:
    """``session_label`` as SQL text."""
    cases = " ".join(f"WHEN hour({ts}) >= {start} THEN '{name}'" for name, start in reversed(SESSION_STARTS))
    return f"CASE {cases} END"


def session_parse(text: Column, strict: bool = False) -> Column:
    """The session that ``text`` names in any case; else null, or an error if ``strict``. "None" names no session."""
    upper = F.upper(text)
    other = F.raise_error(F.concat(F.lit("not a session: "), text)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(upper.isin(SESSIONS), upper).otherwise(other)
