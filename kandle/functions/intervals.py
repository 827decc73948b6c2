"""Interval codes (P08) and time helpers as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference: interval codes are minutes as digits, or
# D = 1 day, W = 1 week, M = 30 days.
DAY_SECONDS = 86400
WEEK_SECONDS = 7 * 86400
MONTH_SECONDS = 30 * 86400


def interval_seconds(code: Column | str, strict: bool = True) -> Column:
    """Duration of an interval code in seconds; unknown codes raise (like the reference) when strict."""
    c = F.col(code) if isinstance(code, str) else code
    v = (F.when(c.rlike("^[0-9]+$"), c.cast("bigint") * 60)
         .when(c == "D", F.lit(DAY_SECONDS))
         .when(c == "W", F.lit(WEEK_SECONDS))
         .when(c == "M", F.lit(MONTH_SECONDS)))
    if strict:
        v = v.otherwise(F.raise_error(F.concat(F.lit("unknown interval code: "), c)).cast("bigint"))
    return v


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since epoch of a TIMESTAMP_NTZ (read as UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def epoch_ms(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(c.cast("timestamp"))


def ntz_from_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def ntz_from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")
