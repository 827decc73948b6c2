"""Shared pieces of the registered queries: inputs from the driver tables, rounding."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kandle.session import tune
from kandle.sources.bars import bars_from_events
from kandle.sources.tables import table

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (float parity between engines, SURVEY 4.5); -0.0 -> 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


SIG_DIGITS = 10


def rounded_sig(df: DataFrame, digits: int = DIGITS, sig: int = SIG_DIGITS) -> DataFrame:
    """Like ``rounded`` but values >= 1e6 in magnitude keep ``sig`` significant digits
    (compounded balances after a ruin reach 1e80 and more)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.expr(sig_round_sql(f"`{f.name}`", digits, sig)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sig_round_sql(x: str, digits: int = DIGITS, sig: int = SIG_DIGITS) -> str:
    """Same text runs in Spark SQL and DuckDB."""
    # 10^m parsed from text: correctly rounded in both engines (pow() may differ by one ulp)
    e = f"CAST(concat('1e', CAST(floor(log10(abs({x}))) - {sig - 1} AS BIGINT)) AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) >= 1e6 THEN round({x} / {e}) * {e} "
            f"ELSE round({x}, {digits}) END + 0.0)")


def events_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return bars_from_events(table(spark, sf_dir, "events"))


# DuckDB: the same bars (S14) as a CTE body.
BARS_SQL = """bars AS (
  SELECT event_type AS symbol, '30' AS "interval", time_bucket(INTERVAL 30 MINUTE, ts) AS ts,
         CAST(epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts)) AS BIGINT) AS ts_ms,
         arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, value)) AS close, sum(value) AS volume
  FROM events GROUP BY event_type, time_bucket(INTERVAL 30 MINUTE, ts))"""

SERIES_SQL = BARS_SQL + """,
series AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY ts) - 1 AS rn FROM bars)"""
