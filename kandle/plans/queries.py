"""Registered queries (one per SURVEY section-2 id) and their DuckDB oracles.

Every query reads the driver tables (bars come from ``events`` via S14) and runs over the whole
tables. Doubles are rounded to 6 digits on both sides.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kandle.operators.indicators import indicator_table
from kandle.operators.layout import KEYS
from kandle.plans.common import BARS_SQL, SERIES_SQL, events_bars, rounded

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _ind(spark, sf_dir, supertrend=False):
    return indicator_table(events_bars(spark, sf_dir), supertrend=supertrend)


def _sel(df: DataFrame, *cols) -> DataFrame:
    return rounded(df.select(*KEYS, "ts", *cols))


# ---------------------------------------------------------------- S14 bars
@query("s14_bars", f"WITH {BARS_SQL} SELECT symbol, \"interval\", ts, ts_ms, round(open, 6) AS open, "
                   "round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, "
                   "round(volume, 6) AS volume FROM bars")
def s14_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events_bars(spark, sf_dir))


# ---------------------------------------------------------------- framed windows (sql oracles)
_W = 'PARTITION BY symbol, "interval" ORDER BY ts'


@query("w03_volume_sma", f"WITH {BARS_SQL} SELECT symbol, \"interval\", ts, "
                         f"round(avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS Volume_SMA_20 "
                         f"FROM bars WINDOW w AS ({_W})")
def w03(spark, sf_dir):
    return _sel(_ind(spark, sf_dir), "Volume_SMA_20")


@query("w05_bbands", f"""WITH {BARS_SQL}, b AS (
  SELECT symbol, "interval", ts, close,
    CASE WHEN count(close) OVER w20 >= 20 THEN avg(close) OVER w20 END AS m,
    CASE WHEN count(close) OVER w20 >= 20 THEN stddev_pop(close) OVER w20 END AS sd
  FROM bars WINDOW w20 AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, "interval", ts, round(m - 2*sd, 6) AS BBL, round(m, 6) AS BBM, round(m + 2*sd, 6) AS BBU,
  round(100*(4*sd)/nullif(m, 0), 6) AS BBB, round((close - (m - 2*sd))/nullif(4*sd, 0), 6) AS BBP FROM b""")
def w05(spark, sf_dir):
    return _sel(_ind(spark, sf_dir), "BBL", "BBM", "BBU", "BBB", "BBP")


@query("w07_cci", f"""WITH {SERIES_SQL}, t AS (
  SELECT *, (high + low + close)/3 AS tp FROM series),
m AS (SELECT *, CASE WHEN count(tp) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20
                     THEN avg(tp) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sma FROM t),
d AS (SELECT a.symbol, a."interval", a.ts, a.tp, a.sma, avg(abs(b.tp - a.sma)) AS mad
      FROM m a JOIN t b ON a.symbol = b.symbol AND a."interval" = b."interval" AND b.rn BETWEEN a.rn - 19 AND a.rn
      GROUP BY a.symbol, a."interval", a.ts, a.tp, a.sma)
SELECT symbol, "interval", ts, round((tp - sma)/nullif(0.015*mad, 0), 6) AS CCI FROM d""")
def w07(spark, sf_dir):
    return _sel(_ind(spark, sf_dir), "CCI")


@query("w08_mfi", f"""WITH {BARS_SQL}, t AS (
  SELECT *, (high + low + close)/3 AS tp FROM bars),
f AS (SELECT *, CASE WHEN tp - lag(tp) OVER ({_W}) > 0 THEN tp*volume ELSE 0 END AS pmf,
                CASE WHEN tp - lag(tp) OVER ({_W}) < 0 THEN tp*volume ELSE 0 END AS nmf FROM t),
s AS (SELECT *, count(pmf) OVER w14 AS n, sum(pmf) OVER w14 AS ps, sum(nmf) OVER w14 AS ns
      FROM f WINDOW w14 AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, "interval", ts, round(CASE WHEN n >= 14 THEN 100*ps/nullif(ps + ns, 0) END, 6) AS MFI FROM s""")
def w08(spark, sf_dir):
    return _sel(_ind(spark, sf_dir), "MFI")


@query("w11_roc", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts,
  round(100*(close - lag(close, 5) OVER ({_W}))/nullif(lag(close, 5) OVER ({_W}), 0), 6) AS ROC FROM bars""")
def w11(spark, sf_dir):
    return _sel(_ind(spark, sf_dir), "ROC")


@query("w24_filters", f"""WITH {BARS_SQL}, b AS (
  SELECT *, avg(volume) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vs,
    CASE WHEN count(volume) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 10
         THEN max(volume) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS vp,
    CASE WHEN count(close) OVER w20 >= 20 THEN avg(close) OVER w20 END AS m,
    CASE WHEN count(close) OVER w20 >= 20 THEN stddev_pop(close) OVER w20 END AS sd
  FROM bars WINDOW w20 AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, "interval", ts, CAST(coalesce(volume > vs, false) AS INTEGER) AS volume_above_avg,
  CAST(coalesce(volume > vp, false) AS INTEGER) AS volume_peak,
  CAST(coalesce((close - (m - 2*sd))/nullif(4*sd, 0) > 0.5, false) AS INTEGER) AS bbp_filter FROM b""")
def w24(spark, sf_dir):
    return _sel(_ind(spark, sf_dir), "volume_above_avg", "volume_peak", "bbp_filter")


@query("w16_volatility_breakout", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts,
  CAST(coalesce(open > lag(open) OVER w + 0.5*(lag(high) OVER w - lag(low) OVER w), false) AS INTEGER) AS long_volatility_breakout,
  CAST(coalesce(open < lag(open) OVER w - 0.5*(lag(high) OVER w - lag(low) OVER w), false) AS INTEGER) AS short_volatility_breakout
  FROM bars WINDOW w AS ({_W})""")
def w16(spark, sf_dir):
    from kandle.operators.signals import LONG_SIGNALS, SHORT_SIGNALS
    df = _ind(spark, sf_dir).withColumns({"long_volatility_breakout": LONG_SIGNALS["volatility_breakout"](),
                                          "short_volatility_breakout": SHORT_SIGNALS["volatility_breakout"]()})
    return _sel(df, "long_volatility_breakout", "short_volatility_breakout")


@query("w23_volume_above_avg", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts,
  CAST(coalesce(volume > avg(volume) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS INTEGER)
  AS long_volume_above_avg FROM bars""")
def w23(spark, sf_dir):
    from kandle.operators.signals import LONG_SIGNALS
    df = _ind(spark, sf_dir).withColumn("long_volume_above_avg", LONG_SIGNALS["volume_above_avg"]())
    return _sel(df, "long_volume_above_avg")
