"""Registered queries for the recursive indicators, signals, scores and the flagship replay."""
from __future__ import annotations

from pyspark.sql import functions as F

from kandle.operators.indicators import indicator_table
from kandle.operators.layout import KEYS
from kandle.operators.signals import LONG_SIGNALS, SHORT_SIGNALS, signal_table, with_scores
from kandle.plans.common import events_bars, rounded
from kandle.plans.oracle_ind import indicator_sql, scored_sql, select_from_ind
from kandle.plans.queries import query


def _ind(spark, sf_dir, st=False):
    return indicator_table(events_bars(spark, sf_dir), supertrend=st)


def _sel(df, *cols):
    return rounded(df.select(*KEYS, "ts", *cols))


def _reg(name, cols, st=False, spark_cols=None, sql_cols=None):
    sql = select_from_ind(sql_cols or cols)

    def fn(spark, sf_dir):
        df = _ind(spark, sf_dir, st)
        if spark_cols:
            df = df.withColumns({k: F.expr(v) for k, v in spark_cols.items()})
        return _sel(df, *cols)
    fn.__name__ = name
    query(name, sql)(fn)


_reg("w01_atr", ["ATR"])
_reg("w02_rsi", ["RSI"])
_reg("w04_macd", ["MACD", "Signal", "Histogram"])
_reg("w06_ema", ["EMA_9", "EMA_21", "EMA_100", "EMA_200"])
_reg("w09_stochrsi", ["StochRSI_K", "StochRSI_D"])
_reg("w10_adx", ["ADX"])
_reg("w12_tema", ["TEMA_9", "TEMA_21"])
_reg("w13_dema", ["DEMA_8", "DEMA_21"],
     spark_cols={"DEMA_8": "2*_ema8 - _e2_8", "DEMA_21": "2*_ema21 - _e2_21"},
     sql_cols=["2*ema8 - e2_8 AS DEMA_8x", "2*ema21 - e2_21 AS DEMA_21x"])
SQL_FIX = {"w13_dema": select_from_ind(["DEMA_8", "DEMA_21"], src="(SELECT *, 2*ema8 - e2_8 AS DEMA_8, "
                                                                   "2*ema21 - e2_21 AS DEMA_21 FROM ind) q")}
_reg("w14_supertrend", ["SUPERTREND"], st=True)
_reg("w20_smart_rsi_value", ["SMART_RSI"])
_reg("w22_smart_trend_value", ["EMA_TREND", "smart_trend"],
     sql_cols=["EMA_TREND", "smart_trend"])
SQL_FIX["w22_smart_trend_value"] = select_from_ind(["EMA_TREND", "smart_trend"],
                                                   src="(SELECT *, ema_trend AS EMA_TREND FROM ind) q")
_reg("w19_smart_macd_value", ["SMART_MACD", "SMART_SIGNAL", "SMART_HIST"])
_reg("w24_atr_filter", ["atr_filter"])

from kandle.plans import queries as _q  # noqa: E402
_q.SQL.update(SQL_FIX)

FLAGS = [f"long_{s}" for s in LONG_SIGNALS] + [f"short_{s}" for s in SHORT_SIGNALS]


@query("w27_signal_flags", scored_sql() + f'\nSELECT symbol, "interval", ts, {", ".join(FLAGS)} FROM flags')
def w27_signal_flags(spark, sf_dir):
    return _sel(signal_table(events_bars(spark, sf_dir)), *FLAGS)


@query("w26_entries", scored_sql() + '\nSELECT symbol, "interval", ts, long_score, short_score, '
                                     'long_entry, short_entry FROM scored')
def w26_entries(spark, sf_dir):
    return _sel(with_scores(signal_table(events_bars(spark, sf_dir))), "long_score", "short_score",
                "long_entry", "short_entry")


def _unpivot_sql():
    parts = [f"SELECT symbol, \"interval\", '{s}' AS signal, 'long' AS side, CAST(sum(long_{s}) AS BIGINT) AS hits "
             f"FROM flags GROUP BY ALL" for s in LONG_SIGNALS]
    parts += [f"SELECT symbol, \"interval\", '{s}' AS signal, 'short' AS side, CAST(sum(short_{s}) AS BIGINT) AS hits "
              f"FROM flags GROUP BY ALL" for s in SHORT_SIGNALS]
    return scored_sql() + "\n" + " UNION ALL ".join(parts)


@query("a12_signal_hits", _unpivot_sql())
def a12_signal_hits(spark, sf_dir):
    """Hit count per signal and series (unpivot of the flag sums)."""
    sig = signal_table(events_bars(spark, sf_dir))
    sums = sig.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in FLAGS])
    stack = ", ".join(f"'{c.split('_', 1)[1]}', '{c.split('_', 1)[0]}', `{c}`" for c in FLAGS)
    return sums.selectExpr(*[f"`{k}`" for k in KEYS], f"stack({len(FLAGS)}, {stack}) AS (signal, side, hits)") \
               .withColumn("hits", F.col("hits").cast("bigint"))


@query("a10_class_distribution", scored_sql() + '\nSELECT symbol, "interval", long_entry, count(*) AS n '
                                                'FROM scored GROUP BY ALL')
def a10_class_distribution(spark, sf_dir):
    """A10: class distribution of long_entry per series."""
    sc = with_scores(signal_table(events_bars(spark, sf_dir)))
    return sc.groupBy(*KEYS, "long_entry").agg(F.count(F.lit(1)).alias("n"))


@query("w28_macd_cross", indicator_sql() + """,
m AS (SELECT *, lag(MACD) OVER (PARTITION BY symbol, "interval" ORDER BY ts) AS pm,
                lag(Signal) OVER (PARTITION BY symbol, "interval" ORDER BY ts) AS ps FROM ind)
SELECT symbol, "interval", ts, CASE WHEN MACD > Signal THEN 'buy' ELSE 'sell' END AS marker,
  round(MACD, 6) AS MACD FROM m WHERE (pm < ps AND MACD > Signal) OR (pm > ps AND MACD < Signal)""")
def w28_macd_cross(spark, sf_dir):
    """MACD/signal crossing markers (chart feed): strictly on one side before, strictly on the other now."""
    df = indicator_table(events_bars(spark, sf_dir), supertrend=False,
                         extra=lambda d, w: d.withColumns({"_pm": F.lag("MACD").over(w), "_ps": F.lag("Signal").over(w)}))
    up = (F.col("MACD") > F.col("Signal")) & (F.col("_pm") < F.col("_ps"))
    dn = (F.col("MACD") < F.col("Signal")) & (F.col("_pm") > F.col("_ps"))
    return _sel(df.where(up | dn).withColumn("marker", F.when(up, "buy").otherwise("sell")), "marker", "MACD")


@query("w29_chart_feeds", indicator_sql() + """
SELECT symbol, "interval", ts, round(RSI, 6) AS RSI,
  CASE WHEN RSI >= 70 THEN 'overbought' WHEN RSI <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_band,
  CASE WHEN Histogram >= 0 THEN 'green' ELSE 'red' END AS hist_colour,
  CASE WHEN close > open THEN 'green' ELSE 'red' END AS candle_colour,
  round(EMA_9, 6) AS EMA_9, round(EMA_21, 6) AS EMA_21 FROM ind""")
def w29_chart_feeds(spark, sf_dir):
    """W29 + P13: RSI 70/30 band, histogram sign colour, candle colour, EMA panel feed."""
    df = _ind(spark, sf_dir).withColumns({
        "rsi_band": F.when(F.col("RSI") >= 70, "overbought").when(F.col("RSI") <= 30, "oversold").otherwise("neutral"),
        "hist_colour": F.when(F.col("Histogram") >= 0, "green").otherwise("red"),
        "candle_colour": F.when(F.col("close") > F.col("open"), "green").otherwise("red")})
    return _sel(df, "RSI", "rsi_band", "hist_colour", "candle_colour", "EMA_9", "EMA_21")
