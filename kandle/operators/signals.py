"""Signals W15-W26 and the signal registry.

A signal is a named Column builder returning 0/1 (null-safe: a comparison with NULL is 0, as
pandas gives False for NaN). Users register their own with ``register_signal``; Catalyst sees
plain expressions. Flags do not depend on parameters, so they are computed once per bar; scores
and entries are weighted sums of flags per parameter row.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kandle.operators.indicators import with_indicators, with_supertrend_narrow
from kandle.operators.layout import KEYS, PART_ROWS, drop_halo, layout, many_parts

LONG_SIGNALS: dict[str, Callable[[], Column]] = {}
SHORT_SIGNALS: dict[str, Callable[[], Column]] = {}


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def register_signal(name: str, long: bool = True):
    def deco(fn):
        (LONG_SIGNALS if long else SHORT_SIGNALS)[name] = fn
        return fn
    return deco


c = F.col
# Fixed values that must equal the reference's signal thresholds.
VB_RANGE_MULT = 0.5
SMART_RSI_LONG = (45.0, 75.0)
SMART_RSI_SHORT = (65.0, 90.0)
DEFAULT_THRESHOLD = 5


@register_signal("supertrend", long=True)
def _l_st():
    return flag(c("close") > c("SUPERTREND"))


@register_signal("supertrend", long=False)
def _s_st():
    return flag(c("close") < c("SUPERTREND"))


@register_signal("volatility_breakout", long=True)
def _l_vb():
    return flag(c("open") > c("_po") + (c("_ph") - c("_pl")) * VB_RANGE_MULT)


@register_signal("volatility_breakout", long=False)
def _s_vb():
    return flag(c("open") < c("_po") - (c("_ph") - c("_pl")) * VB_RANGE_MULT)


@register_signal("trend_up", long=True)
def _l_tu():
    return flag(c("_trend_d") > 0)


@register_signal("trend_down", long=False)
def _s_td():
    return flag(c("_trend_d") < 0)


@register_signal("atr_breakout", long=True)
def _l_ab():
    return flag(c("_d") > c("ATR"))


@register_signal("atr_breakout", long=False)
def _s_ab():
    return flag(c("_d") < -c("ATR"))


@register_signal("smart_macd", long=True)
def _l_sm():
    return flag((c("SMART_MACD") > c("SMART_SIGNAL")) & (c("_psm") <= c("_pss")) & (c("SMART_MACD") > 0))


@register_signal("smart_macd", long=False)
def _s_sm():
    return flag((c("SMART_MACD") < c("SMART_SIGNAL")) & (c("_psm") >= c("_pss")) & (c("SMART_MACD") < 0))


@register_signal("smart_rsi", long=True)
def _l_sr():
    return flag((c("SMART_RSI") > SMART_RSI_LONG[0]) & (c("SMART_RSI") < SMART_RSI_LONG[1]))


@register_signal("smart_rsi", long=False)
def _s_sr():
    return flag((c("SMART_RSI") > SMART_RSI_SHORT[0]) & (c("SMART_RSI") < SMART_RSI_SHORT[1]))


@register_signal("below_ema9", long=False)
def _s_be():
    return flag(c("close") < c("EMA_9"))


@register_signal("smart_trend", long=True)
def _l_stt():
    return flag(c("smart_trend") == 1)


@register_signal("smart_trend", long=False)
def _s_stt():
    return flag(c("smart_trend") == -1)


@register_signal("volume_above_avg", long=True)
def _l_va():
    return flag(c("volume") > F.coalesce(c("Volume_SMA_20"), c("volume")))


FLAG_COLS_LONG = [f"long_{n}" for n in LONG_SIGNALS]
FLAG_COLS_SHORT = [f"short_{n}" for n in SHORT_SIGNALS]

# columns kept after the indicator step (everything else starting with '_' is dropped)
KEEP_HELPERS = ["_atr10"]


def with_flags(df: DataFrame, supertrend: bool = True) -> DataFrame:
    """All registered flags on an indicator frame, in one projection (supertrend's flags need
    the SUPERTREND column; skipped when it is absent or ``supertrend`` is False)."""
    has_st = supertrend and "SUPERTREND" in df.columns
    cols = {f"long_{n}": fn() for n, fn in LONG_SIGNALS.items() if n != "supertrend" or has_st}
    cols.update({f"short_{n}": fn() for n, fn in SHORT_SIGNALS.items() if n != "supertrend" or has_st})
    return df.withColumns(cols)


def signal_table(bars: DataFrame, keys=KEYS, part_rows=None, halo=None) -> DataFrame:
    """W27 without parameters: bars + indicators + every registered 0/1 flag (default params)."""
    kw = {}
    if part_rows:
        kw["part_rows"] = part_rows
    if halo:
        kw["halo"] = halo
    lay = with_supertrend_narrow(layout(bars, keys, **kw), keys, many_parts(bars, keys, part_rows or PART_ROWS))
    df = with_flags(with_indicators(lay, keys))
    keep = [x for x in df.columns if not x.startswith("_") and x not in ("is_halo", "b_lo", "b_hi")]
    return df.where(~F.col("is_halo")).select(*keep)


def _weight(params: dict, name: str):
    return float(params.get(f"w_{name}", 1))


def score_expr(params: dict | None = None) -> list[Column]:
    """W25 + W26 for one parameter dict: long/short score and entry columns."""
    p = params or {}
    longs = p.get("enabled_long_signals", list(LONG_SIGNALS))
    shorts = p.get("enabled_short_signals", list(SHORT_SIGNALS))
    ls = [c(f"long_{s}") * F.lit(_weight(p, s)) for s in longs if s in LONG_SIGNALS]
    ss = [c(f"short_{s}") * F.lit(_weight(p, s)) for s in shorts if s in SHORT_SIGNALS]
    long_score = sum(ls[1:], ls[0]) if ls else F.lit(0.0)
    short_score = sum(ss[1:], ss[0]) if ss else F.lit(0.0)
    le = long_score >= F.lit(float(p.get("long_score_threshold", DEFAULT_THRESHOLD)))
    se = short_score >= F.lit(float(p.get("short_score_threshold", DEFAULT_THRESHOLD)))
    has_trend = ("smart_trend" in longs) or ("smart_trend" in shorts)
    if p.get("use_smart_trend_filter", True) and has_trend:
        le = le & (c("smart_trend") == 1)
        se = se & (c("smart_trend") == -1)
    return [long_score.cast("double").alias("long_score"), short_score.cast("double").alias("short_score"),
            le.alias("long_entry"), se.alias("short_entry")]


def with_scores(df: DataFrame, params: dict | None = None) -> DataFrame:
    return df.select("*", *score_expr(params))


def with_param_scores(df: DataFrame, params: DataFrame) -> DataFrame:
    """W25/W26 for a whole parameter table (G02): flags x params. Every bar is wanted with every row of
    ``params``; Spark broadcasts the table if its measured size allows, else it pairs partitions.

    ``params`` has param_id, w_<signal> weights (missing -> 1), long/short_score_threshold and
    use_smart_trend_filter; every signal is enabled (the tuned search space has no enable lists)."""
    j = df.crossJoin(params)
    return j.select("*", *entry_columns(params.columns))


def entry_columns(names) -> list[Column]:
    """W25/W26 for rows that carry a setting in the columns ``names``: scores and entries."""
    pcols = set(names)

    def w(name):
        return F.coalesce(c(f"w_{name}").cast("double"), F.lit(1.0)) if f"w_{name}" in pcols else F.lit(1.0)
    ls = [c(f"long_{s}") * w(s) for s in LONG_SIGNALS]
    ss = [c(f"short_{s}") * w(s) for s in SHORT_SIGNALS]
    long_score = sum(ls[1:], ls[0])
    short_score = sum(ss[1:], ss[0])
    trend_on = F.coalesce(c("use_smart_trend_filter"), F.lit(True)) if "use_smart_trend_filter" in pcols else F.lit(True)
    le = (long_score >= c("long_score_threshold")) & (~trend_on | (c("smart_trend") == 1))
    se = (short_score >= c("short_score_threshold")) & (~trend_on | (c("smart_trend") == -1))
    return [long_score.alias("long_score"), short_score.alias("short_score"), le.alias("long_entry"), se.alias("short_entry")]
