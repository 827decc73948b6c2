"""Per-row trading expressions (P05-P07, P09, P10, P14) as Columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from kandle.functions.intervals import interval_seconds

# Fixed values that must equal the reference's risk defaults.
TP_ATR_MULT, SL_ATR_MULT = 2.0, 1.2
TP_FALLBACK, SL_FALLBACK = 0.05, 0.02
INV_BASE, INV_MAX, INV_MIN = 0.05, 0.20, 0.01


def _num(x) -> Column:
    """The value as double when its type is numeric, else NULL (the reference rejects any
    non-number input, numeric text included)."""
    c = F.col(x) if isinstance(x, str) else x
    numeric = F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    return F.when(numeric, c.cast("double"))


def position_size(balance, risk_pct, leverage, sl_pct, price) -> Column:
    """balance*risk*leverage/sl/price; 0 if any input is non-numeric or price/sl/risk/leverage <= 0."""
    b, r, lv, sl, p = (_num(x) for x in (balance, risk_pct, leverage, sl_pct, price))
    bad = b.isNull() | r.isNull() | lv.isNull() | sl.isNull() | p.isNull() | (p <= 0) | (sl <= 0) | (r <= 0) | (lv <= 0)
    return F.when(bad, F.lit(0.0)).otherwise(b * r * lv / sl / p)


def dynamic_tp_sl(atr, entry_price) -> Column:
    """struct(tp, sl) as fractions of price from ATR; defaults when atr or price <= 0."""
    a, p = _num(atr), _num(entry_price)
    ok = (a > 0) & (p > 0)
    return F.struct(F.when(ok, a * TP_ATR_MULT / p).otherwise(TP_FALLBACK).alias("tp"),
                    F.when(ok, a * SL_ATR_MULT / p).otherwise(SL_FALLBACK).alias("sl"))


def inverse_balance_risk(current, initial) -> Column:
    """clip(base*initial/current, min, max); max when current <= 0."""
    c, i = _num(current), _num(initial)
    return F.when(c <= 0, F.lit(INV_MAX)).otherwise(F.least(F.greatest(INV_BASE * i / c, F.lit(INV_MIN)), F.lit(INV_MAX)))


def should_update(latest_ms, interval_code, now_ms: int, tolerance_minutes: int = 1) -> Column:
    """The next candle is due: now >= last + interval - tolerance (now is a parameter)."""
    l = F.col(latest_ms) if isinstance(latest_ms, str) else latest_ms
    return F.lit(now_ms) >= l + interval_seconds(interval_code) * 1000 - tolerance_minutes * 60_000


def trade_side(action) -> Column:
    """P10: long/short from the action text, else NULL."""
    a = F.col(action) if isinstance(action, str) else action
    return F.when(a.contains("LONG"), "long").when(a.contains("SHORT"), "short")


def marker(action) -> Column:
    """Chart marker (shape, colour) by action: OPEN, TP, SL, CLOSE tested in that order."""
    a = F.col(action) if isinstance(action, str) else action
    # Fixed values that must equal the reference's marker table.
    shape = (F.when(a.contains("OPEN"), F.when(a.contains("SHORT"), "triangle-down").otherwise("triangle-up"))
             .when(a.contains("TP"), "star").when(a.contains("SL"), "x").when(a.contains("CLOSE"), "circle")
             .otherwise("diamond"))
    colour = (F.when(a.contains("OPEN"), "orange").when(a.contains("TP"), "lime").when(a.contains("SL"), "red")
              .when(a.contains("CLOSE"), "white").otherwise("blue"))
    return F.struct(shape.alias("shape"), colour.alias("colour"))
