"""DuckDB oracle for the recursive indicators: chained recursive CTEs, one row step per series.

Independent of the Spark implementation (which uses block-parallel window scans): here every
EMA/RMA/EWM is the plain recurrence and supertrend is its ratchet, row by row.
"""
from __future__ import annotations

from kandle.operators import indicators as I
from kandle.plans.common import SERIES_SQL

K = 'i.symbol = r.symbol AND i."interval" = r."interval" AND i.rn = r.rn + 1'
W = 'PARTITION BY symbol, "interval" ORDER BY ts'


def _rec(name: str, src: str, states: dict[str, str]) -> str:
    """Recursive CTE: ``states`` maps column -> update expression over i.* and r.<col>."""
    init = []
    for col, upd in states.items():
        e = upd
        for c2 in states:
            e = e.replace(f"r.{c2}", "CAST(NULL AS DOUBLE)")
        init.append(f"{e} AS {col}")
    step = ", ".join(f"{upd} AS {col}" for col, upd in states.items())
    return (f"{name} AS (SELECT i.*, {', '.join(init)} FROM {src} i WHERE i.rn = 0 "
            f"UNION ALL SELECT i.*, {step} FROM {name} r JOIN {src} i ON {K})")


def rma(x: str, n: int, f: int, col: str) -> dict:
    q = 1.0 - 1.0 / n
    return {f"{col}_num": f"CASE WHEN i.rn < {f} THEN NULL WHEN i.rn = {f} THEN coalesce(i.{x}, 0) "
                          f"ELSE {q!r}*r.{col}_num + coalesce(i.{x}, 0) END",
            f"{col}_den": f"CASE WHEN i.rn < {f} THEN NULL WHEN i.rn = {f} THEN 1.0 ELSE {q!r}*r.{col}_den + 1.0 END"}


def ema_seeded(x: str, seed: str, n: int, start: int, col: str) -> dict:
    a = 2.0 / (n + 1.0)
    s = start + n - 1
    return {col: f"CASE WHEN i.rn < {s} THEN NULL WHEN i.rn = {s} THEN i.{seed} "
                 f"ELSE {1 - a!r}*r.{col} + {a!r}*i.{x} END"}


def ewm(x: str, span: float, f: int, col: str) -> dict:
    a = 2.0 / (span + 1.0)
    return {col: f"CASE WHEN i.rn < {f} THEN NULL WHEN i.rn = {f} THEN i.{x} "
                 f"ELSE {1 - a!r}*r.{col} + {a!r}*i.{x} END"}


def _val(col: str, n: int, f: int) -> str:
    return f"CASE WHEN rn - {f} + 1 >= {n} THEN {col}_num / {col}_den END"


def indicator_sql(series_sql: str = SERIES_SQL) -> str:
    ema_ns = sorted({*I.EMA_LENS, I.MACD_FAST, I.MACD_SLOW, I.DEMA_FAST})
    seeds = ", ".join(f"avg(close) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS seed{n}" for n in ema_ns)
    x0 = f"""x0 AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl,
      lag(open) OVER ({W}) AS po, {seeds} FROM series)"""
    x1 = """x1 AS (SELECT *, CASE WHEN rn >= 1 THEN greatest(high - low, abs(high - pc), abs(pc - low)) END AS tr,
      CASE WHEN rn >= 1 THEN close - pc END AS d,
      CASE WHEN rn >= 1 THEN (CASE WHEN close - pc > 0 THEN close - pc ELSE 0 END) END AS gain,
      CASE WHEN rn >= 1 THEN (CASE WHEN close - pc < 0 THEN pc - close ELSE 0 END) END AS loss,
      CASE WHEN rn >= 1 THEN (CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END) END AS pdm,
      CASE WHEN rn >= 1 THEN (CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END) END AS ndm,
      coalesce(CASE WHEN close - pc > 0 THEN close - pc END, 0) * volume AS srg,
      -coalesce(CASE WHEN close - pc < 0 THEN close - pc END, 0) * volume AS srl FROM x0)"""
    s1 = {}
    s1 |= rma("tr", I.ATR_LEN, 1, "atr")
    s1 |= rma("tr", I.SUPERTREND_LEN, 1, "atr10")
    s1 |= rma("gain", I.RSI_LEN, 1, "up")
    s1 |= rma("loss", I.RSI_LEN, 1, "dn")
    s1 |= rma("pdm", I.ADX_LEN, 1, "pdms")
    s1 |= rma("ndm", I.ADX_LEN, 1, "ndms")
    for n in ema_ns:
        s1 |= ema_seeded("close", f"seed{n}", n, 0, f"ema{n}")
    s1 |= ewm("close", I.TREND_SPAN, 0, "ewm50")
    s1 |= ewm("close", I.SMART_TREND_SPAN, 0, "ema_trend")
    s1 |= ewm("srg", I.SMART_RSI_SPAN, 0, "srg_e")
    s1 |= ewm("srl", I.SMART_RSI_SPAN, 0, "srl_e")
    r1 = _rec("r1", "x1", s1)
    tema_ns = sorted({*I.TEMA_LENS, I.DEMA_FAST, I.DEMA_SLOW})
    y1 = f"""y1a AS (SELECT *, {_val('atr', I.ATR_LEN, 1)} AS ATR, {_val('atr10', I.SUPERTREND_LEN, 1)} AS atr10v,
      {_val('up', I.RSI_LEN, 1)} AS upv, {_val('dn', I.RSI_LEN, 1)} AS dnv,
      {_val('pdms', I.ADX_LEN, 1)} AS pdmv, {_val('ndms', I.ADX_LEN, 1)} AS ndmv, ema{I.MACD_FAST} - ema{I.MACD_SLOW} AS MACD
      FROM r1),
    y1 AS (SELECT *, 100*upv/nullif(upv + dnv, 0) AS RSI,
      100*abs(100*pdmv/nullif(ATR, 0) - 100*ndmv/nullif(ATR, 0))
        / nullif(100*pdmv/nullif(ATR, 0) + 100*ndmv/nullif(ATR, 0), 0) AS DX,
      avg(MACD) OVER ({W} ROWS BETWEEN {I.MACD_SIGNAL - 1} PRECEDING AND CURRENT ROW) AS seed_sig,
      {', '.join(f'avg(ema{n}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS seed2_{n}' for n in tema_ns)}
      FROM y1a)"""
    s2 = {}
    s2 |= ema_seeded("MACD", "seed_sig", I.MACD_SIGNAL, I.MACD_SLOW - 1, "Signal")
    for n in tema_ns:
        s2 |= ema_seeded(f"ema{n}", f"seed2_{n}", n, 0, f"e2_{n}")
    s2 |= rma("DX", I.ADX_LEN, I.ATR_LEN, "adx")
    r2 = _rec("r2", "y1", s2)
    y2 = f"""y2 AS (SELECT *, {_val('adx', I.ADX_LEN, I.ATR_LEN)} AS ADX, MACD - Signal AS Histogram,
      (2*ema{I.DEMA_FAST} - e2_{I.DEMA_FAST}) - (2*ema{I.DEMA_SLOW} - e2_{I.DEMA_SLOW}) AS SMART_MACD,
      {', '.join(f'avg(e2_{n}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS seed3_{n}' for n in I.TEMA_LENS)}
      FROM r2)"""
    s3 = {}
    for n in I.TEMA_LENS:
        s3 |= ema_seeded(f"e2_{n}", f"seed3_{n}", n, 0, f"e3_{n}")
    s3 |= ewm("SMART_MACD", I.SMART_SIGNAL_SPAN, I.DEMA_SLOW - 1, "SMART_SIGNAL")
    r3 = _rec("r3", "y2", s3)
    m = I.SUPERTREND_MULT
    ub, lb = f"((i.high + i.low)/2 + {m}*i.atr10v)", f"((i.high + i.low)/2 - {m}*i.atr10v)"
    up_, dn_ = f"coalesce(i.close > r.ubv, false)", f"coalesce(i.close < r.lbv, false)"
    dnew = f"CASE WHEN i.rn = 0 THEN 1 WHEN {up_} THEN 1 WHEN {dn_} THEN -1 ELSE r.sd END"
    s4 = {"sd": dnew,
          "lbv": f"CASE WHEN i.rn > 0 AND NOT {up_} AND NOT {dn_} AND r.sd > 0 AND coalesce({lb} < r.lbv, false) "
                 f"THEN r.lbv ELSE {lb} END",
          "ubv": f"CASE WHEN i.rn > 0 AND NOT {up_} AND NOT {dn_} AND r.sd < 0 AND coalesce({ub} > r.ubv, false) "
                 f"THEN r.ubv ELSE {ub} END"}
    r4 = _rec("r4", "y3", s4).replace("CAST(NULL AS DOUBLE) > 0", "false").replace("CAST(NULL AS DOUBLE) < 0", "false")
    y3 = f"""y3 AS (SELECT *, {', '.join(f'3*(ema{n} - e2_{n}) + e3_{n} AS TEMA_{n}' for n in I.TEMA_LENS)},
      (SMART_MACD - SMART_SIGNAL)/(ATR + 1e-9) AS SMART_HIST FROM r3)"""
    r20 = f"{W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
    fin = f"""z0 AS (SELECT *, CASE WHEN rn > 0 THEN (CASE WHEN sd > 0 THEN lbv ELSE ubv END) END AS SUPERTREND,
      {', '.join(f'ema{n} AS EMA_{n}' for n in I.EMA_LENS)},
      ewm50 - lag(ewm50) OVER ({W}) AS tslope, ema_trend - lag(ema_trend) OVER ({W}) AS eslope,
      lag(SMART_MACD) OVER ({W}) AS psm, lag(SMART_SIGNAL) OVER ({W}) AS pss,
      CASE WHEN count(RSI) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 14
           THEN min(RSI) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS rmin,
      CASE WHEN count(RSI) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 14
           THEN max(RSI) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS rmax,
      CASE WHEN count(volume) OVER ({r20}) >= 20 THEN avg(volume) OVER ({r20}) END AS vsma,
      avg(volume) OVER ({r20}) AS Volume_SMA_20,
      CASE WHEN count(ATR) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) >= 50
           THEN avg(ATR) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS atrm
      FROM r4),
    z1 AS (SELECT *, 100*(RSI - rmin)/nullif(rmax - rmin, 0) AS stoch,
      eslope/(ATR + 1e-9) * (volume / greatest(vsma, 1)) AS vw,
      least(greatest(100 - 100/(1 + srg_e/(srl_e + 1e-9))
            + CASE WHEN tslope > 0 THEN 2 WHEN tslope < 0 THEN -2 ELSE 0 END, 0), 100) AS SMART_RSI FROM z0),
    z2 AS (SELECT *, CASE WHEN count(stoch) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3
                         THEN avg(stoch) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS StochRSI_K,
      CASE WHEN count(vw) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 10
           THEN avg(vw) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS smooth FROM z1),
    ind AS (SELECT *, CASE WHEN count(StochRSI_K) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3
                         THEN avg(StochRSI_K) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS StochRSI_D,
      CAST(coalesce(smooth > 0.3, false) AS INT) - CAST(coalesce(smooth < -0.3, false) AS INT) AS smart_trend,
      CAST(coalesce(ATR > atrm, false) AS INT) AS atr_filter FROM z2)"""
    return ("WITH RECURSIVE " + series_sql + ",\n" + ",\n".join([x0, x1, r1, y1, r2, y2, r3, y3, r4, fin]))


FLAGS_SQL = """flags AS (SELECT *,
  CAST(coalesce(close > SUPERTREND, false) AS INT) AS long_supertrend,
  CAST(coalesce(close < SUPERTREND, false) AS INT) AS short_supertrend,
  CAST(coalesce(open > po + 0.5*(ph - pl), false) AS INT) AS long_volatility_breakout,
  CAST(coalesce(open < po - 0.5*(ph - pl), false) AS INT) AS short_volatility_breakout,
  CAST(coalesce(tslope > 0, false) AS INT) AS long_trend_up,
  CAST(coalesce(tslope < 0, false) AS INT) AS short_trend_down,
  CAST(coalesce(d > ATR, false) AS INT) AS long_atr_breakout,
  CAST(coalesce(d < -ATR, false) AS INT) AS short_atr_breakout,
  CAST(coalesce(SMART_MACD > SMART_SIGNAL AND psm <= pss AND SMART_MACD > 0, false) AS INT) AS long_smart_macd,
  CAST(coalesce(SMART_MACD < SMART_SIGNAL AND psm >= pss AND SMART_MACD < 0, false) AS INT) AS short_smart_macd,
  CAST(coalesce(SMART_RSI > 45 AND SMART_RSI < 75, false) AS INT) AS long_smart_rsi,
  CAST(coalesce(SMART_RSI > 65 AND SMART_RSI < 90, false) AS INT) AS short_smart_rsi,
  CAST(coalesce(close < EMA_9, false) AS INT) AS short_below_ema9,
  CAST(smart_trend = 1 AS INT) AS long_smart_trend,
  CAST(smart_trend = -1 AS INT) AS short_smart_trend,
  CAST(coalesce(volume > coalesce(Volume_SMA_20, volume), false) AS INT) AS long_volume_above_avg
  FROM ind)"""

LONG = ["supertrend", "volatility_breakout", "trend_up", "atr_breakout", "smart_macd", "smart_rsi", "smart_trend",
        "volume_above_avg"]
SHORT = ["supertrend", "volatility_breakout", "trend_down", "atr_breakout", "smart_macd", "smart_rsi", "below_ema9",
         "smart_trend"]


def scored_sql(threshold_long=5, threshold_short=5, trend_filter=True, series_sql: str = SERIES_SQL) -> str:
    ls = " + ".join(f"long_{s}" for s in LONG)
    ss = " + ".join(f"short_{s}" for s in SHORT)
    tl = " AND smart_trend = 1" if trend_filter else ""
    ts = " AND smart_trend = -1" if trend_filter else ""
    return (indicator_sql(series_sql) + ",\n" + FLAGS_SQL + f""",
scored AS (SELECT *, CAST({ls} AS DOUBLE) AS long_score, CAST({ss} AS DOUBLE) AS short_score,
  ({ls}) >= {threshold_long}{tl} AS long_entry, ({ss}) >= {threshold_short}{ts} AS short_entry FROM flags)""")


def select_from_ind(cols: list[str], src: str = "ind", sql: str | None = None) -> str:
    body = sql or indicator_sql()
    sel = ", ".join(f"round({c}, 6) AS {c}" if not c.startswith("CAST") else c for c in cols)
    return body + f'\nSELECT symbol, "interval", ts, {sel} FROM {src}'


def param_scored_sql(series_sql: str, params_sql: str) -> str:
    """flags x params: per-trial scores/entries (tuned weight names match no signal: weight 1)."""
    ls = " + ".join(f"long_{s}" for s in LONG)
    ss = " + ".join(f"short_{s}" for s in SHORT)
    return (indicator_sql(series_sql) + ",\n" + FLAGS_SQL + f""",
params AS ({params_sql}),
scored AS (SELECT f.*, p.param_id, ({ls}) >= p.long_score_threshold
    AND (NOT p.use_smart_trend_filter OR smart_trend = 1) AS long_entry,
  ({ss}) >= p.short_score_threshold AND (NOT p.use_smart_trend_filter OR smart_trend = -1) AS short_entry
  FROM flags f CROSS JOIN params p)""")
