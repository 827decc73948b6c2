"""Technical indicators W01-W14 over the series layout, plus the signal inputs of W17-W24.

Every window here is the canonical (series, part) window or a frame of it, and every recursive
smoothing is an affine scan (kandle.functions.scan), so the whole indicator table is one
exchange + one sort of the bar table. Supertrend's ratchet is not affine: it is the one
per-group fold (applyInPandas over the same (series, part) groups, no extra shuffle).

Definitions (adopted, see SURVEY 2.5): EMAs(n) = SMA-seeded EMA; EWM(n) = ewm(span, adjust=False)
seeded with the first value; RMA(n) = ewm(alpha=1/n, adjust=True, min_periods=n). Columns are
NULL until defined; zero denominators give NULL (nullif) instead of an epsilon.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kandle.functions.scan import ema_sma_seed_spec, ewm_spec, rma_specs, rma_value, scan
from kandle.operators.fold import fold_chunks
from kandle.operators.layout import KEYS, PART_ROWS, canonical_window, drop_halo, layout, many_parts

# Fixed values that must equal the reference's indicator parameters.
ATR_LEN, RSI_LEN, VOL_SMA_LEN = 14, 14, 20
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BB_LEN, BB_STD = 20, 2.0
EMA_LENS = (9, 21, 100, 200)
CCI_LEN, CCI_C = 20, 0.015
MFI_LEN = 14
STOCH_LEN, STOCH_K, STOCH_D = 14, 3, 3
ADX_LEN = 14
ROC_LEN = 5
TEMA_LENS = (9, 21)
DEMA_FAST, DEMA_SLOW, SMART_SIGNAL_SPAN = 8, 21, 5
SUPERTREND_LEN, SUPERTREND_MULT = 10, 3.0
TREND_SPAN, SMART_TREND_SPAN = 50, 200
SMART_RSI_SPAN = 14
SMART_TREND_SMOOTH, SMART_TREND_THRESH = 10, 0.3
ATR_FILTER_LEN, VOLUME_PEAK_LEN = 50, 10
EPS_DEN = 1e-9


def _c(n):
    return F.col(n)


def _full(w, n, col):
    """Value only where the n-row frame ending here holds n non-null inputs (pandas rolling(n))."""
    return F.count(col).over(w.rowsBetween(-(n - 1), 0)) >= n


def _roll(w, n):
    return w.rowsBetween(-(n - 1), 0)


def _nz(x: Column) -> Column:
    return F.when(x != 0, x)


def with_indicators(lay: DataFrame, keys=KEYS) -> DataFrame:
    """Add every indicator and signal-input column to a laid-out bar table (halo rows kept).

    Built in dependency layers of SQL expressions (one ``selectExpr`` each), so Spark groups the
    window expressions of a layer into one Window operator per window spec and the driver builds
    the plan with a handful of JVM calls."""
    kk = ", ".join(f"`{k}`" for k in keys)
    W = f"PARTITION BY {kk}, part ORDER BY b_hi, b_lo, rn"

    def roll(n, lo=None, hi=0):
        lo = n - 1 if lo is None else lo
        end = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
        return f"({W} ROWS BETWEEN {lo} PRECEDING AND {end})"

    def full(n, x):
        return f"count({x}) OVER {roll(n)} >= {n}"

    def sel(df, exprs: dict) -> DataFrame:
        return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in exprs.items()])

    ema_ns = sorted({*EMA_LENS, MACD_FAST, MACD_SLOW, DEMA_FAST})
    tema_ns = sorted({*TEMA_LENS, DEMA_FAST, DEMA_SLOW})
    pk = f"{roll(VOLUME_PEAK_LEN, VOLUME_PEAK_LEN, 1)}"
    l1 = {"_pc": f"lag(close) OVER ({W})", "_ph": f"lag(high) OVER ({W})", "_pl": f"lag(low) OVER ({W})",
          "_po": f"lag(open) OVER ({W})", "_c5": f"lag(close, {ROC_LEN}) OVER ({W})",
          "Volume_SMA_20": f"avg(volume) OVER {roll(VOL_SMA_LEN)}",
          "_vsma": f"CASE WHEN {full(VOL_SMA_LEN, 'volume')} THEN avg(volume) OVER {roll(VOL_SMA_LEN)} END",
          "_bbok": full(BB_LEN, "close"),
          "_bbm": f"avg(close) OVER {roll(BB_LEN)}",
          "_bbsd": f"stddev_pop(close) OVER {roll(BB_LEN)}",
          "_vpeak": f"CASE WHEN count(volume) OVER {pk} >= {VOLUME_PEAK_LEN} THEN max(volume) OVER {pk} END"}
    for n in ema_ns:
        l1[f"_seed{n}"] = f"avg(close) OVER {roll(n)}"
    df = sel(lay, l1)
    d = "(close - _pc)"
    df = sel(df, {
        "_tr": "CASE WHEN rn >= 1 THEN greatest(high - low, abs(high - _pc), abs(_pc - low)) END",
        "_d": f"CASE WHEN rn >= 1 THEN {d} END",
        "_gain": f"CASE WHEN rn >= 1 THEN (CASE WHEN {d} > 0 THEN {d} ELSE 0D END) END",
        "_loss": f"CASE WHEN rn >= 1 THEN (CASE WHEN {d} < 0 THEN -{d} ELSE 0D END) END",
        "_pdm": "CASE WHEN rn >= 1 THEN (CASE WHEN (high - _ph) > (_pl - low) AND (high - _ph) > 0 THEN high - _ph ELSE 0D END) END",
        "_ndm": "CASE WHEN rn >= 1 THEN (CASE WHEN (_pl - low) > (high - _ph) AND (_pl - low) > 0 THEN _pl - low ELSE 0D END) END",
        "_srg": f"coalesce(CASE WHEN {d} > 0 THEN {d} END, 0D) * volume",
        "_srl": f"-coalesce(CASE WHEN {d} < 0 THEN {d} END, 0D) * volume",
        "_tp": "(high + low + close) / 3.0D",
        "BBM": "CASE WHEN _bbok THEN _bbm END",
        "ROC": "100.0D * (close - _c5) / nullif(_c5, 0)",
        "volume_above_avg": "CAST(coalesce(volume > Volume_SMA_20, false) AS INT)",
        "volume_peak": "CAST(coalesce(volume > _vpeak, false) AS INT)"})
    # layer 2: scan level A + framed windows on bar columns
    have_atr10 = "_atr10" in lay.columns
    specs = []
    specs += rma_specs("ATR", "_tr", ATR_LEN, 1)
    if not have_atr10:
        specs += rma_specs("_atr10", "_tr", SUPERTREND_LEN, 1)
    specs += rma_specs("_rsi_up", "_gain", RSI_LEN, 1)
    specs += rma_specs("_rsi_dn", "_loss", RSI_LEN, 1)
    specs += rma_specs("_pdm_s", "_pdm", ADX_LEN, 1)
    specs += rma_specs("_ndm_s", "_ndm", ADX_LEN, 1)
    for n in ema_ns:
        specs += ema_sma_seed_spec(f"_ema{n}", "close", f"_seed{n}", n)
    specs += ewm_spec("_ewm50", "close", TREND_SPAN)
    specs += ewm_spec("EMA_TREND", "close", SMART_TREND_SPAN)
    specs += ewm_spec("_sr_g", "_srg", SMART_RSI_SPAN)
    specs += ewm_spec("_sr_l", "_srl", SMART_RSI_SPAN)
    df = sel(df, {"BBL": f"BBM - {BB_STD}D * _bbsd", "BBU": f"BBM + {BB_STD}D * _bbsd",
                  "_tpl": f"CASE WHEN {full(CCI_LEN, '_tp')} THEN collect_list(_tp) OVER {roll(CCI_LEN)} END",
                  "_tpd": f"_tp - lag(_tp) OVER ({W})"})
    df = scan(df, specs, keys)
    rmas = [("ATR", ATR_LEN), ("_rsi_up", RSI_LEN), ("_rsi_dn", RSI_LEN), ("_pdm_s", ADX_LEN), ("_ndm_s", ADX_LEN)]
    if not have_atr10:
        rmas.append(("_atr10", SUPERTREND_LEN))
    df = sel(df, {name: rma_value(name, n, 1) for name, n in rmas})
    df = df.drop(*[f"_{x}_{y}" for x, _ in rmas for y in ("num", "den")])
    df = sel(df, {
        **{f"EMA_{n}": f"_ema{n}" for n in EMA_LENS},
        "RSI": "100.0D * _rsi_up / nullif(_rsi_up + _rsi_dn, 0)",
        "MACD": f"_ema{MACD_FAST} - _ema{MACD_SLOW}",
        "_dmp": "100.0D * _pdm_s / nullif(ATR, 0)",
        "_dmn": "100.0D * _ndm_s / nullif(ATR, 0)",
        "BBB": "100.0D * (BBU - BBL) / nullif(BBM, 0)",
        "BBP": "(close - BBL) / nullif(BBU - BBL, 0)",
        "_tpm": f"aggregate(_tpl, 0D, (a, x) -> a + x) / {CCI_LEN}",
        "_pmf": "CASE WHEN _tpd > 0 THEN _tp * volume ELSE 0D END",
        "_nmf": "CASE WHEN _tpd < 0 THEN _tp * volume ELSE 0D END",
        "_rs": f"_sr_g / (_sr_l + {EPS_DEN!r}D)"})
    df = sel(df, {
        "_dx": "100.0D * abs(_dmp - _dmn) / nullif(_dmp + _dmn, 0)",
        "_mad": f"aggregate(_tpl, 0D, (a, x) -> a + abs(x - _tpm)) / {CCI_LEN}",
        "bbp_filter": "CAST(coalesce(BBP > 0.5D, false) AS INT)"})
    # layer 3: seeds of level B + windows over level-A outputs
    l3 = {"_seed_sig": f"avg(MACD) OVER {roll(MACD_SIGNAL)}",
          "_mok": full(MFI_LEN, "_pmf"),
          "_ps": f"sum(_pmf) OVER {roll(MFI_LEN)}",
          "_ns": f"sum(_nmf) OVER {roll(MFI_LEN)}",
          "_rmin": f"CASE WHEN {full(STOCH_LEN, 'RSI')} THEN min(RSI) OVER {roll(STOCH_LEN)} END",
          "_rmax": f"CASE WHEN {full(STOCH_LEN, 'RSI')} THEN max(RSI) OVER {roll(STOCH_LEN)} END",
          "_tslope": f"_ewm50 - lag(_ewm50) OVER ({W})",
          "_eslope": f"EMA_TREND - lag(EMA_TREND) OVER ({W})",
          "_atrm": f"CASE WHEN {full(ATR_FILTER_LEN, 'ATR')} THEN avg(ATR) OVER {roll(ATR_FILTER_LEN)} END",
          "CCI": f"(_tp - _tpm) / nullif({CCI_C}D * _mad, 0)"}
    for n in tema_ns:
        l3[f"_seed2_{n}"] = f"avg(_ema{n}) OVER {roll(n)}"
    df = sel(df, l3)
    df = sel(df, {
        "MFI": "CASE WHEN _mok THEN 100.0D * _ps / nullif(_ps + _ns, 0) END",
        "_stoch": "100.0D * (RSI - _rmin) / nullif(_rmax - _rmin, 0)",
        "SMART_RSI": "least(greatest(100.0D - 100.0D / (1.0D + _rs) + CASE WHEN _tslope > 0 THEN 2.0D "
                     "WHEN _tslope < 0 THEN -2.0D ELSE 0.0D END, 0.0D), 100.0D)",
        "_trend_d": "_tslope",
        "_vw": f"_eslope / (ATR + {EPS_DEN!r}D) * (volume / greatest(_vsma, 1.0D))",
        "atr_filter": "CAST(coalesce(ATR > _atrm, false) AS INT)"})
    macd_start = MACD_SLOW - 1
    specs = ema_sma_seed_spec("Signal", "MACD", "_seed_sig", MACD_SIGNAL, macd_start)
    for n in tema_ns:
        specs += ema_sma_seed_spec(f"_e2_{n}", f"_ema{n}", f"_seed2_{n}", n)
    specs += rma_specs("ADX", "_dx", ADX_LEN, ATR_LEN)
    df = sel(df, {
        "StochRSI_K": f"CASE WHEN {full(STOCH_K, '_stoch')} THEN avg(_stoch) OVER {roll(STOCH_K)} END",
        "_smooth": f"CASE WHEN {full(SMART_TREND_SMOOTH, '_vw')} THEN avg(_vw) OVER {roll(SMART_TREND_SMOOTH)} END"})
    df = scan(df, specs, keys)
    df = sel(df, {
        "ADX": rma_value("ADX", ADX_LEN, ATR_LEN),
        "Histogram": "MACD - Signal",
        "SMART_MACD": f"(2.0D * _ema{DEMA_FAST} - _e2_{DEMA_FAST}) - (2.0D * _ema{DEMA_SLOW} - _e2_{DEMA_SLOW})",
        "smart_trend": f"coalesce(CAST(_smooth > {SMART_TREND_THRESH}D AS INT), 0) "
                       f"- coalesce(CAST(_smooth < -{SMART_TREND_THRESH}D AS INT), 0)"})
    # layer 4: level C
    l4 = {f"_seed3_{n}": f"avg(_e2_{n}) OVER {roll(n)}" for n in TEMA_LENS}
    l4["StochRSI_D"] = f"CASE WHEN {full(STOCH_D, 'StochRSI_K')} THEN avg(StochRSI_K) OVER {roll(STOCH_D)} END"
    df = sel(df, l4)
    specs = []
    for n in TEMA_LENS:
        specs += ema_sma_seed_spec(f"_e3_{n}", f"_e2_{n}", f"_seed3_{n}", n)
    specs += ewm_spec("SMART_SIGNAL", "SMART_MACD", SMART_SIGNAL_SPAN, DEMA_SLOW - 1)
    df = scan(df, specs, keys)
    df = sel(df, {
        **{f"TEMA_{n}": f"3.0D * (_ema{n} - _e2_{n}) + _e3_{n}" for n in TEMA_LENS},
        "SMART_HIST": f"(SMART_MACD - SMART_SIGNAL) / (ATR + {EPS_DEN!r}D)",
        "_psm": f"lag(SMART_MACD) OVER ({W})",
        "_pss": f"lag(SMART_SIGNAL) OVER ({W})"})
    return df


# ---- supertrend (W14): per-group fold ---------------------------------------------------------

def _step(state, c, hi, lo):
    """One bar of the ratchet: (top, bottom, rising) before it and the bar's own bands -> the state after it. While the trend holds,
    the band on its side only tightens; a close beyond either band of the bar before sets the direction and frees both bands."""
    top, bottom, rising = state
    if c > top or c < bottom:
        return hi, lo, bool(c > top)
    if rising:
        return hi, bottom if bottom > lo else lo, True
    return top if top < hi else hi, lo, False


def _ratchet(close, upper, lower, state=None):
    """Trend line and direction, from the state before the first row or, without one, from the first row on."""
    n = len(close)
    line, way = np.full(n, np.nan), np.ones(n, dtype=np.int32)
    start = 0
    if state is None and n:
        state, start = (upper[0], lower[0], True), 1
    for t in range(start, n):
        state = _step(state, close[t], upper[t], lower[t])
        line[t], way[t] = (state[1], 1) if state[2] else (state[0], -1)
    return line, way, state


INF = float("inf")


def _state_map(close, upper, lower, top0, bottom0):
    """What a run of bars makes of every state it may start from, exactly.

    The band against the trend is always the last bar's own (top0 / bottom0 at the start), so a start state is its direction and
    the level x of the band on its side. Levels are followed as ranges: a range whose bars neither break nor overtake it hands its
    levels on as they are; a range that is broken or overtaken becomes one state, and from then on that state is stepped. Equal
    states are merged, so a few are left. Returns pieces (rising before, from, to, top, bottom, rising after, identity); ranges of
    rising starts are (from, to], of falling ones [from, to)."""
    up, down, lanes = (-INF, INF), (-INF, INF), {}
    for c, hi, lo in zip(close, upper, lower):
        new: dict = {}

        def into(state, piece):
            key = tuple(None if v != v else v for v in state)  # NaN is equal to itself here
            new.setdefault(key, (state, []))[1].extend(piece if isinstance(piece, list) else [piece])

        for state, held in lanes.values():
            into(_step(state, c, hi, lo), held)
        if up:
            a, b = up
            if c > top0:
                into((hi, lo, True), (True, a, b))
                up = None
            else:
                if b > c:  # the close is below these levels
                    into((hi, lo, False), (True, max(a, c), b))
                    b = c
                if a < b and not lo <= a:  # levels that the bar's own band overtakes
                    cut = min(b, lo) if lo == lo else b
                    into((hi, lo, True), (True, a, cut))
                    a = cut
                up = (a, b) if a < b else None
        if down:
            a, b = down
            if a < c:  # the close is above these levels
                into((hi, lo, True), (False, a, min(b, c)))
                a = min(b, c)
            if a < b and c < bottom0:
                into((hi, lo, False), (False, a, b))
                a = b
            elif a < b and not hi >= b:
                cut = max(a, hi) if hi == hi else a
                into((hi, lo, False), (False, cut, b))
                b = cut
            down = (a, b) if a < b else None
        lanes, top0, bottom0 = new, hi, lo
    out = [(*piece, *state, False) for state, held in lanes.values() for piece in held]
    if up:
        out.append((True, *up, top0, bottom0, True, True))
    if down:
        out.append((False, *down, top0, bottom0, False, True))
    return out


def _apply(pieces, state):
    """The state after a run of bars whose map is ``pieces``."""
    top, bottom, rising = state
    x = bottom if rising else top
    if x != x:
        x = -INF if rising else INF  # a missing band is never broken and always overtaken
    for before, a, b, t, bt, after, same in pieces:
        inside = a < x <= b or (x == -INF == a) if rising else a <= x < b or (x == INF == b)
        if before == rising and inside:
            if same:
                return (t, x, True) if rising else (x, bt, False)
            return t, bt, after
    raise ValueError("no piece for a state")


def _bars(pdf: pd.DataFrame):
    mid = ((pdf["high"] + pdf["low"]) / 2.0).to_numpy(dtype="float64")
    width = (SUPERTREND_MULT * pdf["_atr10"].astype("float64")).to_numpy()
    return pdf["close"].to_numpy(dtype="float64"), mid + width, mid - width


_MAP = "rising array<boolean>, lo array<double>, hi array<double>, top array<double>, bottom array<double>, after array<boolean>, same array<boolean>"


def _part_states(df: DataFrame, keys) -> DataFrame:
    """(keys, part, _top, _bottom, _rising): the ratchet's state at the begin of every part but a series' first. Each part but the last
    is mapped on its own (``_state_map``), and the maps, a few numbers each, are applied along a series."""
    parts = df.where(~F.col("is_halo")).groupBy(*keys, "part").agg(F.min("rn").alias("_first"))
    last = Window.partitionBy(*keys).orderBy("part")
    parts = parts.withColumns({"_next": F.lead("part").over(last), "_at": F.row_number().over(last)})
    rows = df.join(parts.where("_next IS NOT NULL"), [*keys, "part"]).where("rn >= _first - 1")
    fields = [df.schema[k] for k in keys]
    names = [c.split()[0] for c in _MAP.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        close, upper, lower = _bars(pdf)
        if pdf["rn"].iloc[0] == 0:  # a series' first bar
            state = _ratchet(close, upper, lower)[2]
            pieces = [(r, -INF, INF, *state, False) for r in (True, False)]
        else:
            pieces = _state_map(close[1:], upper[1:], lower[1:], upper[0], lower[0])
        one = pdf.iloc[:1][[*keys, "part", "_next"]].copy()
        for name, values in zip(names, zip(*pieces)):
            one[name] = [list(values)]
        return one

    maps = fold_chunks(rows, [*keys, "part"], "rn", run, T.StructType([*fields, T.StructField("part", T.LongType()), T.StructField("_next", T.LongType()),
                                                                       *T.StructType.fromDDL(_MAP).fields]))

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = (0.0, 0.0, True), []
        for r in pdf.itertuples(index=False):
            state = _apply(list(zip(*(getattr(r, n) for n in names))), state)
            out.append((r[-len(names) - 1], *state))
        res = pd.DataFrame(out, columns=["part", "_top", "_bottom", "_rising"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "part", "_top", "_bottom", "_rising"]]

    # a few numbers for each part of a series
    return fold_chunks(maps, list(keys), "part", along, T.StructType([*fields, *T.StructType.fromDDL("part long, _top double, _bottom double, _rising boolean").fields]))


def with_supertrend(df: DataFrame, keys=KEYS, many: bool = True) -> DataFrame:
    """SUPERTREND (10, 3.0) per (series, part). A part starts from the exact state at its begin, which comes along as a row; where no
    series has a second part (``many`` is false) there is none to find, and the plan holds the bars once."""
    schema = T.StructType(df.schema.fields + [T.StructField("SUPERTREND", T.DoubleType()),
                                              T.StructField("SUPERTd", T.IntegerType())])
    if not many:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            line, way, _ = _ratchet(*_bars(pdf))
            return pdf.assign(SUPERTREND=line, SUPERTd=way)

        return fold_chunks(df, [*keys, "part"], "rn", whole, schema)
    state = ["_top", "_bottom", "_rising"]
    kinds = dict(zip(state, ("double", "double", "boolean")))
    begins = _part_states(df, keys)
    filled = {c: F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns if c not in (*keys, "part")}
    filled["is_halo"], filled["rn"] = F.lit(True).alias("is_halo"), F.lit(-1).cast("long").alias("rn")
    rows = df.withColumns({c: F.lit(None).cast(kinds[c]) for c in state}).unionByName(
        begins.select(*keys, "part", *state, *filled.values()).repartition(keys[0], "part"))
    columns = df.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = None
        if pdf["rn"].iloc[0] < 0:
            begin = tuple(pdf[c].iloc[0] for c in state)
            pdf = pdf.iloc[1:].reset_index(drop=True)
        pdf = pdf[columns]
        own = 0 if begin is None else int(pdf["is_halo"].astype(bool).sum())  # halo rows stand in front
        close, upper, lower = _bars(pdf)
        line, way = np.full(len(pdf), np.nan), np.ones(len(pdf), np.int32)
        line[own:], way[own:], _ = _ratchet(close[own:], upper[own:], lower[own:], begin)
        return pdf.assign(SUPERTREND=line, SUPERTd=way)

    return fold_chunks(rows, [*keys, "part"], "rn", fold, schema)


INDICATOR_COLS = ["ATR", "RSI", "Volume_SMA_20", "MACD", "Signal", "Histogram", "BBL", "BBM", "BBU", "BBB", "BBP",
                  "EMA_9", "EMA_21", "EMA_100", "EMA_200", "CCI", "MFI", "StochRSI_K", "StochRSI_D", "ADX", "ROC",
                  "TEMA_9", "TEMA_21"]
EXTRA_COLS = ["SUPERTREND", "SMART_MACD", "SMART_SIGNAL", "SMART_HIST", "SMART_RSI", "EMA_TREND", "smart_trend",
              "volume_above_avg", "atr_filter", "volume_peak", "bbp_filter"]


def with_atr10(lay: DataFrame, keys=KEYS) -> DataFrame:
    """The supertrend's ATR(10), by a scan of the laid-out bars."""
    w = canonical_window(keys)
    df = lay.withColumn("_pc", F.lag("close").over(w)).withColumn(
        "_tr", F.expr("CASE WHEN rn >= 1 THEN greatest(high - low, abs(high - _pc), abs(_pc - low)) END"))
    df = scan(df, rma_specs("_atr10", "_tr", SUPERTREND_LEN, 1), keys)
    return df.withColumn("_atr10", F.expr(rma_value("_atr10", SUPERTREND_LEN, 1))) \
             .drop("_pc", "_tr", "__atr10_num", "__atr10_den")


def with_supertrend_narrow(lay: DataFrame, keys=KEYS, many: bool = True) -> DataFrame:
    """ATR(10) scan + the supertrend fold on the bare bar columns (narrow Arrow batches); the
    wide indicator pipeline then runs on its output (same partitioning, one extra local sort)."""
    return with_supertrend(with_atr10(lay, keys), keys, many)


def indicator_table(bars: DataFrame, keys=KEYS, part_rows=None, halo=None, supertrend=True, extra=None) -> DataFrame:
    """bars -> bars + all indicator columns, halo removed (keeps helper '_' columns for signals)."""
    kw = {}
    if part_rows:
        kw["part_rows"] = part_rows
    if halo:
        kw["halo"] = halo
    lay = layout(bars, keys, **kw)
    if supertrend:
        lay = with_supertrend_narrow(lay, keys, many_parts(bars, keys, part_rows or PART_ROWS))
    df = with_indicators(lay, keys)
    if extra is not None:  # more lags / frames over the same layout, before the halo goes
        df = extra(df, canonical_window(keys))
    return drop_halo(df)


def smart_rsi_mean(df: DataFrame, w, period: int = SMART_RSI_SPAN) -> DataFrame:
    """W20 with plain means: ``SMART_RSI_MEAN`` from the means of the last ``period`` gains and losses (NULL before) instead of
    smoothed ones. For ``indicator_table(extra=...)``: the laid-out frame and its window."""
    frame = w.rowsBetween(-(period - 1), 0)
    up, down = F.avg("_srg").over(frame), F.avg("_srl").over(frame)
    slope = F.when(F.col("_tslope") > 0, 2.0).when(F.col("_tslope") < 0, -2.0).otherwise(0.0)
    rsi = 100.0 - 100.0 / (1.0 + up / (down + EPS_DEN))
    return df.withColumn("SMART_RSI_MEAN", F.when(F.count("_srg").over(frame) >= period, F.least(F.greatest(rsi + slope, F.lit(0.0)), F.lit(100.0))))
