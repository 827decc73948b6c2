"""Registered report queries: W32, A07, A08, A09, B05-derived trade log."""
from __future__ import annotations

from pyspark.sql import functions as F

from kandle.functions.risk import marker, trade_side
from kandle.operators import reports as R
from kandle.operators import tuning as TU
from kandle.operators.indicators import indicator_table
from kandle.plans.common import BARS_SQL, events_bars, rounded
from kandle.plans.oracle_ind import indicator_sql
from kandle.plans.queries import query
from kandle.sources.tables import table

W32_COLS = ["long_macd", "short_macd", "long_rsi", "short_rsi", "long_roc", "short_roc", "short_mfi", "short_cci",
            "short_bb_rebound", "short_donchian", "short_tema_cross", "short_stochrsi", "ema200_down"]
_W = 'PARTITION BY symbol, "interval" ORDER BY ts'


@query("w32_earlier_signals", indicator_sql() + f""",
e0 AS (SELECT *, lag(MACD) OVER ({_W}) AS pm, lag(Signal) OVER ({_W}) AS ps,
  min(low) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS dlow,
  EMA_200 - lag(EMA_200) OVER ({_W}) AS e200d,
  100*(close - lag(close, 5) OVER ({_W}))/nullif(lag(close, 5) OVER ({_W}), 0) AS ROC,
  CASE WHEN count(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20
       THEN avg(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS BBM,
  (high + low + close)/3 AS tp FROM ind),
e1 AS (SELECT *, CASE WHEN tp - lag(tp) OVER ({_W}) > 0 THEN tp*volume ELSE 0 END AS pmf,
  CASE WHEN tp - lag(tp) OVER ({_W}) < 0 THEN tp*volume ELSE 0 END AS nmf,
  CASE WHEN count(tp) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20
       THEN avg(tp) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sma FROM e0),
e2 AS (SELECT *, CASE WHEN count(pmf) OVER w14 >= 14 THEN 100*sum(pmf) OVER w14/nullif(sum(pmf) OVER w14 + sum(nmf) OVER w14, 0) END AS MFI
  FROM e1 WINDOW w14 AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
md AS (SELECT a.symbol, a."interval", a.rn, avg(abs(b.tp - a.sma)) AS mad FROM e2 a JOIN e2 b ON a.symbol = b.symbol
  AND a."interval" = b."interval" AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY ALL),
e AS (SELECT e2.*, (tp - sma)/nullif(0.015*md.mad, 0) AS CCI FROM e2 JOIN md USING (symbol, "interval", rn))
SELECT symbol, "interval", ts,
  CAST(coalesce(MACD > Signal AND pm <= ps AND MACD > 0, false) AS INT) AS long_macd,
  CAST(coalesce(MACD < Signal AND pm >= ps AND MACD < 0, false) AS INT) AS short_macd,
  CAST(coalesce(RSI > 45 AND RSI < 75, false) AS INT) AS long_rsi, CAST(coalesce(RSI < 35, false) AS INT) AS short_rsi,
  CAST(coalesce(ROC > 1, false) AS INT) AS long_roc, CAST(coalesce(ROC < -1, false) AS INT) AS short_roc,
  CAST(coalesce(MFI > 70, false) AS INT) AS short_mfi, CAST(coalesce(CCI > 100, false) AS INT) AS short_cci,
  CAST(coalesce(close > BBM, false) AS INT) AS short_bb_rebound, CAST(coalesce(close < dlow, false) AS INT) AS short_donchian,
  CAST(coalesce(TEMA_9 < TEMA_21, false) AS INT) AS short_tema_cross,
  CAST(coalesce(StochRSI_K > 80 AND StochRSI_D > 80, false) AS INT) AS short_stochrsi,
  CAST(coalesce(e200d < 0, false) AS INT) AS ema200_down FROM e""")
def w32_earlier_signals(spark, sf_dir):
    ind = indicator_table(events_bars(spark, sf_dir), supertrend=False, extra=R.earlier_signals)
    return ind.select("symbol", "interval", "ts", *W32_COLS)


_FEAT = """f AS (SELECT l.quality, l.toxic, d.lang, d.source,
  CAST(floor(log10(d.n_chars + 1) * 4) AS VARCHAR) AS n_chars_bin FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
long AS (SELECT 'lang' AS feature, lang AS x, quality AS y FROM f UNION ALL
         SELECT 'source', source, quality FROM f UNION ALL
         SELECT 'n_chars_bin', n_chars_bin, quality FROM f UNION ALL
         SELECT 'toxic', CAST(toxic AS VARCHAR), quality FROM f),
c AS (SELECT feature, x, y, count(*) AS c FROM long WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, x) AS cx,
  sum(c) OVER (PARTITION BY feature, y) AS cy FROM c),
mi AS (SELECT feature, sum(c/n * ln(c*n/(cx*cy))) AS importance FROM m GROUP BY feature)"""


@query("a07_feature_relevance", f"""WITH {_FEAT} SELECT feature, round(importance, 6) AS importance,
  row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM mi""")
def a07_feature_relevance(spark, sf_dir):
    """A07 + T03: mutual information of document features vs the quality label, ranked."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf_dir, "labels")
    f = l.join(d, "doc_id").withColumn("n_chars_bin", F.floor(F.log10(F.col("n_chars") + 1) * 4).cast("bigint").cast("string"))
    feats = ["lang", "source", "n_chars_bin", "toxic"]
    mi = R.mutual_information(f.select(*feats, "quality").dropna(subset=["quality"]), feats, "quality")
    return rounded(mi.withColumn("rank", F.col("rank").cast("bigint")))


@query("a08_fingerprint", f"""WITH {BARS_SQL} SELECT symbol, "interval", count(*) AS rows,
  sum(CAST(('0x' || substr(md5(concat_ws('|', symbol, "interval", CAST(ts_ms AS VARCHAR), printf('%.6f', open),
    printf('%.6f', high), printf('%.6f', low), printf('%.6f', close), printf('%.6f', volume))), 1, 8)) AS BIGINT)) AS hash_sum
  FROM bars GROUP BY ALL""")
def a08_fingerprint(spark, sf_dir):
    b = events_bars(spark, sf_dir)
    return R.fingerprint(b, ["symbol", "interval"], ["symbol", "interval", "ts_ms", "open", "high", "low", "close", "volume"])


# ---------------------------------------------------------------- A09 / P11: hash of the best params
from kandle.plans import tune_queries as TQ  # noqa: E402

_NAMES = [n for n, *_ in TU.SPACE]


def _json_sql(alias: str) -> str:
    parts = []
    for i, n in enumerate(sorted(_NAMES)):
        sep = "" if i == 0 else ", "
        parts.append(f"'{sep}\"{n}\": ' || CAST({alias}.{n} AS VARCHAR)")
    return "'{' || " + " || ".join(parts) + " || '}'"


_A09_SQL = TQ._loss_sql(f"""SELECT b.symbol, b."interval", b.param_id, {_json_sql('p')} AS params_json,
  md5({_json_sql('p')}) AS params_hash
FROM (SELECT symbol, "interval", arg_min(param_id, (loss, param_id)) AS param_id FROM l GROUP BY ALL) b
JOIN params p ON p.param_id = b.param_id""")


@query("a09_best_params_hash", _A09_SQL)
def a09_best_params_hash(spark, sf_dir):
    """A09 + P11: the best trial's parameters as key-sorted JSON and its md5, per series."""
    s, params = TQ._scores(spark, sf_dir)
    best = TU.best_params(TU.loss_table(s), params).select("symbol", "interval", "param_id")
    h = R.params_hash(params, _NAMES)
    return best.join(h, "param_id").select("symbol", "interval", "param_id", "params_json", "params_hash")


def _markers_sql():
    from kandle.plans.common import sig_round_sql as r
    from kandle.plans.more import LEGS_SQL
    body = LEGS_SQL[:LEGS_SQL.rindex("SELECT l.symbol")]
    return body + f"""SELECT l.symbol, l."interval", s.ts, l.action,
  CASE WHEN l.action LIKE '%LONG%' THEN 'long' WHEN l.action LIKE '%SHORT%' THEN 'short' END AS side,
  {r('l.price')} AS price, {r('l.pnl')} AS pnl,
  CASE WHEN l.action LIKE '%OPEN%' THEN (CASE WHEN l.action LIKE '%SHORT%' THEN 'triangle-down' ELSE 'triangle-up' END)
       WHEN l.action LIKE '%TP%' THEN 'star' WHEN l.action LIKE '%SL%' THEN 'x' WHEN l.action LIKE '%CLOSE%' THEN 'circle'
       ELSE 'diamond' END AS shape,
  CASE WHEN l.action LIKE '%OPEN%' THEN 'orange' WHEN l.action LIKE '%TP%' THEN 'lime' WHEN l.action LIKE '%SL%' THEN 'red'
       WHEN l.action LIKE '%CLOSE%' THEN 'white' ELSE 'blue' END AS colour
FROM legs l JOIN series s ON s.symbol = l.symbol AND s."interval" = l."interval" AND s.rn = l.rn"""


@query("p14_trade_markers", _markers_sql())
def p14_trade_markers(spark, sf_dir):
    """B05 trade log with P10 side and P14 chart markers."""
    from kandle.plans.more import VB_PARAMS, VB_TRADE, backtest
    from kandle.operators.replay import trade_legs
    sc, tr = backtest(spark, sf_dir, VB_PARAMS, VB_TRADE)
    legs = trade_legs(tr, ["symbol", "interval"]).join(sc.select("symbol", "interval", "srn", "ts"),
                                                      ["symbol", "interval", "srn"])
    m = marker("action")
    return rounded(legs.select("symbol", "interval", "ts", "action", trade_side("action").alias("side"), "price", "pnl",
                               m.shape.alias("shape"), m.colour.alias("colour")))
