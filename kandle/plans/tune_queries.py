"""Registered tuning queries (G02, G03, G05 + P12, W31) with DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from kandle.operators import tuning as TU
from kandle.operators.replay import DEFAULTS
from kandle.plans.common import BARS_SQL, events_bars, rounded_sig as rounded, sig_round_sql
from kandle.plans.more import loop_sql
from kandle.plans.oracle_ind import param_scored_sql
from kandle.plans.queries import query
from kandle.sources.tables import table

N_TRIALS = 100
SEED = 42

_SPLIT = f"""{BARS_SQL},
b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY ts) - 1 AS r0,
             count(*) OVER (PARTITION BY symbol, "interval") AS n0 FROM bars),
b1 AS (SELECT *, CASE WHEN r0 < n0 - 2*floor(n0*0.1) THEN 'train' WHEN r0 < n0 - floor(n0*0.1) THEN 'val' END AS split,
              n0 - 2*floor(n0*0.1) AS ntrain FROM b0)"""

_SERIES_SPLIT = _SPLIT + """,
series AS (SELECT symbol || '#' || split AS symbol, "interval", ts, ts_ms, open, high, low, close, volume,
  CAST(CASE WHEN split = 'train' THEN r0 ELSE r0 - ntrain END AS BIGINT) AS rn FROM b1 WHERE split IS NOT NULL)"""

# the draw, written apart from the engine's: parameter k of trial id from md5('id:k:42')
_W = ["ema_cross", "trend", "rsi", "macd", "stochrsi", "cci", "mfi", "volume", "roc", "volspike", "donchian", "tema_cross"]


def _u(k: int) -> str:
    return f"(CAST('0x' || substr(md5(range || ':{k}:42'), 1, 8) AS BIGINT) / 4294967296.0)"


_PARAMS_SQL = ("SELECT range AS id, range AS param_id, "
               + ", ".join(f"CAST(round(3 * {_u(k)}) AS DOUBLE) AS w_{w}" for k, w in enumerate(_W))
               + f""", CAST(round(2 + 2 * {_u(12)}) AS DOUBLE) AS long_score_threshold,
  CAST(round(2 + 2 * {_u(13)}) AS DOUBLE) AS short_score_threshold,
  0.01 + {_u(14)} * 0.49 AS tp_pct, 0.005 + {_u(15)} * 0.495 AS sl_pct, 0.01 + {_u(16)} * 0.19 AS risk_pct,
  false AS use_dynamic_tp_sl, {_u(18)} < 0.5 AS use_atr_filter, {_u(19)} < 0.5 AS use_smart_trend_filter FROM range(0, 100)""")

#: a trial for each user of the events, for the queries on the trial table itself
_USER_PARAMS_SQL = _PARAMS_SQL.replace("FROM range(0, 100)", "FROM (SELECT DISTINCT user_id AS range FROM events)")

_SIG = """SELECT symbol, "interval", param_id, rn, open, high, low, close, long_entry AS le, short_entry AS se,
    max(rn) OVER (PARTITION BY symbol, "interval", param_id) AS last_rn FROM scored"""

_HEAD = "split_part(symbol, '#', 1) AS symbol, \"interval\", split_part(symbol, '#', 2) AS split, param_id"

G02_SQL = loop_sql(param_scored_sql(_SERIES_SPLIT, _PARAMS_SQL), _SIG, DEFAULTS, by_param=True, head=_HEAD)


def _scores(spark, sf_dir):
    bars = events_bars(spark, sf_dir)
    params = TU.param_table(spark, N_TRIALS, SEED)
    return TU.score_params(bars, params, compat=True), params


@query("w31_split", "WITH " + _SPLIT + """ SELECT symbol, "interval", ts, split,
  CAST(CASE WHEN split = 'train' THEN r0 ELSE r0 - ntrain END AS BIGINT) AS srn FROM b1 WHERE split IS NOT NULL""")
def w31_split(spark, sf_dir):
    return TU.with_split(events_bars(spark, sf_dir)).select("symbol", "interval", "ts", "split", "srn")


def user_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()


@query("g01_param_table", f"""SELECT param_id, {", ".join(f"w_{w}" for w in _W)}, long_score_threshold, short_score_threshold,
  round(tp_pct, 6) AS tp_pct, round(sl_pct, 6) AS sl_pct, round(risk_pct, 6) AS risk_pct, use_dynamic_tp_sl, use_atr_filter,
  use_smart_trend_filter FROM ({_USER_PARAMS_SQL})""")
def g01_param_table(spark, sf_dir):
    """A trial for each user."""
    return rounded(TU.param_rows(user_ids(spark, sf_dir), SEED))


@query("g02_param_scores", G02_SQL)
def g02_param_scores(spark, sf_dir):
    s, _ = _scores(spark, sf_dir)
    return rounded(s)


_LOSS_SQL = f"""{G02_SQL.rsplit("SELECT " + _HEAD, 1)[0]}
SELECT {_HEAD}, CAST(total_trades AS BIGINT) AS total_trades,
  CASE WHEN total_trades > 0 THEN w / total_trades ELSE 0 END AS winrate,
  CASE WHEN total_trades > 0 THEN ps ELSE final_balance - 1000.0 END AS pnl,
  CAST(max_loss_streak AS BIGINT) AS max_loss_streak FROM tot"""


def _loss_sql(select: str) -> str:
    body = G02_SQL.rsplit("SELECT " + _HEAD, 1)[0]
    return body + f""", res AS (
SELECT {_HEAD}, CAST(total_trades AS DOUBLE) AS total_trades,
  CASE WHEN total_trades > 0 THEN w / total_trades ELSE 0 END AS winrate,
  CASE WHEN total_trades > 0 THEN ps ELSE final_balance - 1000.0 END AS pnl,
  max_loss_streak FROM tot),
j AS (SELECT t.symbol, t."interval", t.param_id, t.winrate AS train_wr, t.pnl AS train_pnl, v.winrate AS val_wr,
        v.pnl AS val_pnl, v.total_trades AS val_trades, v.max_loss_streak AS val_streak
      FROM res t JOIN res v ON t.symbol = v.symbol AND t."interval" = v."interval" AND t.param_id = v.param_id
      WHERE t.split = 'train' AND v.split = 'val'),
h AS (SELECT *, count(*) OVER w AS cnt,
        quantile_cont(val_wr, 0.5) OVER w AS med_wr, stddev_pop(val_wr) OVER w AS sd_wr,
        stddev_pop(val_pnl) OVER w AS sd_pnl, quantile_cont(val_trades, 0.5) OVER w AS med_tr,
        stddev_pop(val_trades) OVER w AS sd_tr
      FROM j WINDOW w AS (PARTITION BY symbol, "interval" ORDER BY param_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN cnt >= 20 THEN med_wr ELSE 0.55 END AS wr_target,
        CASE WHEN cnt >= 20 THEN sd_wr + 1e-6 ELSE 0.1 END AS wr_scale,
        CASE WHEN cnt >= 20 THEN sd_pnl + 1e-6 ELSE 100 END AS pnl_scale,
        CASE WHEN cnt >= 20 THEN med_tr ELSE 20 END AS trades_target,
        CASE WHEN cnt >= 20 THEN sd_tr + 1e-6 ELSE 5 END AS trades_scale FROM h),
l AS (SELECT *, (wr_target - val_wr)/wr_scale*2 + greatest(0, abs(trades_target - val_trades)/trades_scale)*2
        + (-val_pnl/pnl_scale)*1 + greatest(0, train_wr - val_wr)*10 + (0/(abs(val_pnl) + 1e-6))*2
        + greatest(0, train_pnl - val_pnl)/pnl_scale*2*2 + greatest(0, val_streak - 3)*1.5 AS loss FROM s)
{select}"""


@query("g03_loss", _loss_sql(f'SELECT symbol, "interval", param_id, {sig_round_sql("loss")} AS loss FROM l'))
def g03_loss(spark, sf_dir):
    s, _ = _scores(spark, sf_dir)
    return rounded(TU.loss_table(s).select("symbol", "interval", "param_id", "loss"))


@query("g05_best_params", _loss_sql(f"""SELECT symbol, "interval", arg_min(param_id, (loss, param_id)) AS param_id,
  {sig_round_sql("min(loss)")} AS best_loss FROM l GROUP BY symbol, "interval\""""))
def g05_best_params(spark, sf_dir):
    s, params = _scores(spark, sf_dir)
    b = TU.best_params(TU.loss_table(s), params)
    return rounded(b.select("symbol", "interval", "param_id", "best_loss"))
