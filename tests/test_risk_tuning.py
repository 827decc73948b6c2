import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kandle.functions.risk import inverse_balance_risk, position_size
from kandle.operators import tuning as TU


def test_position_size_cases(spark):
    cases = [(1000, 0.01, 10, 0.02, 100, 1000 * 0.01 * 10 / 0.02 / 100), (1000, 0.01, 10, 0.99, 100, 1000 * 0.01 * 10 / 0.99 / 100), (1000, 0.01, 10, 0.02, 0, 0.0), (1000, 0.01, 10, 0, 100, 0.0),
             (1000, 0, 10, 0.02, 100, 0.0), (1000, 0.01, 0, 0.02, 100, 0.0), (1000, 0.01, 10, -0.02, 100, 0.0)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "b double, r double, l double, s double, p double, want double")
    got = df.select(position_size("b", "r", "l", "s", "p").alias("g"), "want").collect()
    for g in got:
        assert g.g == pytest.approx(g.want)
    txt = spark.createDataFrame([("1000", "abc")], "b string, p string").select(
        position_size("b", F.lit(0.01), F.lit(10.0), F.lit(0.02), F.lit(100.0)).alias("g1"),
        position_size(F.lit(1000.0), F.lit(0.01), F.lit(10.0), F.lit(0.02), "p").alias("g2")).first()
    assert txt.g1 == 0.0 and txt.g2 == 0.0


def test_inverse_risk(spark):
    df = spark.createDataFrame([(1000.0, 0.05), (2000.0, 0.025), (0.0, 0.2), (100000.0, 0.01), (100.0, 0.2)], "c double, want double")
    for r in df.select(inverse_balance_risk("c", F.lit(1000.0)).alias("g"), "want").collect():
        assert r.g == pytest.approx(r.want)


def test_window_estimate(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 1.0, 0.0), (2, 0.0, 0.0, 3.0)],
                              "param_id long, w_rsi double, w_macd double, w_ema_cross double")
    got = {r.param_id: r.window_size for r in TU.window_estimate(p).collect()}
    assert got[0] == 300          # no weight
    assert got[1] == 300          # (14*2 + 26)/3*8 = 144 -> clipped to 300
    assert got[2] == 1750         # 200*8 + 150


def test_draws_are_independent(spark):
    """All 18 combinations of thresholds and trend flag occur (the rarest has a chance of 1 in 32 per trial); no two
    parameters move together."""
    p = TU.param_table(spark, 400).toPandas()
    assert len(p[["long_score_threshold", "short_score_threshold", "use_smart_trend_filter"]].drop_duplicates()) == 18
    corr = p[["tp_pct", "sl_pct", "risk_pct", "w_rsi", "w_macd", "w_trend"]].corr().abs().to_numpy()
    assert (corr[~np.eye(6, dtype=bool)] < 0.4).all()


def test_param_table_ranges(spark):
    p = TU.param_table(spark, 200, 7).toPandas()
    assert p.w_rsi.isin([0, 1, 2, 3]).all() and p.long_score_threshold.isin([2, 3, 4]).all()
    assert p.tp_pct.between(0.01, 0.5).all() and p.sl_pct.between(0.005, 0.5).all()
    assert p.risk_pct.between(0.01, 0.2).all() and (~p.use_dynamic_tp_sl).all()
    assert 0.3 < p.use_atr_filter.mean() < 0.7


def _scores(spark, rows):
    return spark.createDataFrame(rows, "symbol string, interval string, split string, param_id long, winrate double, "
                                       "pnl double, total_trades long, max_loss_streak long")


def test_loss_fallback_positive_and_reject(spark):
    rows = [("S", "30", "train", 0, 0.6, 50.0, 12, 1), ("S", "30", "val", 0, 0.5, 10.0, 8, 2)]
    l = TU.loss_table(_scores(spark, rows)).first()
    # fallback scales: norm_wr (0.55-0.5)/0.1 * 2, trades |20-8|/5 * 2, pnl -10/100 * 1, wr gap 0.1 * 10,
    # pnl gap (50-10)/100*2 = 0.8, weighted * 2
    want = 0.5 * 2 + 2.4 * 2 + (-0.1) * 1 + 0.1 * 10 + 0.8 * 2
    assert l.loss == pytest.approx(want) and l.loss > 0
    rej = TU.loss_table(_scores(spark, rows), reject=True).first()
    assert rej.loss == 999.0


def test_best_params_skips_999(spark):
    l = spark.createDataFrame([("S", "30", 0, 999.0), ("S", "30", 1, 3.0), ("S", "30", 2, 2.0), ("T", "30", 0, 999.0)],
                              "symbol string, interval string, param_id long, loss double")
    p = spark.createDataFrame([(0,), (1,), (2,)], "param_id long")
    got = {r.symbol: r.param_id for r in TU.best_params(l, p).collect()}
    assert got == {"S": 2, "T": None}


def test_tune_with_user_objective(spark):
    """a user objective (here: most validation trades) picks the best trial per series."""
    from conftest import SF
    from kandle.plans.common import events_bars
    bars = events_bars(spark, SF)
    params = TU.param_table(spark, 6, 3)

    def most_trades(scores):
        v = scores.where(F.col("split") == "val")
        return v.select("symbol", "interval", "param_id", (-F.col("total_trades").cast("double")).alias("loss"))

    best = TU.tune(bars, params, objective=most_trades).collect()
    assert len(best) == 5
    assert all(r.param_id is not None for r in best)
