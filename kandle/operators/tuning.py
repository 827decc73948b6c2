"""Parameter tuning as one Spark job.

The reference tunes one symbol at a time with a sequential TPE solver. Here a parameter *table*
(one row per trial, drawn from md5 so SQL can reproduce it) is scored on every series' train and
validation segments at once: indicators/flags once per segment (cold start per segment, as the
reference prepares each split alone), flags x distinct settings, replay keyed by (segment,
setting), then the loss with a running history in trial order and the best trial per series.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kandle.operators.replay import DEFAULTS, replay, summarize
from kandle.operators.signals import LONG_SIGNALS, SHORT_SIGNALS, with_param_scores
from kandle.operators.indicators import with_indicators, with_supertrend_narrow
from kandle.operators.layout import drop_halo, layout, many_parts, on_layout
from kandle.operators.signals import with_flags
from kandle.sources.scratch import materialize

# Fixed values that must equal the reference's search space (name, kind, low, high).
WEIGHT_NAMES = ["ema_cross", "trend", "rsi", "macd", "stochrsi", "cci", "mfi", "volume", "roc", "volspike",
                "donchian", "tema_cross"]
SPACE = ([(f"w_{n}", "q1", 0, 3) for n in WEIGHT_NAMES]
         + [("long_score_threshold", "q1", 2, 4), ("short_score_threshold", "q1", 2, 4),
            ("tp_pct", "u", 0.01, 0.50), ("sl_pct", "u", 0.005, 0.50), ("risk_pct", "u", 0.01, 0.20),
            ("use_dynamic_tp_sl", "choice_false", 0, 0), ("use_atr_filter", "choice2", 0, 0),
            ("use_smart_trend_filter", "choice2", 0, 0)])
# Loss weights and fallback scales of the reference objective.
LOSS_WEIGHTS = {"norm_wr": 2.0, "norm_trades": 2.0, "norm_pnl": 1.0, "norm_sharpe": 2.0, "wr_gap": 10.0,
                "norm_dd": 2.0, "pnl_gap": 2.0, "streak_penalty": 1.5, "sharpe_gap": 5.0}
HISTORY_MIN = 20
FALLBACK = {"wr_target": 0.55, "wr_scale": 0.1, "pnl_scale": 100.0, "trades_target": 20.0, "trades_scale": 5.0}
CONSTRAINTS = {"min_trades": 10, "min_winrate": 0.55}
# Indicator periods and heavy-indicator penalties of the window-size estimate.
INDICATOR_PERIODS = {"rsi": 14, "macd": 26, "mfi": 14, "cci": 20, "stochrsi": 14, "tema_cross": 21,
                     "ema_cross": 200, "trend": 50, "donchian": 20, "roc": 12, "volspike": 20, "volume": 20}
HEAVY_PENALTIES = {"w_ema_cross": (2.0, 150), "w_trend": (2.0, 100)}


def uniform_sql(k: int, seed: int) -> str:
    """u in [0, 1) for trial ``id`` and parameter index k: 32 bits of an md5, independent across k and id."""
    return f"(CAST(conv(substring(md5(concat(id, ':{k}:{seed}')), 1, 8), 16, 10) AS DOUBLE) / 4294967296)"


def param_exprs(seed: int) -> list[str]:
    out = []
    for k, (name, kind, lo, hi) in enumerate(SPACE):
        u = uniform_sql(k, seed)
        if kind == "q1":
            e = f"CAST(round({lo} + {u} * {hi - lo}) AS DOUBLE)"
        elif kind == "u":
            e = f"({lo!r}D + {u} * {hi - lo!r}D)"
        elif kind == "choice_false":
            e = "false"
        else:
            e = f"({u} < 0.5)"
        out.append(f"{e} AS {name}")
    return out


def param_rows(ids: DataFrame, seed: int = 42) -> DataFrame:
    """G01 for a table of trial numbers (``id``): each is drawn by itself, so any part of a trial table can be made anywhere."""
    return ids.select(F.col("id").cast("long").alias("id")).selectExpr("id AS param_id", *param_exprs(seed))


def param_table(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """N trials of the search space."""
    return param_rows(spark.range(n), seed)


def with_split(bars: DataFrame, keys=("symbol", "interval"), val_ratio=0.1, test_ratio=0.1) -> DataFrame:
    """train = first n - int(.1n) - int(.1n) rows, val = next int(.1n); the test slice is dropped.
    Adds split and srn (row number inside the segment)."""
    b = on_layout(bars, lambda d, w: d, list(keys)).withColumnRenamed("rn", "_rn").drop("part")
    n = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # one row per series
    b = b.join(n, list(keys))
    val = F.floor(F.col("_n") * val_ratio)
    test = F.floor(F.col("_n") * test_ratio)
    train = F.col("_n") - val - test
    b = b.withColumn("split", F.when(F.col("_rn") < train, "train").when(F.col("_rn") < train + val, "val"))
    b = b.where(F.col("split").isNotNull())
    b = b.withColumn("srn", F.when(F.col("split") == "train", F.col("_rn")).otherwise(F.col("_rn") - train))
    return b.drop("_rn", "_n")


def segment_signals(bars_split: DataFrame, seg: list[str]) -> DataFrame:
    """Indicators + flags computed per segment (cold start per split). The bars are written out first: they are looked at several
    times, and so is what they are made from."""
    bars = materialize(bars_split.drop("srn"), "segment-bars")
    lay = with_supertrend_narrow(layout(bars, seg), seg, many_parts(bars, seg))
    df = with_flags(with_indicators(lay, seg))
    keep = [F.col(x).alias("srn") if x == "rn" else F.col(x) for x in df.columns
            if not x.startswith("_") and x not in ("is_halo", "b_lo", "b_hi")]
    return df.where(~F.col("is_halo")).select(*keep)


def score_params(bars: DataFrame, params: DataFrame, compat: bool = True) -> DataFrame:
    """A01/A02 summary per (series, split, param_id).

    compat=True replays with the default tp/sl/risk as the reference does while tuning
    (tuned values are not passed there); compat=False uses each trial's own values. Trials that agree
    in every value that signals and replay look at are replayed once, under the least of their ids."""
    seg = ["symbol", "interval", "split"]
    used = [f"w_{s}" for s in dict.fromkeys([*LONG_SIGNALS, *SHORT_SIGNALS])]
    used += ["long_score_threshold", "short_score_threshold", "use_smart_trend_filter"]
    used += [] if compat else list(DEFAULTS)
    used = [c for c in used if c in params.columns]
    settings = materialize(params.groupBy(*used).agg(F.min("param_id").alias("param_id")), "settings")
    flags = [f"long_{s}" for s in LONG_SIGNALS] + [f"short_{s}" for s in SHORT_SIGNALS]
    sig = segment_signals(with_split(bars), seg)
    cols = dict.fromkeys([*seg, "srn", "open", "high", "low", "close", "smart_trend", *flags, "long_exit", "short_exit"])
    sig = materialize(sig.select(*[c for c in cols if c in sig.columns]), "segments")
    scored = with_param_scores(sig, settings)
    if compat:
        scored = scored.withColumns({k: F.lit(v) for k, v in DEFAULTS.items() if k in ("tp_pct", "sl_pct", "risk_pct")})
    trades = replay(sig, scored, seg, ["param_id"])
    series = sig.select(*seg).distinct().crossJoin(settings.select("param_id"))
    scores = summarize(trades, series, seg, ["param_id"]).withColumnRenamed("param_id", "_setting")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in used]
    of = params.alias("p").join(settings.alias("s"), same) if same else params.alias("p").crossJoin(settings.alias("s"))
    of = of.select(F.col("s.param_id").alias("_setting"), F.col("p.param_id"))
    return scores.join(of, "_setting").select(*seg, "param_id", *[c for c in scores.columns if c not in (*seg, "_setting")])


# Terms of the loss: weight x value, where a value is an expression over the joined train / val scores.
# The summary has no Sharpe ratio and no drawdown; their terms stand at the reference's defaults (0 gap, 0).
LOSS_TERMS = [
    ("norm_wr", "(wr_target - val_wr) / wr_scale"),
    ("norm_trades", "greatest(0D, abs(trades_target - val_trades) / trades_scale)"),
    ("norm_pnl", "-val_pnl / pnl_scale"),
    ("norm_sharpe", "0D"),
    ("wr_gap", "greatest(0D, train_wr - val_wr)"),
    ("norm_dd", "0D / (abs(val_pnl) + 1e-6)"),
    ("sharpe_gap", "0D"),
    ("pnl_gap", "2 * greatest(0D, train_pnl - val_pnl) / pnl_scale"),
    ("streak_penalty", "greatest(0D, val_streak - 3.0D)"),
]


def loss_table(scores: DataFrame, reject: bool = False) -> DataFrame:
    """Loss per (series, param_id); targets and scales come from the trials so far, in trial
    order, once there are ``HISTORY_MIN`` of them. One window holds one series' trials."""
    key = ["symbol", "interval", "param_id"]
    halves = scores.groupBy(*key).pivot("split", ["train", "val"]).agg(
        F.max("winrate").alias("wr"), F.max("pnl").alias("pnl"), F.max(F.col("total_trades").cast("double")).alias("trades"),
        F.max("max_loss_streak").alias("streak")).where("train_wr IS NOT NULL AND val_wr IS NOT NULL")
    so_far = Window.partitionBy("symbol", "interval").orderBy("param_id").rowsBetween(Window.unboundedPreceding, 0)

    def running(stat: Column, otherwise: float) -> Column:
        return F.when(F.count(F.lit(1)).over(so_far) >= HISTORY_MIN, stat).otherwise(otherwise)

    def spread(col: str) -> Column:
        return F.stddev_pop(col).over(so_far) + 1e-6

    df = halves.withColumns({
        "wr_target": running(F.percentile("val_wr", 0.5).over(so_far), FALLBACK["wr_target"]),
        "trades_target": running(F.percentile("val_trades", 0.5).over(so_far), FALLBACK["trades_target"]),
        "wr_scale": running(spread("val_wr"), FALLBACK["wr_scale"]),
        "pnl_scale": running(spread("val_pnl"), FALLBACK["pnl_scale"]),
        "trades_scale": running(spread("val_trades"), FALLBACK["trades_scale"])})
    loss = F.expr(" + ".join(f"{LOSS_WEIGHTS[name]!r}D * ({value})" for name, value in LOSS_TERMS))
    if reject:
        poor = (F.col("val_trades") < CONSTRAINTS["min_trades"]) | (F.col("val_wr") < CONSTRAINTS["min_winrate"])
        loss = F.when(poor, F.lit(999.0)).otherwise(loss)
    return df.withColumn("loss", loss)


def best_params(losses: DataFrame, params: DataFrame) -> DataFrame:
    """Least loss per series; 999 or non-finite -> no best (row kept with NULL param_id)."""
    ok = losses.where((F.col("loss") != 999.0) & ~F.isnan("loss") & (F.abs("loss") != float("inf")))
    b = ok.groupBy("symbol", "interval").agg(F.min_by(F.struct("loss", "param_id"), F.struct("loss", "param_id")).alias("b"))
    b = b.select("symbol", "interval", "b.param_id", F.col("b.loss").alias("best_loss"))
    allk = losses.select("symbol", "interval").distinct()
    return allk.join(b, ["symbol", "interval"], "left").join(params, "param_id", "left")


def window_estimate(params: DataFrame) -> DataFrame:
    """Training-window estimate from the weights: sum(period*w)/sum(w) over known w_* > 0, *8,
    plus heavy penalties, truncated and clipped to [300, 2000]; 300 when no weight."""
    wcols = [c for c in params.columns if c.startswith("w_")]
    kv = F.explode(F.map_from_arrays(F.array(*[F.lit(c[2:]) for c in wcols]),
                                     F.array(*[F.col(c).cast("double") for c in wcols])))
    per = F.create_map(*[x for n, p in INDICATOR_PERIODS.items() for x in (F.lit(n), F.lit(float(p)))])
    e = params.select("param_id", *wcols, kv.alias("name", "w")).where(F.col("w") > 0) \
              .withColumn("period", per[F.col("name")]).where(F.col("period").isNotNull())
    agg = e.groupBy("param_id").agg((F.sum(F.col("period") * F.col("w")) / F.sum("w")).alias("base"))
    pen = sum((F.when(F.coalesce(F.col(k), F.lit(0.0)) >= t, F.lit(float(p))).otherwise(0.0)
               for k, (t, p) in HEAVY_PENALTIES.items() if k in params.columns), F.lit(0.0))
    out = params.select("param_id", pen.alias("penalty")).join(agg, "param_id", "left")
    ws = F.when(F.col("base").isNull(), F.lit(300)).otherwise(
        F.least(F.greatest(F.floor(F.col("base") * 8.0 + F.col("penalty")), F.lit(300)), F.lit(2000)))
    return out.select("param_id", ws.cast("bigint").alias("window_size"))


def tune(bars: DataFrame, params: DataFrame, objective=None, compat: bool = True) -> DataFrame:
    """G01-G05 in one call, with a pluggable objective.

    ``objective(scores) -> DataFrame`` receives the per-(series, split, param_id) summaries and
    returns (symbol, interval, param_id, loss); the default is the reference's loss with running
    history (``loss_table``). Returns the best parameter row per series."""
    scores = score_params(bars, params, compat=compat)
    losses = (objective or loss_table)(scores)
    return best_params(losses.select("symbol", "interval", "param_id", "loss"), params)
