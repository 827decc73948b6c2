"""Walk-forward with re-tuning on restart (G11): a wave loop over a frontier table.

A series walks its test windows with one parameter setting until a window triggers a restart (G10); then it
is tuned again on the rows known by then and walks on. How far a series gets on one setting differs, so all series
advance in *waves*. The frontier holds a row per series still walking: what it needs next (a first tuning, a
re-tuning, or windows to run), from which window, with which balance. A wave is one job for all of them:

1. tune: the training rows of every series that needs it, and of no other, go to the tuner at once. A first tuning asks
   for the next ``tune_ahead`` windows and for the wider spans together, as a window without a setting is skipped;
2. run: the windows from the frontier on, ``ahead`` of them at most, are replayed with the series' setting and
   evaluated in order up to the first restart or a ruin.

Rules of the reference, stated: a first tuning looks at all rows before its window; if no setting is found the training span
widens (``spans``: the first, the last and the step) to that many first rows of the series; at the last span the window is
skipped (no run row) and the span falls back to the first. A re-tuning looks at the rows before the window that
triggered it; if it finds nothing the next window asks for a first tuning again. A restart is final for the window that triggered it. A
ruin (balance below 500) ends the series, its window is not logged. Differences: after a skipped window the walk goes on
with the next one (the reference's loop does not leave its place), and training rows are always all rows before the window.

Each wave moves every series on (to a wider span or a later window), so the number of waves is bounded by the windows of the
longest series times the spans. Windows are replayed again only for the ``ahead`` look-ahead behind a restart.
"""
from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from kandle.operators import walkforward as WF
from kandle.operators.fold import fold_carried
from kandle.operators.replay import DEFAULTS, replay, summarize
from kandle.operators.signals import with_param_scores
from kandle.operators.tuning import best_params, loss_table, score_params
from kandle.sources.scratch import discard, materialize

KEYS = ["symbol", "interval"]
# Fixed values that must equal the reference's training spans (first, last, step).
SPANS = (1000, 1500, 500)

Tuner = Callable[[DataFrame], DataFrame]


def loss_tuner(params: DataFrame, reject: bool = True) -> Tuner:
    """G01-G05 on the training rows: the setting of least loss, none if all are rejected."""
    def tune(rows: DataFrame) -> DataFrame:
        # a request is a series of its own to the tuning job
        name = F.to_json(F.struct("symbol", "request"))
        bars = rows.select(name.alias("symbol"), "interval", "ts", "ts_ms", "open", "high", "low", "close", "volume")
        losses = loss_table(score_params(bars, params), reject=reject)
        best = best_params(losses, params).withColumn("_n", F.from_json("symbol", "symbol string, request long"))
        return best.select("_n.symbol", "interval", "_n.request", "param_id")

    return tune


def validation_tuner(params: DataFrame, trade: dict | None = None, min_trades: int = 1, min_winrate: float = 0.0, ratio: float = 0.1) -> Tuner:
    """The setting with the highest pnl on the validation rows (W31) among those with enough trades and wins there, the least id
    of equals. Flags are those of the whole series, as they are causal."""
    def tune(rows: DataFrame) -> DataFrame:
        seg = [*KEYS, "request"]
        n = rows.groupBy(*seg).agg((F.max("rn") + 1).alias("_n"))
        part = F.floor(F.col("_n") * ratio)
        val = rows.join(n, seg).withColumns({"_from": F.col("_n") - 2 * part, "_to": F.col("_n") - part}).where("rn >= _from AND rn < _to")
        val = materialize(val.withColumn("srn", F.col("rn") - F.col("_from")).drop("_n", "_from", "_to"), "tune-rows")
        scored = with_param_scores(val, params).withColumns({k: F.lit(v) for k, v in {**DEFAULTS, **(trade or {})}.items()})
        trades = replay(val, scored, seg, ["param_id"])
        series = val.select(*seg).distinct().crossJoin(params.select("param_id"))
        s = summarize(trades, series, seg, ["param_id"]).where((F.col("total_trades") >= min_trades) & (F.col("winrate") >= min_winrate))
        return s.groupBy(*seg).agg(F.min_by("param_id", F.struct(-F.col("pnl"), "param_id")).alias("param_id"))

    return tune


def _requests(need: DataFrame, at: DataFrame, spans: tuple, tune_ahead: int) -> DataFrame:
    """(symbol, interval, request, train_rows): what a wave's tuner is asked. Request i: the rows before the i-th window from the
    frontier on; request -j: the j-th wider span. A re-tuning asks for the rows before its window alone."""
    first, last, step = spans
    wider = list(range(first + step, last, step)) + ([last] if last > first else [])
    later = need.join(at, KEYS).where((F.col("at") >= F.col("window")) & (F.col("at") < F.col("window") + F.when(F.col("kind") == "init", tune_ahead).otherwise(1)))
    out = later.select(*KEYS, (F.col("at") - F.col("window")).alias("request"), F.col("_known").alias("train_rows"))
    if wider:
        j = F.explode(F.array(*[F.struct(F.lit(-i).cast("long").alias("request"), F.lit(w).cast("long").alias("w")) for i, w in enumerate(wider, 1)]))
        wide = need.where("kind = 'init'").select(*KEYS, "_rows", j.alias("j"))
        out = out.unionByName(wide.select(*KEYS, "j.request", F.least("j.w", "_rows").alias("train_rows")))
    return out


def _answers(found: DataFrame, spans: tuple, tune_ahead: int) -> DataFrame:
    """What a tuning leads to. ``found``: frontier rows with ``got``, the answered requests [(request, param_id)].

    The first window for which a setting is found, by its own rows or, where the span may still widen, by a wider span; after a
    skipped window the span is the first again, so the second window may widen whatever the first one did."""
    first, last, step = spans
    spans_of = [first] + list(range(first + step, last, step)) + ([last] if last > first else [])
    wide_of = lambda least: "filter(got, g -> g.request < 0 AND element_at(spans, cast(1 - g.request AS int)) > " + least + ")"
    x = found.withColumn("spans", F.array(*[F.lit(v).cast("long") for v in spans_of])).withColumns({
        "own": F.expr("get(filter(got, g -> g.request = 0), 0).param_id"),
        "wide0": F.expr(f"reverse(array_sort({wide_of('span')}))"), "wide1": F.expr(f"reverse(array_sort({wide_of(str(first))}))"),
        "later": F.expr("array_sort(filter(got, g -> g.request > 0))")})
    x = x.withColumns({"w0": F.get("wide0", F.lit(0)), "w1": F.get("wide1", F.lit(0)), "l0": F.get("later", F.lit(0))})
    span_at = lambda w: F.element_at("spans", (1 - F.col(f"{w}.request")).cast("int"))
    retune, by_own, by_wide = F.col("kind") == "retune", F.col("own").isNotNull(), F.col("w0").isNotNull()
    next_own = F.col("l0.request") == 1
    # a wider span serves the second window only if that window's own rows were asked for, too
    any_wide, any_later = F.col("w1").isNotNull() & F.lit(tune_ahead > 1), F.col("l0").isNotNull()
    # in this order
    cases = [(retune, F.col("window") + 1, F.col("span"), F.col("own")), (by_own, F.col("window"), F.col("span"), F.col("own")),
             (by_wide, F.col("window"), span_at("w0"), F.col("w0.param_id")), (next_own, F.col("window") + 1, F.lit(first), F.col("l0.param_id")),
             (any_wide, F.col("window") + 1, span_at("w1"), F.col("w1.param_id")),
             (any_later, F.col("window") + F.col("l0.request"), F.lit(first), F.col("l0.param_id"))]
    window, span, param = F.col("window") + tune_ahead, F.lit(first), F.lit(None)
    for when, w, sp, pm in cases[::-1]:
        window, span, param = F.when(when, w).otherwise(window), F.when(when, sp).otherwise(span), F.when(when, pm).otherwise(param)
    return x.select(*KEYS, F.when(param.isNotNull(), F.lit("run")).otherwise(F.lit("init")).alias("kind"), window.cast("long").alias("window"),
                    span.cast("long").alias("span"), param.cast("long").alias("param_id"), "balance", "_rows")


def retune_waves(bars: DataFrame, flags: DataFrame, params: DataFrame, tuner: Tuner, train_bars: int = WF.TRAIN_BARS, spans: tuple = SPANS,
                 trade: dict | None = None, initial: float = 1000.0, ahead: int = 16, tune_ahead: int = 4, now_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, tunings) of all series.

    bars: symbol, interval, ts, ts_ms; flags: bars with rn and every signal flag; params: param_id and the columns that
    ``with_param_scores`` reads; tuner: training rows (the columns of ``flags`` and ``request``) -> (symbol, interval, request, param_id),
    no row or a NULL if none is found. runs: a run-log row per evaluated window with param_id and wave; tunings: a row per tuning
    (kind, the window it asked for first, what it led to: window_from, span, param_id, wave)."""
    p = {**DEFAULTS, **(trade or {})}
    first, last, step = spans
    win = WF.assign_windows(bars.select(*KEYS, "ts", "ts_ms"), train_bars, now_ms, KEYS).drop("ts")
    rows = materialize(flags.join(win, [*KEYS, "ts_ms"]), "flags-windows")
    windows = materialize(rows.where("window_id >= 0").groupBy(*KEYS, "window_id").agg(F.min("rn").alias("train_rows"), F.min("ts").alias("test_start")), "windows")
    n_rows = rows.groupBy(*KEYS).agg(F.count("*").alias("_rows"))
    at = windows.select(*KEYS, F.col("window_id").alias("at"), F.col("train_rows").alias("_known"))
    n_rows = rows.groupBy(*KEYS).agg(F.count("*").alias("_rows"))
    frontier = materialize(
        windows.where("window_id = 0").join(n_rows, KEYS).select(
            *KEYS, F.lit("init").alias("kind"), F.col("window_id").alias("window"), F.lit(first).cast("long").alias("span"),
            F.lit(None).cast("long").alias("param_id"), F.lit(float(initial)).alias("balance"), "_rows"), "frontier-0")
    runs, tunings, wave = [], [], 0
    while not frontier.isEmpty():
        # -- tune whoever needs it
        need = frontier.where("kind <> 'run'")
        todo = frontier
        if not need.isEmpty():
            asked = _requests(need, at, spans, tune_ahead)
            known = rows.drop("window_id").join(asked, KEYS).where("rn < train_rows").drop("train_rows")
            got = tuner(known).where("param_id IS NOT NULL").groupBy(*KEYS).agg(
                F.collect_list(F.struct(F.col("request").cast("long").alias("request"), F.col("param_id").cast("long").alias("param_id"))).alias("got"))
            found = need.join(got, KEYS, "left").withColumn("got", F.coalesce("got", F.array().cast("array<struct<request: bigint, param_id: bigint>>")))
            moved = materialize(_answers(found, spans, tune_ahead), f"tuned-{wave}")
            tunings.append(need.select(*KEYS, F.lit(wave).alias("wave"), "kind", "window").join(
                moved.select(*KEYS, F.col("window").alias("window_from"), "span", "param_id"), KEYS))
            moved = moved.join(at.select(*KEYS, F.col("at").alias("window")), [*KEYS, "window"], "left_semi").select(*frontier.columns)  # else the series is done
            todo = materialize(frontier.where("kind = 'run'").unionByName(moved), f"todo-{wave}")

        # -- run windows for whoever has a setting
        run = todo.where("kind = 'run'").join(params, "param_id")
        if run.isEmpty():
            wave, frontier = wave + 1, todo
            continue
        mine = run.select(*KEYS, "window", *[c for c in params.columns])
        part = rows.join(mine, KEYS).where((F.col("window_id") >= F.col("window")) & (F.col("window_id") < F.col("window") + ahead))
        part = materialize(part, f"part-{wave}")
        scored = _scored(part, params.columns)
        trades = WF.window_trades(scored, KEYS, trade)
        held = WF.window_rows(trades, part.select(*KEYS, "window_id").distinct(), KEYS).withColumn("_chunk", F.lit(0))
        start = todo.where("kind = 'run'").select(*KEYS, "balance", F.lit(False).alias("ended"))
        out, states = fold_carried(held, KEYS, "_chunk", "window_id", WF._run_windows(p, initial, True), WF.OUTCOME, WF.STATE, start, f"run-{wave}")
        runs.append(materialize(out.join(run.select(*KEYS, "param_id"), KEYS).join(windows.drop("train_rows"), [*KEYS, "window_id"]).withColumn("wave", F.lit(wave)), f"runs-{wave}"))
        got = runs[-1].groupBy(*KEYS).agg(F.max_by(F.struct("window_id", "triggered_restart"), "window_id").alias("_last"))
        back = (todo.where("kind = 'run'").drop("balance").join(states, KEYS).join(got, KEYS, "left"))
        restart = F.coalesce(F.col("_last.triggered_restart"), F.lit(False))
        back = back.where(restart | ~F.col("ended"))  # ended without a restart: a ruin
        back = back.withColumns({"kind": F.when(restart, F.lit("retune")).otherwise(F.lit("run")),
                                 "window": F.when(restart, F.col("_last.window_id")).otherwise(F.col("window") + ahead),
                                 "param_id": F.when(~restart, F.col("param_id"))})
        back = back.join(at.select(*KEYS, F.col("at").alias("window")), [*KEYS, "window"], "left_semi").select(*frontier.columns)
        wave += 1
        after = materialize(todo.where("kind <> 'run'").unionByName(back), f"frontier-{wave}")
        discard(part)
        frontier = after
    log = reduce(DataFrame.unionByName, runs) if runs else None
    if log is None:  # no series has a window
        empty = windows.select(*KEYS, "window_id", "test_start", F.lit(None).cast("long").alias("param_id"), F.lit(0).alias("wave"), *[
            F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in WF.OUTCOME.split(", ")[1:])])
        tuned = frontier.select(*KEYS, F.lit(0).alias("wave"), "kind", "window", F.col("window").alias("window_from"), "span", "param_id")
        return WF.run_log(empty), tuned
    return WF.run_log(log), reduce(DataFrame.unionByName, tunings)


def _scored(part: DataFrame, names: list[str]) -> DataFrame:
    """Rows that carry their own setting -> entries, by the same rule as ``with_param_scores``."""
    from kandle.operators.signals import entry_columns
    return part.select(*[c for c in part.columns if c not in names and c != "window"], *entry_columns(names))
