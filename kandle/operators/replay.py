"""Trade replay B01-B07 as table operators (no row loop over bars).

1. B01 candidates: every bar with an entry flag (long wins ties), entry at close.
2. B02 first barrier: for each candidate, the first later bar in its segment where take-profit,
   stop-loss or an exit signal fires. Bars are summarised in nested blocks of 64 (max high, min low,
   any exit flag), each block one row with an array. A candidate looks at its right-hand siblings on
   each level, takes the lowest level with a possible hit, then descends to the bar: one joined row
   per candidate and level, no scan of a series, no horizon cap.
3. B03 non-overlap: the next trade is the first candidate after the previous exit bar: a pointer
   chain, contracted inside bounded chunks (kandle.operators.chain).
4. B04 compounding: with k = risk*lev/sl each trade multiplies the balance by
   f = 1 + k*(side*(x/e - 1) - fee*(1 + x/e)); balances are a running product.
5. B05 trade legs in the reference's action names; B06 positions carried in and out; A01/A02 summaries.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kandle.operators.chain import CHUNK, follow_chain, next_after
from kandle.sources.scratch import materialize

FANOUT = 64
TRADE_CHUNK = 1 << 16
# Fixed values that must equal the reference's replay defaults.
DEFAULTS = {"leverage": 1.0, "initial_balance": 1000.0, "tp_pct": 0.025, "sl_pct": 0.0175,
            "risk_pct": 0.05, "fee": 0.00055}
# Actions that close a trade.
CLOSE_ACTIONS = ["CLOSE LONG", "CLOSE SHORT", "TP CLOSE LONG", "TP CLOSE SHORT", "SL CLOSE LONG",
                 "SL CLOSE SHORT", "AUTO SELL", "AUTO COVER"]


def closed_legs(legs: DataFrame) -> DataFrame:
    """The legs that close a trade."""
    return legs.where(F.col("action").isin(*CLOSE_ACTIONS))


def _p(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(DEFAULTS[name])) if name in df.columns else F.lit(DEFAULTS[name])


def candidates(entries: DataFrame, seg: list[str], pk: list[str], qty: str | None = None) -> DataFrame:
    """(seg, pk, e = srn, side, entry price, barrier prices, sizing params, given size if any)."""
    le = F.coalesce(F.col("long_entry").cast("boolean"), F.lit(False))
    se = F.coalesce(F.col("short_entry").cast("boolean"), F.lit(False))
    c = entries.where(le | se)
    side = F.when(le, F.lit(1)).otherwise(F.lit(-1))
    tp, sl = _p(entries, "tp_pct"), _p(entries, "sl_pct")
    return c.select(*seg, *pk, F.col("srn").alias("e"), side.alias("side"), F.col("close").alias("ep"),
                    tp.alias("tp_pct"), sl.alias("sl_pct"), _p(entries, "risk_pct").alias("risk_pct"),
                    _p(entries, "leverage").alias("leverage"), _p(entries, "fee").alias("fee"),
                    _p(entries, "initial_balance").alias("initial_balance"),
                    (F.col(qty) if qty else F.lit(None).cast("double")).alias("carried_qty")) \
        .withColumn("tp_px", F.col("ep") * (1 + F.col("side") * F.col("tp_pct"))) \
        .withColumn("sl_px", F.col("ep") * (1 - F.col("side") * F.col("sl_pct")))


def _hit(n: Column) -> Column:
    """Can a barrier or an exit flag of the candidate's side fire inside node ``n``?"""
    long_hit = (n["mh"] >= F.col("tp_px")) | (n["ml"] <= F.col("sl_px")) | (n["lx"] > 0)
    short_hit = (n["ml"] <= F.col("tp_px")) | (n["mh"] >= F.col("sl_px")) | (n["sx"] > 0)
    return F.when(F.col("side") == 1, long_hit).otherwise(short_hit)


def _blocks(bars: DataFrame, seg: list[str], depth: int) -> list[DataFrame]:
    """Level j: one row per parent with its up to 64 nodes (id, max high, min low, any exit flag), in order."""
    lx = F.coalesce(F.col("long_exit").cast("int"), F.lit(0)) if "long_exit" in bars.columns else F.lit(0)
    sx = F.coalesce(F.col("short_exit").cast("int"), F.lit(0)) if "short_exit" in bars.columns else F.lit(0)
    nodes = bars.select(*seg, (F.col("srn") + 1).cast("long").alias("id"), F.col("high").alias("mh"), F.col("low").alias("ml"),
                        lx.alias("lx"), sx.alias("sx"))
    out = []
    for _ in range(depth + 1):
        up = nodes.groupBy(*seg, F.floor(F.col("id") / FANOUT).alias("par")).agg(
            F.sort_array(F.collect_list(F.struct("id", "mh", "ml", "lx", "sx"))).alias("kids"),
            F.max("mh").alias("mh"), F.min("ml").alias("ml"), F.max("lx").alias("lx"), F.max("sx").alias("sx"))
        out.append(up.select(*seg, "par", "kids"))
        nodes = up.select(*seg, F.col("par").alias("id"), "mh", "ml", "lx", "sx")
    return out


def first_exit(bars: DataFrame, cands: DataFrame, seg: list[str], max_len: int) -> DataFrame:
    """``cands`` with the exit bar index x (NULL = no barrier before the end). One joined row per
    candidate and level: a block of 64 nodes comes as one array and its first hit is found inside the row.
    Ids are bar indices + 1, so a position carried in (e = -1) is node 0."""
    depth = 1
    while FANOUT ** (depth + 1) < max_len + 2:
        depth += 1
    blocks = _blocks(bars, seg, depth)
    cur = cands.withColumn("_id", (F.col("e") + 1).cast("long"))
    lvl, node = F.lit(None).cast("int"), F.lit(None).cast("long")
    for j in range(depth + 1):
        anc = F.floor(F.col("_id") / FANOUT ** j)
        cur = cur.withColumn("par", F.floor(F.col("_id") / FANOUT ** (j + 1))).join(blocks[j], [*seg, "par"], "left")
        # F.get: NULL beyond the end of the array
        cur = cur.withColumn(f"_n{j}", F.get(F.filter("kids", lambda n: (n["id"] > anc) & _hit(n)), F.lit(0))["id"]).drop("kids", "par")
    for j in range(depth, -1, -1):
        lvl = F.when(F.col(f"_n{j}").isNotNull(), F.lit(j)).otherwise(lvl)
        node = F.coalesce(F.col(f"_n{j}"), node)
    cur = cur.withColumns({"_lvl": lvl, "_node": node}).drop(*[f"_n{j}" for j in range(depth + 1)])
    for j in range(depth, 0, -1):
        below = F.col("_lvl") >= j
        par = F.when(below, F.col("_node")).otherwise(F.floor(F.col("_id") / FANOUT ** j))
        cur = cur.withColumn("par", par).join(blocks[j - 1], [*seg, "par"], "left")
        cur = cur.withColumn("_node", F.when(below, F.get(F.filter("kids", _hit), F.lit(0))["id"]).otherwise(F.col("_node"))).drop("kids", "par")
    return cur.withColumn("x", F.col("_node") - 1).drop("_id", "_lvl", "_node")


def select_trades(cx: DataFrame, seg: list[str], pk: list[str], max_len: int, chunk: int = CHUNK) -> DataFrame:
    """Non-overlapping trades per (segment, param): the chain 'first candidate after my exit bar' from
    the first candidate on, with its hop count as trade number (kandle.operators.chain)."""
    g = [*seg, *pk]
    # positions shifted by one: a carried position stands at -1
    narrow = cx.select(*g, (F.col("e") + 1).cast("long").alias("e"), (F.col("xe") + 1).cast("long").alias("xe"))
    nodes = next_after(narrow, narrow.select(*g, F.col("e").alias("pid"), F.col("xe").alias("x")), g, chunk)
    heads = narrow.groupBy(*g).agg(F.min("e").alias("id"))
    path = follow_chain(nodes.select(*g, F.col("pid").alias("id"), "nxt"), heads, g, max_len + 1, chunk)
    return cx.join(path.select(*g, (F.col("id") - 1).alias("e"), F.col("dist").alias("trade_no")), [*g, "e"])


def _carried(open_positions: DataFrame, entries: DataFrame, seg: list[str], pk: list[str]) -> DataFrame:
    """Positions held when a segment begins, as candidates before its first bar.
    open_positions: seg + pk, position_type (long/short), entry_price, position (size), and the sizing
    parameters if they differ from the defaults. Flat rows (no type or no size) are left out."""
    o = open_positions.where(F.col("position_type").isin("long", "short") & (F.col("position") != 0))
    have = [c for c in DEFAULTS if c in entries.columns and c not in o.columns]
    if have:
        o = o.join(entries.groupBy(*seg, *pk).agg(*[F.max(c).alias(c) for c in have]), [*seg, *pk], "left")
    side = F.when(F.col("position_type") == "long", 1).otherwise(-1)
    o = o.select(*seg, *pk, F.lit(-1).alias("srn"), (side == 1).alias("long_entry"), (side == -1).alias("short_entry"),
                 F.col("entry_price").cast("double").alias("close"), F.col("position").cast("double").alias("carried_qty"),
                 *[c for c in DEFAULTS if c in o.columns])
    return candidates(o, seg, pk, "carried_qty")


def replay(bars: DataFrame, entries: DataFrame, seg: list[str], pk: list[str] | None = None,
           finalize: bool = True, open_positions: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Trades (one row per trade) with exit kind/price, qty, pnl, balances.

    bars:    seg + srn (0-based bar index in the segment), open, high, low, close[, long_exit, short_exit]
    entries: seg + pk + srn, close, long_entry, short_entry [+ tp_pct, sl_pct, risk_pct, leverage,
             fee, initial_balance]
    open_positions (B06): positions carried in, see ``_carried``; their size is given, they pay no entry fee.

    The candidates with their exits and the trades are each written once; nothing plans them again."""
    pk = pk or []
    bars = materialize(bars.select(*seg, "srn", "open", "high", "low", "close",
                                   *[c for c in ("long_exit", "short_exit") if c in bars.columns]), "replay-bars")
    stats = bars.groupBy(*seg).agg(F.max("srn").alias("last_srn"),
                                   F.max_by("close", "srn").alias("last_close"))
    max_len = int(stats.agg(F.max("last_srn")).first()[0] or 0)
    cands = candidates(entries, seg, pk)
    if open_positions is not None:
        cands = cands.unionByName(_carried(open_positions, entries, seg, pk))
    if pk:
        # settings that enter on the same bar with the same barriers leave on the same bar: one search for them
        cands = materialize(cands, "replay-entries")
        same = ["e", "side", "ep", "tp_pct", "sl_pct"]
        found = first_exit(bars, cands.select(*seg, *same, "tp_px", "sl_px").distinct(), seg, max_len)
        found = found.select(*[F.col(c).alias(f"_f_{c}") for c in (*seg, *same)], "x")
        hits = [F.col(c) == F.col(f"_f_{c}") for c in (*seg, "e", "side")] + [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in same[2:]]
        cx = cands.join(found, hits).drop(*[f"_f_{c}" for c in (*seg, *same)]).join(stats, seg)
    else:
        cx = first_exit(bars, cands, seg, max_len).join(stats, seg)
    cx = materialize(cx.withColumn("xe", F.coalesce(F.col("x"), F.col("last_srn"))), "replay-candidates")
    tr = select_trades(cx, seg, pk, max_len, chunk)
    lx = F.coalesce(F.col("long_exit").cast("int"), F.lit(0)) if "long_exit" in bars.columns else F.lit(0)
    sx = F.coalesce(F.col("short_exit").cast("int"), F.lit(0)) if "short_exit" in bars.columns else F.lit(0)
    xb = bars.select(*seg, F.col("srn").alias("x"), F.col("open").alias("x_open"), F.col("high").alias("x_high"),
                     F.col("low").alias("x_low"), F.col("close").alias("x_close"), lx.alias("x_lx"), sx.alias("x_sx"))
    tr = tr.join(xb, [*seg, "x"], "left")
    longp = F.col("side") == 1
    tp_hit = F.when(longp, F.col("x_high") >= F.col("tp_px")).otherwise(F.col("x_low") <= F.col("tp_px"))
    sl_hit = F.when(longp, F.col("x_low") <= F.col("sl_px")).otherwise(F.col("x_high") >= F.col("sl_px"))
    kind = (F.when(F.col("x").isNull(), F.lit("AUTO")).when(tp_hit, F.lit("TP")).when(sl_hit, F.lit("SL"))
            .otherwise(F.lit("SIGNAL")))
    sl_fill = F.when(longp, F.least("x_open", "sl_px")).otherwise(F.greatest("x_open", "sl_px"))
    xp = (F.when(kind == "AUTO", F.col("last_close")).when(kind == "TP", F.col("tp_px"))
          .when(kind == "SL", sl_fill).otherwise(F.col("x_close")))
    valid = (F.col("ep") > 0) & (F.col("sl_pct") > 0) & (F.col("risk_pct") > 0) & (F.col("leverage") > 0)
    k = F.when(valid, F.col("risk_pct") * F.col("leverage") / F.col("sl_pct")).otherwise(0.0)
    tr = tr.withColumns({"kind": kind, "xp": xp, "k": k})
    r = F.col("xp") / F.col("ep")
    held = F.col("carried_qty")
    own = (F.col("side") * (F.col("xp") - F.col("ep")) - F.col("xp") * F.col("fee")) * held
    f_closed = F.when(held.isNull(), 1 + F.col("k") * (F.col("side") * (r - 1) - F.col("fee") * (1 + r))) \
        .otherwise(1 + own / F.col("initial_balance"))
    f_open = F.when(held.isNull(), 1 - F.col("k") * F.col("fee")).otherwise(F.lit(1.0))
    # an end-of-data position is auto-closed only when finalizing and its size is > 0 (after a
    # ruin the balance, hence the size, can be negative); it is always the segment's last trade,
    # so its own factor never feeds another trade's balance
    tr = tr.withColumn("f", F.when(F.col("kind") != "AUTO", f_closed).otherwise(f_open))
    # running product in bounded chunks of trades: product inside the chunk x prefix product of
    # earlier chunks' totals (one row per chunk), so no window spans a whole (segment, param)
    g = [*seg, *pk]
    tr = tr.withColumn("_ch", F.floor(F.col("trade_no") / TRADE_CHUNK))
    wl = Window.partitionBy(*g, "_ch").orderBy("trade_no").rowsBetween(Window.unboundedPreceding, -1)
    tr = tr.withColumn("_local", F.coalesce(F.product("f").over(wl), F.lit(1.0)))
    tot = tr.groupBy(*g, "_ch").agg(F.product("f").alias("_tot"))
    wc = Window.partitionBy(*g).orderBy("_ch").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_prev", F.coalesce(F.product("_tot").over(wc), F.lit(1.0))).drop("_tot")
    tr = tr.join(tot, [*g, "_ch"]).withColumn("bal_before", F.col("initial_balance") * F.col("_prev") * F.col("_local")) \
           .drop("_ch", "_local", "_prev")
    tr = tr.withColumn("qty", F.coalesce(held, F.col("bal_before") * F.col("k") / F.col("ep")))
    tr = tr.withColumn("closed", (F.col("kind") != "AUTO") | (F.lit(finalize) & (F.col("qty") > 0)))
    tr = tr.withColumn("balance_after", F.col("bal_before") * F.when(F.col("closed"), f_closed).otherwise(f_open))
    pnl = F.col("side") * (F.col("xp") - F.col("ep")) * F.col("qty") - F.col("xp") * F.col("qty") * F.col("fee")
    action = F.when(F.col("kind") == "AUTO", F.when(longp, F.lit("AUTO SELL")).otherwise(F.lit("AUTO COVER"))) \
        .otherwise(F.concat(F.when(F.col("kind") == "TP", F.lit("TP ")).when(F.col("kind") == "SL", F.lit("SL "))
                            .otherwise(F.lit("")), F.lit("CLOSE "),
                            F.when(longp, F.lit("LONG")).otherwise(F.lit("SHORT"))))
    tr = tr.withColumns({
        "pnl": F.when(F.col("closed"), pnl),
        "exit_action": F.when(F.col("closed"), action),
        "side_name": F.when(longp, F.lit("long")).otherwise(F.lit("short"))})
    tr = tr.select(*seg, *pk, "trade_no", "side_name", F.col("e").alias("entry_srn"),
                   F.col("xe").alias("exit_srn"), F.col("ep").alias("entry_price"),
                   F.col("xp").alias("exit_price"), "kind", "exit_action", "closed", "qty", "pnl",
                   "bal_before", "balance_after", "initial_balance")
    return materialize(tr, "replay-trades")


def final_state(trades: DataFrame, series: DataFrame, seg: list[str], pk: list[str] | None = None) -> DataFrame:
    """Balance and open position per (segment, param) after a replay, as ``open_positions`` of the next:
    position_type NULL, position 0 and entry_price 0 when flat."""
    g = [*seg, *(pk or [])]
    last = trades.groupBy(*g).agg(F.max_by(F.struct("closed", "side_name", "qty", "entry_price", "balance_after"), "trade_no").alias("l"))
    init = F.col("initial_balance").cast("double") if "initial_balance" in series.columns else F.lit(DEFAULTS["initial_balance"])
    open_ = F.col("l").isNotNull() & ~F.col("l.closed")
    return series.select(*g, init.alias("_init")).join(last, g, "left").select(
        *g, F.coalesce("l.balance_after", "_init").alias("balance"), F.when(open_, F.col("l.side_name")).alias("position_type"),
        F.when(open_, F.col("l.qty")).otherwise(0.0).alias("position"), F.when(open_, F.col("l.entry_price")).otherwise(0.0).alias("entry_price"))


def trade_legs(trades: DataFrame, seg: list[str], pk: list[str] | None = None) -> DataFrame:
    """The reference's trade list: an OPEN leg and (if closed) an exit leg per trade."""
    pk = pk or []
    open_leg = trades.where("entry_srn >= 0").select(*seg, *pk, "trade_no", F.lit(0).alias("leg"),
                             F.concat(F.lit("OPEN "), F.upper("side_name")).alias("action"),
                             F.col("entry_srn").alias("srn"), F.col("entry_price").alias("price"),
                             F.lit(0.0).alias("pnl"), "side_name", "qty")
    exit_leg = trades.where("closed").select(*seg, *pk, "trade_no", F.lit(1).alias("leg"),
                                             F.col("exit_action").alias("action"), F.col("exit_srn").alias("srn"),
                                             F.col("exit_price").alias("price"), "pnl", "side_name", "qty")
    return open_leg.unionByName(exit_leg)


def summarize(trades: DataFrame, series: DataFrame, seg: list[str], pk: list[str] | None = None) -> DataFrame:
    """A01 + A02 per (segment, param), including series/params with no trade at all.

    ``series`` lists every (seg, pk) to report plus initial_balance (optional)."""
    pk = pk or []
    t = trades
    g = [*seg, *pk]
    c = t.where("closed").withColumn("win", (F.col("pnl") > 0).cast("int"))
    # gaps-and-islands in bounded chunks of trades: a run starts where the outcome differs from
    # the previous closed trade (across a chunk edge: the previous chunk's last outcome, from a
    # one-row-per-chunk table); run ids are chunked prefix sums of the starts
    c = c.withColumn("_ch", F.floor(F.col("trade_no") / TRADE_CHUNK))
    wl = Window.partitionBy(*g, "_ch").orderBy("trade_no")
    chunks = c.groupBy(*g, "_ch").agg(F.max_by("win", "trade_no").alias("_lastwin"))
    wc = Window.partitionBy(*g).orderBy("_ch")
    chunks = chunks.withColumn("_prevwin", F.lag("_lastwin").over(wc)).drop("_lastwin")
    c = c.join(chunks, [*g, "_ch"])
    prev = F.coalesce(F.lag("win").over(wl), F.col("_prevwin"))
    c = c.withColumn("_start", F.when(prev.isNull() | (prev != F.col("win")), 1).otherwise(0))
    c = c.withColumn("_lrun", F.sum("_start").over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    st = c.groupBy(*g, "_ch").agg(F.sum("_start").alias("_n"))
    st = st.withColumn("_off", F.coalesce(F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(st.drop("_n"), [*g, "_ch"]).withColumn("_run", F.col("_off") + F.col("_lrun"))
    runs = c.groupBy(*g, "win", "_run").agg(F.count(F.lit(1)).alias("_len"))
    streaks = runs.groupBy(*g).agg(
        F.coalesce(F.max(F.when(F.col("win") == 1, F.col("_len"))), F.lit(0)).alias("max_win_streak"),
        F.coalesce(F.max(F.when(F.col("win") == 0, F.col("_len"))), F.lit(0)).alias("max_loss_streak"))
    agg = c.groupBy(*seg, *pk).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.sum((F.col("pnl") > 0).cast("int")).alias("_wins"),
        F.sum((F.col("pnl") < 0).cast("int")).alias("_losses"),
        F.sum("pnl").alias("_pnl"),
        F.avg(F.when(F.col("pnl") <= 0, F.col("pnl"))).alias("avg_loss"),
        F.min(F.when(F.col("pnl") <= 0, F.col("pnl"))).alias("max_loss"))
    fin = t.groupBy(*seg, *pk).agg(F.max_by("balance_after", "trade_no").alias("_final"))
    init = F.coalesce(F.col("initial_balance").cast("double"), F.lit(DEFAULTS["initial_balance"])) \
        if "initial_balance" in series.columns else F.lit(DEFAULTS["initial_balance"])
    s = series.select(*seg, *pk, init.alias("initial_balance"))
    out = s.join(agg, [*seg, *pk], "left").join(fin, [*seg, *pk], "left").join(streaks, [*seg, *pk], "left")
    final = F.coalesce(F.col("_final"), F.col("initial_balance"))
    n = F.coalesce(F.col("total_trades"), F.lit(0))
    return out.select(
        *seg, *pk, n.cast("bigint").alias("total_trades"),
        F.when(n > 0, F.col("_wins") / n).otherwise(0.0).alias("winrate"),
        F.when(n > 0, F.col("_losses") / n).otherwise(1.0).alias("lossrate"),
        F.when(n > 0, F.col("_pnl")).otherwise(final - F.col("initial_balance")).alias("pnl"),
        F.when(n > 0, F.col("_pnl") / n).otherwise(0.0).alias("avg_trade"),
        final.alias("final_balance"),
        F.coalesce("max_win_streak", F.lit(0)).cast("bigint").alias("max_win_streak"),
        F.coalesce("max_loss_streak", F.lit(0)).cast("bigint").alias("max_loss_streak"),
        F.coalesce("avg_loss", F.lit(0.0)).alias("avg_loss"), F.coalesce("max_loss", F.lit(0.0)).alias("max_loss"))
