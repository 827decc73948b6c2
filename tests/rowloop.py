"""Plain-Python port of the replay *semantics* (test oracle only): one pass over bars."""


def run_loop(rows, tp=0.025, sl=0.0175, risk=0.05, lev=1.0, fee=0.00055, bal=1000.0, finalize=True):
    """rows: list of dicts with open, high, low, close, long_entry, short_entry[, long_exit, short_exit]."""
    pos, ep, qty, trades = 0, 0.0, 0.0, []
    for i, r in enumerate(rows):
        if pos != 0:
            x = kind = None
            tpx, slx = ep * (1 + pos * tp), ep * (1 - pos * sl)
            if (pos == 1 and r["high"] >= tpx) or (pos == -1 and r["low"] <= tpx):
                x, kind = tpx, "TP"
            elif pos == 1 and r["low"] <= slx:
                x, kind = min(r["open"], slx), "SL"
            elif pos == -1 and r["high"] >= slx:
                x, kind = max(r["open"], slx), "SL"
            if x is not None:
                pnl = pos * (x - ep) * qty - x * qty * fee
                bal += pnl
                trades.append((kind, i, x, pnl))
                pos = 0
                continue
            ex = r.get("long_exit", 0) if pos == 1 else r.get("short_exit", 0)
            if ex == 1:
                x = r["close"]
                pnl = pos * (x - ep) * qty - x * qty * fee
                bal += pnl
                trades.append(("SIGNAL", i, x, pnl))
                pos = 0
        else:
            side = 1 if r.get("long_entry") else (-1 if r.get("short_entry") else 0)
            if side:
                price = r["close"]
                ok = price > 0 and sl > 0 and risk > 0 and lev > 0
                qty = bal * risk * lev / sl / price if ok else 0.0
                bal -= qty * price * fee
                pos, ep = side, price
    if finalize and pos != 0 and qty > 0:
        x = rows[-1]["close"]
        pnl = pos * (x - ep) * qty - x * qty * fee
        bal += pnl
        trades.append(("AUTO", len(rows) - 1, x, pnl))
    return trades, bal
