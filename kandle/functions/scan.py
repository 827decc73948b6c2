"""Affine scans y_t = q*y_{t-1} + u_t (EMA, RMA, EWM) with native window functions.

Block-parallel and exact to double precision: inside a block of B rows,
    loc_t = q^k * sum_{j<=k} u_j * q^-j        (k = position in block)
is a running sum over (series, part, block). The carry into block b is the previous block's
local end value U_{b-1}; older blocks are scaled by q^B < 1e-20 and vanish in double
precision, so y_t = loc_t + q^(k+1) * U_{b-1}. B is the smallest configured block size with
q^B < 1e-20 and q^-B < 1e250 (no overflow). U_{b-1} is read with a running ``last`` over the
canonical window; for the first block of a part it comes from the halo rows.

Expressions are SQL text (one ``selectExpr`` per layer keeps driver-side plan building cheap).
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kandle.operators.layout import BLOCKS, KEYS

TRUNC_LOG10 = 20.0
OVERFLOW_LOG10 = 250.0


def pick_block(q: float) -> int:
    if q <= 0.0:
        return BLOCKS[0]
    lq = -math.log10(q)
    for b in BLOCKS:
        if b * lq >= TRUNC_LOG10 and b * lq <= OVERFLOW_LOG10:
            return b
    raise ValueError(f"no scan block size fits decay factor q={q}")


@dataclass
class Spec:
    out: str
    u: str       # SQL: per-row input (NULL treated as 0)
    q: float     # decay
    valid: str   # SQL: rows where the output is defined (others -> NULL)
    seed_rn: str | None = None  # SQL: the row where the recursion starts; it gets u exactly


def _q(k: list[str]) -> str:
    return ", ".join(f"`{c}`" for c in k)


def scan(df: DataFrame, specs: list[Spec], keys=KEYS) -> DataFrame:
    """Add one column per spec (specs must not depend on each other): two projection layers,
    block-local running sums, then carries."""
    kk = _q(list(keys))
    loc_w = {BLOCKS[0]: f"PARTITION BY {kk}, part, b_hi, b_lo ORDER BY rn",
             BLOCKS[1]: f"PARTITION BY {kk}, part, b_hi ORDER BY b_lo, rn"}
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    prev = f"PARTITION BY {kk}, part ORDER BY b_hi, b_lo, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    locs, outs = [], []
    for s in specs:
        b = pick_block(s.q)
        k = f"CAST(rn % {b} AS DOUBLE)"
        q = repr(float(s.q))
        u = f"coalesce({s.u}, 0D)"
        locs.append(f"pow({q}, {k}) * sum(({u}) * pow({q}, -{k})) OVER ({loc_w[b]} {run}) AS `_loc_{s.out}`")
        carry = f"last(CASE WHEN rn % {b} = {b - 1} THEN `_loc_{s.out}` END, true) OVER ({prev})"
        exact = f"WHEN rn = {s.seed_rn} THEN {u} " if s.seed_rn is not None else ""
        outs.append(f"CASE WHEN NOT ({s.valid}) THEN NULL {exact}"
                    f"ELSE `_loc_{s.out}` + pow({q}, {k} + 1D) * coalesce({carry}, 0D) END AS `{s.out}`")
    base = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*base, *locs)
    return df.selectExpr(*base, *outs)


# ---- spec builders (SQL text) ---------------------------------------------------------------

def ewm_spec(out: str, x: str, span: float, first_rn: int | str = 0) -> list[Spec]:
    """pandas ewm(span, adjust=False): seeded with the first value (at row first_rn)."""
    a = 2.0 / (span + 1.0)
    f = str(first_rn)
    u = f"CASE WHEN rn = {f} THEN {x} WHEN rn > {f} THEN {a!r} * ({x}) END"
    return [Spec(out, u, 1.0 - a, f"rn >= {f}", f)]


def ema_sma_seed_spec(out: str, x: str, seed: str, n: int, start_rn: int | str = 0) -> list[Spec]:
    """SMA-seeded EMA: row start+n-1 holds ``seed`` (mean of the first n inputs), then alpha=2/(n+1)."""
    a = 2.0 / (n + 1.0)
    s = f"({start_rn} + {n - 1})"
    u = f"CASE WHEN rn = {s} THEN {seed} WHEN rn > {s} THEN {a!r} * ({x}) END"
    return [Spec(out, u, 1.0 - a, f"rn >= {s}", s)]


def rma_specs(out: str, x: str, n: int, first_rn: int | str = 0) -> list[Spec]:
    """pandas ewm(alpha=1/n, adjust=True, min_periods=n) = ratio of two scans; returns num/den specs."""
    q = 1.0 - 1.0 / n
    live = f"rn >= {first_rn}"
    return [Spec(f"_{out}_num", f"CASE WHEN {live} THEN {x} END", q, live, str(first_rn)),
            Spec(f"_{out}_den", f"CASE WHEN {live} THEN 1D END", q, live, str(first_rn))]


def rma_value(out: str, n: int, first_rn: int | str = 0) -> str:
    return f"CASE WHEN rn - ({first_rn}) + 1 >= {n} THEN `_{out}_num` / `_{out}_den` END"
