"""Binned interval joins (J02, J03): points in ranges, per key, without a task per key.

The number line is cut into bins of ``width``; a point lies in one, a range is copied into every bin it touches. The join is
an equality on (keys, bin) with the exact bounds as a residual, so a key that holds most of the rows is spread over its bins
like any other rows. With the default width, the mean length of the ranges, a range has two to three copies on average; a few
very long ranges have more, each of them a short row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bin_width(ranges: DataFrame, lo: Column, hi: Column) -> int:
    """The mean length of the ranges, at least 1."""
    return max(1, int(ranges.agg(F.avg(hi - lo)).first()[0] or 1))


def interval_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: Column, lo: Column, hi: Column, width: int | None = None,
                  how: str = "inner") -> DataFrame:
    """``points`` x ``ranges`` with equal ``keys`` and lo <= at <= hi (whole numbers, both ends inclusive).

    Columns: ``keys``, the other columns of ``points``, the other columns of ``ranges`` (names must differ). ``how="left"``: ranges
    without a point are kept with NULL points. NULL keys and bounds match nothing; a range that ends before it begins is empty."""
    width = width or bin_width(ranges, lo, hi)
    other = [c for c in ranges.columns if c not in keys]
    mine = [c for c in points.columns if c not in keys]
    clash = set(mine) & set(other)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    r = ranges.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long"), "__id": F.monotonically_increasing_id()}) if how == "left" else \
        ranges.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long")})
    if how == "left":
        from kandle.sources.scratch import materialize
        r = materialize(r, "ranges")  # its row numbers are looked at twice
    p = points.withColumn("__at", at.cast("long")).withColumn("__bin", F.floor(F.col("__at") / width))
    copies = r.where("__lo <= __hi").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    j = p.join(copies, [*keys, "__bin"]).where("__at >= __lo AND __at <= __hi")
    if how != "left":
        return j.select(*keys, *mine, *other)
    none = r.join(j.select("__id").distinct(), "__id", "left_anti")
    return j.select(*keys, *mine, *other).unionByName(none.select(*keys, *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in mine], *other))


def run_trades(runs: DataFrame, trades: DataFrame, how: str = "inner") -> DataFrame:
    """The trades of each run. A session writes many runs, and a trade row carries only session, symbol and time: so the keys are
    session_uuid and symbol, and the time must lie in the run's window (window_start to window_end, both inclusive)."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return interval_join(trades, runs, ["session_uuid", "symbol"], us("timestamp"), us("window_start"), us("window_end"), how=how)
