"""Series layout: the physical shape every bar-level job runs on.

A series is (symbol, interval). Bars of one series are cut into *parts* by time:
``part = floor(epoch / (interval_seconds * part_rows))``. Bars are unique per (series, ts), so a
part never holds more than ``part_rows`` rows: a hot symbol spreads over many tasks instead of
one. The table is hash-partitioned once by (series, part) and sorted by
(series, part, b_hi, b_lo, rn); every later window (lags, rolling frames, scan blocks) uses a
spec compatible with that order, so Spark plans no further exchange or sort for them.

Look-back across a part boundary comes from *halo* rows: the ``halo`` rows before the part by row
number, from as many earlier parts as hold them, copied into the partition (is_halo = true) and
dropped at the end. Only halo rows move in that second shuffle; the union keeps the hash
partitioning. Lags and frames ask for the rows they look back, scans for ``HALO_ROWS``.

Columns added: part, rn (0-based row number in the series), b_lo = rn div BLOCKS[0],
b_hi = rn div BLOCKS[1], is_halo.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kandle.functions.intervals import epoch_us, interval_seconds

# Scan block sizes (rows). b_lo nests in b_hi, both nest in a part.
BLOCKS = (1024, 8192)
PART_ROWS = 1 << 20
HALO_ROWS = 4 * BLOCKS[1]
KEYS = ["symbol", "interval"]


def canonical_window(keys=KEYS) -> Window:
    """The one ordering all bar-level windows share."""
    return Window.partitionBy(*keys, "part").orderBy("b_hi", "b_lo", "rn")


def many_parts(bars: DataFrame, keys=KEYS, part_rows: int = PART_ROWS) -> bool:
    """Whether any series spans several parts: one look at the times of the bars."""
    per = interval_seconds("interval") * F.lit(part_rows) * F.lit(1_000_000)
    part = F.floor(epoch_us("ts") / per)
    ends = bars.groupBy(*keys).agg(F.min(part).alias("a"), F.max(part).alias("b"))
    return not ends.where("a < b").isEmpty()


def layout(bars: DataFrame, keys=KEYS, part_rows: int = PART_ROWS, halo: int = HALO_ROWS) -> DataFrame:
    per = interval_seconds("interval") * F.lit(part_rows) * F.lit(1_000_000)
    base = bars.withColumn("part", F.floor(epoch_us("ts") / per).cast("bigint"))
    # distribute by (symbol, part) only: windows over (symbol, interval, part) are satisfied by it,
    # and the hash keys never contain a column the optimizer may fold into a constant
    dist = [keys[0], "part"]
    base = base.repartition(*dist)
    lrn = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("ts")) - 1
    # own rows, per-part counts and halo rows read the same exchange, which Spark reuses
    base = base.withColumn("_lrn", lrn.cast("bigint"))
    # per-part counts -> offsets (a small table: one row per series part)
    counts = base.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("_cnt"))
    ws = Window.partitionBy(*keys).orderBy("part")
    counts = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    # which earlier parts hold some of the ``halo`` rows before a part
    to = counts.select(*keys, F.col("part").alias("_to"), (F.col("_off") - halo).alias("_from"))
    feeds = (counts.join(to, keys).where((F.col("part") < F.col("_to")) & (F.col("_off") + F.col("_cnt") > F.col("_from")))
             .select(*keys, "part", "_to", "_from"))
    lay = base.join(counts, [*keys, "part"], "inner")
    lay = lay.withColumn("rn", F.col("_off") + F.col("_lrn")).withColumn("is_halo", F.lit(False))
    own = lay
    halo_rows = (lay.where(F.col("_lrn") >= F.col("_cnt") - halo).join(feeds, [*keys, "part"])
                 .where(F.col("rn") >= F.col("_from")).withColumn("part", F.col("_to")).drop("_to", "_from")
                 .withColumn("is_halo", F.lit(True)).repartition(*dist))
    out = own.unionByName(halo_rows)
    out = (out.drop("_lrn", "_cnt", "_off")
           .withColumn("b_lo", F.floor(F.col("rn") / BLOCKS[0]).cast("bigint"))
           .withColumn("b_hi", F.floor(F.col("rn") / BLOCKS[1]).cast("bigint")))
    return out.sortWithinPartitions(*keys, "part", "b_hi", "b_lo", "rn")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_halo")).drop("is_halo", "b_lo", "b_hi")


def on_layout(bars: DataFrame, fn, keys=KEYS, look_back: int = 256, **kw) -> DataFrame:
    """Run ``fn(laid_out_df, canonical_window)`` on the skew-safe layout and drop the halo rows:
    the way to compute any lag / frame of up to ``look_back`` rows without a whole-series partition."""
    return drop_halo(fn(layout(bars, keys, halo=look_back, **kw), canonical_window(keys)))
