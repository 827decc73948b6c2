"""Series integrity (A11) and freshness."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kandle.functions.intervals import interval_seconds
from kandle.operators.layout import on_layout


def gaps(bars: DataFrame, keys=("symbol", "interval")) -> DataFrame:
    """Missing bar timestamps: between consecutive bars d = delta/expected; int(d) - 1 missing
    (deltas shorter than expected yield none). One row per missing timestamp."""
    step = interval_seconds("interval") * 1000
    b = on_layout(bars.select(*keys, "ts", "ts_ms"), lambda d, w: d.withColumn("_prev", F.lag("ts_ms").over(w)),
                  list(keys), look_back=1).withColumn("_step", step)
    b = b.withColumn("_n", F.floor((F.col("ts_ms") - F.col("_prev")) / F.col("_step")).cast("bigint") - 1)
    g = b.where(F.col("_n") > 0)
    g = g.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return g.select(*keys, (F.col("_prev") + F.col("_i") * F.col("_step")).alias("missing_ms"))


def integrity(bars: DataFrame, now_ms: int, keys=("symbol", "interval")) -> DataFrame:
    """A11 per series: rows, missing count, last ts, stale (now - last > interval), ok."""
    step = interval_seconds("interval") * 1000
    s = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max("ts_ms").alias("last_ms"))
    m = gaps(bars, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))
    out = s.join(m, list(keys), "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("bigint"))
    out = out.withColumn("stale", F.lit(now_ms) - F.col("last_ms") > step)
    return out.withColumn("ok", (F.col("rows") > 0) & (F.col("missing") == 0) & ~F.col("stale"))
