"""Reports: earlier signal set (W32), feature relevance (A07), fingerprints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kandle.operators.layout import KEYS
from kandle.sources.scratch import materialize

# Fixed values that must equal the earlier signal set's thresholds.
RSI_LONG, RSI_SHORT = (45.0, 75.0), 35.0
ROC_LONG, ROC_SHORT = 1.0, -1.0
MFI_SHORT, CCI_SHORT, STOCH_SHORT = 70.0, 100.0, 80.0
DONCHIAN_LEN = 20


def _f(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def earlier_signals(ind: DataFrame, w) -> DataFrame:
    """The earlier signal set (not registered in the current engine, kept as flags).
    ``ind`` is the laid-out indicator frame and ``w`` its canonical window (see indicator_table)."""
    c = F.col
    df = ind.withColumns({"_pm": F.lag("MACD").over(w), "_ps": F.lag("Signal").over(w),
                          "_dlow": F.min("low").over(w.rowsBetween(-(DONCHIAN_LEN - 1), 0)),
                          "_e200d": c("EMA_200") - F.lag("EMA_200").over(w)})
    return df.withColumns({
        "long_macd": _f((c("MACD") > c("Signal")) & (c("_pm") <= c("_ps")) & (c("MACD") > 0)),
        "short_macd": _f((c("MACD") < c("Signal")) & (c("_pm") >= c("_ps")) & (c("MACD") < 0)),
        "long_rsi": _f((c("RSI") > RSI_LONG[0]) & (c("RSI") < RSI_LONG[1])),
        "short_rsi": _f(c("RSI") < RSI_SHORT),
        "long_roc": _f(c("ROC") > ROC_LONG), "short_roc": _f(c("ROC") < ROC_SHORT),
        "short_mfi": _f(c("MFI") > MFI_SHORT), "short_cci": _f(c("CCI") > CCI_SHORT),
        "short_bb_rebound": _f(c("close") > c("BBM")),
        "short_donchian": _f(c("close") < c("_dlow")),
        "short_tema_cross": _f(c("TEMA_9") < c("TEMA_21")),
        "short_stochrsi": _f((c("StochRSI_K") > STOCH_SHORT) & (c("StochRSI_D") > STOCH_SHORT)),
        "ema200_down": _f(c("_e200d") < 0)}).drop("_pm", "_ps", "_dlow", "_e200d")


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Least values of the bins that cut each feature's rows into ``bins`` parts of equal number, ties together: the value of rank r
    (number of smaller ones) is in bin floor(r * bins / n). Exact, from counts per value: values are dealt by range over all tasks
    and counts are carried over the ranges, so no feature is one task. The result is at most bins values per feature."""
    spark = df.sparkSession
    stack = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    counts = df.selectExpr(f"stack({len(features)}, {stack}) AS (feature, x)").where("x IS NOT NULL AND NOT isnan(x)").groupBy("feature", "x").agg(F.count("*").alias("c"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written before they are dealt by range, as that looks at its input twice
    ranged = materialize(counts, "value-counts").repartitionByRange(tasks, "feature", "x").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "values-ranged")
    parts = ranged.groupBy("feature", "part").agg(F.sum("c").alias("pc"))  # a row per task and feature
    before = F.sum("pc").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).drop("pc")
    n = counts.groupBy("feature").agg(F.sum("c").alias("n"))
    here = F.sum("c").over(Window.partitionBy("feature", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ranged.withColumn("here", F.coalesce(here, F.lit(0))).join(parts, ["feature", "part"]).join(n, "feature")
    cut = ranks.groupBy("feature", F.floor((F.col("before") + F.col("here")) * bins / F.col("n")).alias("bin")).agg(F.min("x").alias("edge"))
    out: dict[str, list[float]] = {f: [] for f in features}
    for r in cut.orderBy("feature", "bin").collect():
        out[r["feature"]].append(r["edge"])
    return out


def binned(col: str, edges: list[float]) -> Column:
    """The number of edges at or below the value, from 0."""
    x = F.col(col).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1)


def mutual_information(df: DataFrame, features: list[str], target: str, min_importance: float = 0.0, bins: int = 16) -> DataFrame:
    """MI (nats) of each feature vs an integer target, rows with NULLs dropped, sorted desc (tie: name), kept when
    >= min_importance. Needs two classes, else an error. Float and double features are cut into ``bins`` quantile bins (the
    reference's nearest-neighbour estimate for them is replaced by binning: a stated difference), others are taken as they are.

    All totals are aggregates joined back; no window holds a feature."""
    kinds = dict(df.dtypes)
    df = df.select(*features, F.col(target).alias("_y")).dropna()
    wide = [f for f in features if kinds[f] in ("double", "float")]
    if wide:
        df = materialize(df, "features")
        edges = quantile_edges(df, wide, bins)
        df = df.withColumns({f: binned(f, edges[f]) for f in wide})
    d = df.select(*[F.col(f).cast("string").alias(f) for f in features], "_y").dropna()
    stack = ", ".join(f"'{f}', `{f}`" for f in features)
    long = d.selectExpr(f"stack({len(features)}, {stack}) AS (feature, x)", "_y")
    cxy = materialize(long.groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).alias("c")), "feature-counts")
    cx = cxy.groupBy("feature", "x").agg(F.sum("c").alias("cx"))
    cy = cxy.groupBy("feature", "_y").agg(F.sum("c").alias("cy"))
    n = cy.groupBy("feature").agg(F.sum("cy").alias("n"), F.count("*").alias("classes"))  # a row per class went in
    term = (F.col("c") / F.col("n")) * F.log((F.col("c") * F.col("n")) / (F.col("cx") * F.col("cy")))
    mi = (cxy.join(cx, ["feature", "x"]).join(cy, ["feature", "_y"]).join(n, "feature")
          .groupBy("feature").agg(F.sum(term).alias("importance"), F.max("classes").alias("classes")))
    mi = mi.withColumn("importance", F.when(F.col("classes") >= 2, F.col("importance"))
                       .otherwise(F.raise_error(F.lit("target needs at least two classes")).cast("double")))
    mi = mi.where(F.col("importance") >= min_importance).drop("classes")
    # a row per feature
    return mi.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def fingerprint(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Order-independent content fingerprint per key: row count + sum of the first 32 bits
    of each row's md5 (combinable, map-side partial aggregation; no group is collected)."""
    def txt(c):
        t = dict(df.dtypes)[c]
        return F.format_string("%.6f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string")
    row = F.md5(F.concat_ws("|", *[F.coalesce(txt(c), F.lit("\\N")) for c in cols]))
    h = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("hash_sum"))


def params_hash(params: DataFrame, names: list[str], key: str = "param_id") -> DataFrame:
    """md5 of the key-sorted JSON text of a parameter row, byte-identical to
    json.dumps(d, sort_keys=True) for numbers in plain notation and booleans."""
    def lit(c):
        t = dict(params.dtypes)[c]
        if t == "boolean":
            return F.when(F.col(c), "true").otherwise("false")
        return F.col(c).cast("string")
    pairs = [F.concat(F.lit(f'"{n}": '), lit(n)) for n in sorted(names)]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    return params.select(key, text.alias("params_json"), F.md5(text).alias("params_hash"))


def logged_params(params: Column, long_signals: Column, short_signals: Column) -> Column:
    """The JSON text of parameters for the log: ``params`` (map<string,string> of JSON scalars) with keys in order, numbers
    normalised (whole numbers without a fraction), and the enabled-signal lists attached (empty if NULL). NULL or empty in, {} out."""
    def number(v: Column) -> Column:
        x = v.try_cast("double")
        whole = x.isNotNull() & (F.abs(x) < 1e15) & (x == F.floor(x))
        text = F.when(v.isin("true", "false"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
        return F.when(v.isNull(), F.lit("null")).when(whole, F.format_string("%d", F.when(whole, x).otherwise(0.0).cast("long"))).when(x.isNotNull(), x.cast("string")).otherwise(text)

    def names(c: Column) -> Column:
        return F.to_json(F.coalesce(c, F.array().cast("array<string>")))

    lists = F.map_from_arrays(F.array(F.lit("enabled_long_signals"), F.lit("enabled_short_signals")), F.array(names(long_signals), names(short_signals)))
    plain = F.map_filter(params, lambda k, v: ~k.isin("enabled_long_signals", "enabled_short_signals"))
    every = F.map_concat(F.transform_values(plain, lambda k, v: number(v)), lists)
    pairs = F.transform(F.array_sort(F.map_entries(every)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return F.when(params.isNull() | (F.size(params) == 0), F.lit("{}")).otherwise(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
