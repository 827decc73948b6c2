"""Run logs, trade logs, landed payloads and file sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from kandle.functions.intervals import interval_seconds, ntz_from_ms

RUN_REQUIRED = ["session_uuid", "symbol", "interval", "date", "params", "best_params", "balance", "loss", "pnl", "winrate",
                "risk_pct", "total_trades", "retrained", "triggered_restart"]
KLINE_FIELDS = ["start", "open", "high", "low", "close", "volume", "turnover"]


def kline_arrays(bars: DataFrame, batch: int = 1000) -> DataFrame:
    """The exchange's raw kline payload shape built from bars: one row per (symbol, batch of
    ``batch`` candles) holding array<array<string>>; groups are bounded by ``batch``."""
    # time-based batches: bars are unique per ts, so a batch never exceeds ``batch`` candles
    b = bars.withColumn("_b", F.floor(F.col("ts_ms") / (interval_seconds("interval") * 1000 * batch)))
    row = F.array(F.col("ts_ms").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")],
                  (F.col("close") * F.col("volume")).cast("string"))
    return b.groupBy("symbol", "interval", "_b").agg(F.collect_list(row).alias("list")).drop("_b")


def parse_klines(raw: DataFrame) -> DataFrame:
    """Explode raw arrays into typed candle rows (doubles, epoch ms, timestamp)."""
    e = raw.select("symbol", "interval", F.explode("list").alias("k"))
    cols = [F.element_at("k", i + 1) for i in range(len(KLINE_FIELDS))]
    out = e.select("symbol", "interval", cols[0].cast("bigint").alias("ts_ms"),
                   *[cols[i].cast("double").alias(KLINE_FIELDS[i]) for i in range(1, len(KLINE_FIELDS))])
    return out.withColumn("ts", ntz_from_ms(F.col("ts_ms")))


def validate_run_log(runs: DataFrame) -> DataFrame:
    """S06 check: every required column present and non-null, else ValueError before writing."""
    missing = [c for c in RUN_REQUIRED if c not in runs.columns]
    if missing:
        raise ValueError(f"missing required run-log columns: {missing}")
    nulls = runs.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in RUN_REQUIRED]).first()
    bad = [c for c in RUN_REQUIRED if nulls[c]]
    if bad:
        raise ValueError(f"null values in required run-log columns: {bad}")
    return runs


TRADE_FIELDS = ["session_uuid", "symbol", "timestamp", "action", "side", "price", "qty"]


def save_model_runs(runs: DataFrame, trades: DataFrame | None, path: str) -> None:
    """Run rows and their trade rows, a folder per session in each table.

    A session is replaced as a whole: writing it again leaves it as it is, other sessions stay. Trades are written first, so a run
    row is never there without them; ``params`` and ``trades`` of a run may be nested."""
    checked = validate_run_log(runs)
    if trades is not None:
        trades.select(*TRADE_FIELDS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_uuid").parquet(f"{path}/trade_logs")
    checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_uuid").parquet(f"{path}/model_runs")


def load_runs_with_trades(spark: SparkSession, path: str) -> DataFrame:
    """The run rows of a folder with their trades as one list in time order (no more than a window has bars, twice). Trades are found by
    session, symbol and the run's window (J03)."""
    from kandle.operators.interval_join import run_trades
    runs = spark.read.parquet(f"{path}/model_runs")
    runs = runs.withColumn("session_uuid", F.col("session_uuid").cast("string"))
    trades = spark.read.parquet(f"{path}/trade_logs")
    trades = trades.withColumn("session_uuid", F.col("session_uuid").cast("string"))
    key = ["session_uuid", "symbol", "window_start"]
    hit = run_trades(runs.select(*key, "window_end"), trades)
    # a trade that opens on a window's last bar is closed on it; another one never opens where one was closed
    one = F.struct("timestamp", (~F.col("action").startswith("OPEN")).cast("int").alias("closes"), "action", "side", "price", "qty")
    lists = hit.groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("trades"))
    return runs.join(lists, key, "left").withColumn("trades", F.coalesce("trades", F.array().cast(lists.schema["trades"].dataType)))


def load_model_runs(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """best_params JSON flattened to columns (invalid JSON -> empty), sorted by date."""
    m = F.coalesce(F.from_json("best_params", T.MapType(T.StringType(), T.StringType())),
                   F.create_map().cast("map<string,string>"))
    df = runs.withColumn("_p", m)
    for k in keys or []:
        df = df.withColumn(f"param_{k}", F.col("_p")[k])
    return df.drop("_p").orderBy("date")


def losing_days(runs: DataFrame) -> DataFrame:
    """Pnl < 0 and winrate < 0.5."""
    return runs.where((F.col("pnl") < 0) & (F.col("winrate") < 0.5))


def write_trades_csv(trades: DataFrame, path: str) -> None:
    """Trades CSV per symbol (partitioned folders); only the symbols written are replaced."""
    trades.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").option("header", True).csv(path)


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """The trade log of S08; lines that are no rows of the log (broken files) are left out."""
    kinds = "timestamp timestamp_ntz, action string, price double, pnl double, symbol string"
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(kinds).csv(path)


def write_equity_csv(equity: DataFrame, path: str) -> None:
    """Equity log (timestamp, balance)."""
    equity.write.mode("overwrite").option("header", True).csv(path)


def symbols_from_config(spark: SparkSession, path: str) -> DataFrame:
    """The symbol list of a JSON config {"symbols": [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("symbols").alias("symbol"))


def symbols_from_tickers(raw: DataFrame, col: str = "body") -> DataFrame:
    """Symbols of landed ticker responses with retCode = 0."""
    schema = "retCode int, result struct<list: array<struct<symbol: string>>>"
    p = raw.select(F.from_json(col, schema).alias("r")).where(F.col("r.retCode") == 0)
    return p.select(F.explode("r.result.list").alias("t")).select(F.col("t.symbol").alias("symbol"))


def best_params_files(spark: SparkSession, glob: str) -> DataFrame:
    """Best-params JSON files, symbol taken from the file name (<symbol>.json)."""
    df = spark.read.option("multiLine", True).json(glob)
    return df.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
