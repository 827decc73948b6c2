"""Live candles with Structured Streaming.

The same DataFrame functions run on a batch DataFrame and on a streaming one; the stream jobs
add a source, a watermark, state and a sink. Message sources are a landing folder of JSON files
in tests (Kafka for users: the value column carries the same JSON).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kandle.functions.intervals import epoch_ms, interval_seconds, ntz_from_ms
from kandle.session import checkpoint_dir
from kandle.sources.bars import append_new, bars_from_ticks
from kandle.sources.scratch import materialize
from kandle.streaming.compact import compact, without_merged

CANDLE_FIELDS = ["start", "open", "high", "low", "close", "volume", "turnover"]
MESSAGE_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("data", T.ArrayType(T.StructType(
        [T.StructField(f, T.StringType()) for f in CANDLE_FIELDS] + [T.StructField("confirm", T.BooleanType())])))])
LIVE_TYPES = ("snapshot", "delta")


def messages_from_bars(bars: DataFrame) -> DataFrame:
    """Test feed: one confirmed-candle message per bar (topic kline.<interval>.<symbol>)."""
    item = F.struct(F.col("ts_ms").cast("string").alias("start"),
                    *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")],
                    (F.col("close") * F.col("volume")).cast("string").alias("turnover"), F.lit(True).alias("confirm"))
    return bars.select(F.to_json(F.struct(F.concat(F.lit("kline."), F.col("interval"), F.lit("."), F.col("symbol")).alias("topic"),
                                          F.lit("snapshot").alias("type"), F.array(item).alias("data"))).alias("value"))


def parse_messages(raw: DataFrame, col: str = "value") -> DataFrame:
    """Envelope type in (snapshot, delta), explode data, keep confirmed candles only."""
    m = raw.select(F.from_json(F.col(col), MESSAGE_SCHEMA).alias("m"))
    m = m.where(F.col("m.type").isin(*LIVE_TYPES))
    parts = F.split(F.col("m.topic"), r"\.")
    e = m.select(F.element_at(parts, 3).alias("symbol"), F.element_at(parts, 2).alias("interval"),
                 F.explode("m.data").alias("d")).where(F.col("d.confirm"))
    out = e.select("symbol", "interval", F.col("d.start").cast("bigint").alias("ts_ms"),
                   *[F.col(f"d.{c}").cast("double").alias(c) for c in CANDLE_FIELDS[1:]])
    return out.withColumn("ts", ntz_from_ms(F.col("ts_ms")))


def latest_per_symbol(candles: DataFrame) -> DataFrame:
    """Latest candle per (symbol, interval); streaming-safe (update mode)."""
    cols = [c for c in candles.columns if c not in ("symbol", "interval")]
    g = candles.groupBy("symbol", "interval").agg(F.max_by(F.struct(*cols), "ts_ms").alias("c"))
    return g.select("symbol", "interval", "c.*")


def closed_only(candles: DataFrame, now_ms: int) -> DataFrame:
    """D03 guard for feeds without a confirm flag: a bar is closed when now >= start + interval."""
    return candles.where(F.lit(now_ms) >= F.col("ts_ms") + interval_seconds("interval") * 1000)


def live_rows(stored: DataFrame, batch: DataFrame, keys=("symbol", "interval")) -> DataFrame:
    """The rows of ``batch`` to add: later than their series' last stored bar, one per key (of equal keys
    the greatest row). Older bars are not the live path's: they come with the history refresh (D05)."""
    return _later(stored.groupBy(*keys).agg(F.max("ts_ms").alias("_last")), batch, keys)


def _later(last: DataFrame, batch: DataFrame, keys=("symbol", "interval")) -> DataFrame:
    """``live_rows`` by a table of the series' last bars (``_last``)."""
    rest = [c for c in batch.columns if c not in (*keys, "ts")]
    one = batch.groupBy(*keys, "ts").agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "ts", "_r.*").select(*batch.columns)
    return one.join(last, list(keys), "left").where(F.col("_last").isNull() | (F.col("ts_ms") > F.col("_last"))).drop("_last")


# The store is a folder of runs and their micro-batches: <store>/run=<name>/batch_id=<n>. A batch owns its
# folder, so a batch that is run again replaces its own rows and nothing else.

def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_store(spark: SparkSession, path: str, schema: T.StructType, without: tuple | None = None) -> DataFrame:
    """Stored candles (none if there is no store yet); ``without``: (run, batch_id) to leave out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    full = T.StructType(list(schema.fields) + [T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
    df = without_merged(spark.read.schema(full).parquet(path), path)
    if without is not None:
        df = df.where((F.col("run") != without[0]) | (F.col("batch_id") != without[1]))
    return df.select(*schema.names)


def _write_batch(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def merge_into_store(batch: DataFrame, store_path: str, run: str, batch_id: int, history: bool = False) -> DataFrame:
    """Add the batch's new candles to the store; returns them. ``history``: a refresh, which
    adds every key not stored yet (S03), older ones too. Run again, a batch sees the store without itself."""
    spark = batch.sparkSession
    stored = read_store(spark, store_path, batch.schema, (run, batch_id))
    rows = append_new(stored, batch) if history else live_rows(stored, batch)
    _write_batch(rows, store_path, run, batch_id)
    return spark.read.schema(batch.schema).parquet(f"{store_path}/run={run}/batch_id={batch_id}")


SIGNAL_COLS = ["symbol", "interval", "ts", "close", "long_score", "short_score", "long_entry", "short_entry"]


def rescore_touched(new: DataFrame, store_path: str, out_path: str, run: str, batch_id: int) -> None:
    """D04 over the whole history: entry flags of the new bars, their series scored over all they have stored. The way to score bars
    that stand before stored ones (a history refresh); series without a new bar are not read."""
    from kandle.operators.signals import signal_table, with_scores
    spark = new.sparkSession
    touched = new.select("symbol", "interval").distinct()
    store = read_store(spark, store_path, new.schema).join(F.broadcast(touched) if touched.count() <= 10_000 else touched, ["symbol", "interval"], "left_semi")
    scored = with_scores(signal_table(store)).select(*SIGNAL_COLS)
    _write_batch(scored.join(new.select("symbol", "interval", "ts"), ["symbol", "interval", "ts"], "left_semi"), out_path, run, batch_id)


def live_batch(batch: DataFrame, store_path: str, out_path: str, carry_path: str, run: str, batch_id: int) -> DataFrame:
    """D03 + D04 of one micro-batch: its new candles go to the store, their entry flags to ``out_path``; returns the new candles.

    What is read is the batch and the carries of the buckets it touches (``kandle.streaming.carry``), which also know each series'
    last bar. Only series without a carry (new ones, or after a history refresh) are looked up in the store, whole, once."""
    from kandle.streaming import carry as C
    spark = batch.sparkSession
    keys = ["symbol", "interval"]
    touched = materialize(batch.select(*keys).distinct().withColumn("_b", C._bucket()), "touched")
    buckets = [r[0] for r in touched.select("_b").distinct().collect()]  # at most C.BUCKETS
    held, numbers = C.read(spark, carry_path, buckets, run, batch_id)
    bare = touched.select(*keys).join(held.select(*keys), keys, "left_anti")
    last = held.select(*keys, F.element_at("tail", -1)["ts_ms"].alias("_last"))
    past = spark.createDataFrame([], batch.schema)
    if not bare.isEmpty():
        past = materialize(read_store(spark, store_path, batch.schema, (run, batch_id)).join(bare, keys, "left_semi"), "past")
        last = last.unionByName(past.groupBy(*keys).agg(F.max("ts_ms").alias("_last")))
    _write_batch(_later(last, batch), store_path, run, batch_id)
    new = spark.read.schema(batch.schema).parquet(f"{store_path}/run={run}/batch_id={batch_id}")
    if not new.isEmpty():
        scored, after = C.score(new.unionByName(past.join(new.select(*keys).distinct(), keys, "left_semi")), held)
        C.write(after, carry_path, numbers, run, batch_id)
        _write_batch(scored.select(*SIGNAL_COLS).join(new.select(*keys, "ts"), [*keys, "ts"], "left_semi"), out_path, run, batch_id)
    return new


def stream_messages(spark: SparkSession, landing: str) -> DataFrame:
    """File source of message lines (one JSON message per line)."""
    return spark.readStream.format("text").load(landing)


def run_live(spark: SparkSession, landing: str, store_path: str, signals_path: str, available_now: bool = True,
             name: str = "live", history: bool = False, files_per_batch: int | None = None, most_folders: int = 64):
    """D01 + D03 + D04 (+ D05 with ``history``): parse -> foreachBatch merge into the store and score. A store of more than
    ``most_folders`` batches is compacted.

    No watermark and no clock: a confirmed candle is closed whenever it arrives, duplicates meet the store
    itself, and a series that lags behind the others loses nothing. Trigger.AvailableNow drains the
    landing folder (periodic refresh); processingTime for a running service."""
    raw = stream_messages(spark, landing) if files_per_batch is None else (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(landing))

    carry_path = f"{signals_path}-carry"

    def each(batch: DataFrame, batch_id: int) -> None:
        compact(spark, store_path, batch.schema, most_folders)
        if not history:
            live_batch(batch, store_path, signals_path, carry_path, name, batch_id)
            return
        from kandle.streaming import carry
        new = merge_into_store(batch, store_path, name, batch_id, True)
        if not new.isEmpty():
            carry.forget(new.select("symbol", "interval").distinct(), carry_path, name, batch_id)
            rescore_touched(new, store_path, signals_path, name, batch_id)

    w = parse_messages(raw).writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint_dir(spark)}/stream-{name}")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_bars(spark: SparkSession, ticks: DataFrame, interval: str = "30", watermark: str = "1 hour") -> DataFrame:
    """Tumbling OHLCV bars from a tick stream (append mode emits a bar once the watermark has passed it;
    ``watermark`` is how late a tick may come, later ones are dropped). On a batch DataFrame: all bars."""
    if not interval.isdigit():
        raise ValueError("stream_bars takes intervals in minutes")
    sec = int(interval) * 60
    t = ticks.withWatermark("ts", watermark)
    g = t.groupBy("symbol", F.window("ts", f"{sec} seconds")).agg(
        F.min(F.struct("ts", "price"))["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(F.struct("ts", "price"))["price"].alias("close"), F.sum("qty").alias("volume"))
    return g.select("symbol", F.lit(interval).alias("interval"), F.col("window.start").cast("timestamp_ntz").alias("ts"),
                    epoch_ms(F.col("window.start").cast("timestamp_ntz")).alias("ts_ms"), "open", "high", "low", "close", "volume")
