import tempfile

from pyspark.sql import Window, functions as F

from conftest import SF
from kandle.plans.common import events_bars
from kandle.sources.tables import table
from kandle.streaming import live


def _dirs():
    base = tempfile.mkdtemp(prefix="kandle-stream-")
    return base.rsplit("/", 1)[-1], f"{base}/landing", f"{base}/store", f"{base}/signals"


def _drain(spark, dirs, **kw):
    name, landing, store, sig = dirs
    live.run_live(spark, landing, store, sig, name=name, **kw).awaitTermination(600)


def _signals(df):
    return {(r.symbol, r.ts): (r.close, r.long_entry, r.short_entry) for r in df.collect()}


def test_three_batches_equal_the_batch_job(spark):
    """Symbols days behind the others, bars that close after the start, a repeated message and a batch run
    again: store and flags end as the batch job's."""
    from kandle.operators.signals import signal_table, with_scores
    bars = events_bars(spark, SF).cache()
    dirs = _dirs()
    order = bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    late = F.col("symbol") == bars.first().symbol
    parts = [order.where(~late & (F.col("n") <= 60)), order.where(late & (F.col("n") <= 50)),
             order.where((~late & (F.col("n") > 60)) | (late & (F.col("n") > 45)))]  # 46-50 of the late one twice
    for p in parts:
        live.messages_from_bars(p.drop("n")).coalesce(1).write.mode("append").text(dirs[1])
        _drain(spark, dirs)
    want = live.parse_messages(live.messages_from_bars(bars))
    cols = ["symbol", "ts", "close"]

    def same():
        got = live.read_store(spark, dirs[2], want.schema)
        assert got.count() == bars.count()
        assert got.select(cols).exceptAll(want.select(cols)).count() == 0
        flags = spark.read.parquet(dirs[3])
        assert flags.count() == bars.count()
        # the last batch has seen all bars: its flags are the batch job's, row by row
        last = _signals(flags.where("batch_id = 2"))
        all_flags = _signals(with_scores(signal_table(want)).select("symbol", "ts", "close", "long_entry", "short_entry"))
        assert last and all(all_flags[k] == v for k, v in last.items())

    same()
    third = live.parse_messages(live.messages_from_bars(parts[2].drop("n")))
    live.live_batch(third, dirs[2], dirs[3], f"{dirs[3]}-carry", dirs[0], 2)  # the third batch once more
    same()


def test_live_path_skips_older_bars_and_refresh_adds_them(spark):
    bars = events_bars(spark, SF)
    dirs = _dirs()
    order = bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    msgs = [live.messages_from_bars(order.where(c).drop("n")) for c in ("n > 20 AND n <= 40", "n <= 41")]
    for m, history in ((msgs[0], False), (msgs[1], False)):
        m.coalesce(1).write.mode("append").text(dirs[1])
        _drain(spark, dirs, history=history)
    schema = live.parse_messages(msgs[0]).schema
    assert live.read_store(spark, dirs[2], schema).count() == 5 * 21  # 21..41
    live.merge_into_store(live.parse_messages(msgs[1]), dirs[2], "refresh", 0, history=True)
    got = live.read_store(spark, dirs[2], schema)
    assert got.count() == 5 * 41 == got.select("symbol", "ts").distinct().count()


def test_stream_bars_match_batch(spark):
    ev = table(spark, SF, "events")
    base = tempfile.mkdtemp(prefix="kandle-ticks-")
    ev.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("value").alias("qty")) \
      .withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{base}/ticks")
    ticks = spark.readStream.schema("symbol string, ts timestamp, price double, qty double").parquet(f"{base}/ticks")
    out = live.stream_bars(spark, ticks)
    q = out.writeStream.format("parquet").option("path", f"{base}/bars") \
        .option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(600)
    got = spark.read.parquet(f"{base}/bars")
    want = events_bars(spark, SF)
    # append mode emits a window once the watermark passes it: all bars that end an hour before the newest tick
    newest = ev.agg(F.max("ts")).first()[0]
    closed = want.where(F.col("ts") + F.expr("INTERVAL 30 MINUTES") <= F.lit(newest) - F.expr("INTERVAL 1 HOUR"))
    assert got.count() == closed.count() > 0
    diff = got.select("symbol", "ts", "open", "high", "low", "close").exceptAll(
        want.select("symbol", "ts", "open", "high", "low", "close"))
    assert diff.count() == 0


def test_carried_scores_equal_the_batch_job(spark, monkeypatch):
    """One series of 3,000 bars and a short one in uneven batches, the tail shorter than the history: flags are the batch job's,
    and a batch reads its carries only. A batch that runs again leaves the same."""
    from test_scan_layout import walk_bars
    from kandle.operators.signals import signal_table, with_scores
    from kandle.streaming import carry
    monkeypatch.setattr(carry, "TAIL", 2600)  # 1e-12 of the slowest weight
    bars = walk_bars(spark, 3000, seed=21).unionByName(walk_bars(spark, 150, seed=5, symbols=("B",))).cache()
    want = {(r.symbol, r.ts): (r.long_entry, r.short_entry) for r in with_scores(signal_table(bars)).collect()}
    order = bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    base = tempfile.mkdtemp(prefix="kandle-carry-")
    cuts = [0, 100, 2700, 2701, 2990, 3000]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = order.where(f"n > {a} AND n <= {b}").drop("n")
        batch = live.parse_messages(live.messages_from_bars(part))
        for _ in range(2 if i in (1, 3) else 1):  # some batches run twice
            live.live_batch(batch, f"{base}/store", f"{base}/signals", f"{base}/carry", "r", i)
    got = spark.read.parquet(f"{base}/signals").collect()
    assert len(got) == len(want) and {(r.symbol, r.ts): (r.long_entry, r.short_entry) for r in got} == want
    held, _ = carry.read(spark, f"{base}/carry", list(range(carry.BUCKETS)), "other", 0)
    assert {(r.symbol, r.n, len(r.tail)) for r in held.collect()} == {("A", 3000, 2600), ("B", 150, 150)}
    for b in range(carry.BUCKETS):  # old versions go
        assert len(carry._versions(spark, f"{base}/carry", b)) <= 2
    # once the carry is unfit (a refresh has put bars before stored ones) the series is taken from the store, once
    carry.forget(held.where("symbol = 'B'").select("symbol", "interval"), f"{base}/carry", "refresh", 0)
    more = walk_bars(spark, 170, seed=5, symbols=("B",)).cache()
    part = more.orderBy("ts").subtract(bars.where("symbol = 'B'").select(*more.columns))
    live.live_batch(live.parse_messages(live.messages_from_bars(part)), f"{base}/store", f"{base}/signals", f"{base}/carry", "r", 9)
    want = {r.ts: (r.long_entry, r.short_entry) for r in with_scores(signal_table(more)).collect()}
    got = spark.read.parquet(f"{base}/signals").where("batch_id = 9").collect()
    assert len(got) == 20 and all(want[r.ts] == (r.long_entry, r.short_entry) for r in got)
    held, _ = carry.read(spark, f"{base}/carry", list(range(carry.BUCKETS)), "other", 0)
    assert {(r.symbol, r.n) for r in held.collect()} == {("A", 3000), ("B", 170)}


def test_latest_candle_as_a_stream(spark):
    """Keyed state with output in update mode; the last row of each series is the batch job's, in messages of any order."""
    base = tempfile.mkdtemp(prefix="kandle-latest-")
    bars = events_bars(spark, SF)
    for i, part in enumerate(("pmod(xxhash64(ts_ms), 3) = 1", "pmod(xxhash64(ts_ms), 3) = 2", "pmod(xxhash64(ts_ms), 3) = 0")):
        live.messages_from_bars(bars.where(part)).coalesce(1).write.text(f"{base}/landing-{i}")
    import glob
    import shutil
    import os
    os.makedirs(f"{base}/landing")
    for i in range(3):
        for f in glob.glob(f"{base}/landing-{i}/*.txt"):
            shutil.copy(f, f"{base}/landing/{i}.txt")
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"{base}/landing")
    seen = []

    def each(batch, batch_id):
        seen.append({(r.symbol, r.interval): r.ts_ms for r in batch.collect()})

    q = live.latest_per_symbol(live.parse_messages(raw)).writeStream.outputMode("update").foreachBatch(each).option(
        "checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination(600)
    state = {}
    for s in seen:
        assert all(state.get(k, 0) <= v for k, v in s.items())
        state.update(s)
    want = live.latest_per_symbol(live.parse_messages(live.messages_from_bars(bars)))
    assert len(seen) == 3 and state == {(r.symbol, r.interval): r.ts_ms for r in want.collect()}


def test_compaction_keeps_every_row_once(spark):
    """A stream of ten files, a file a batch: the store stays at a few folders and its rows are the batch job's. A compaction that broke off
    behind the rename, or before it, changes nothing; the last batch may run again."""
    import os
    import shutil
    from kandle.streaming import compact as C
    bars = events_bars(spark, SF).cache()
    dirs = _dirs()
    name, landing, store, sig = dirs
    order = bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).cache()
    os.makedirs(landing)
    for i in range(10):
        part = order.where(f"n > {i * 20} AND n <= {i * 20 + 20}").drop("n")
        live.messages_from_bars(part).coalesce(1).write.text(f"{landing}-{i}")
        f = next(x for x in os.listdir(f"{landing}-{i}") if x.endswith(".txt"))
        shutil.copy(f"{landing}-{i}/{f}", f"{landing}/{i:02d}.txt")
        os.utime(f"{landing}/{i:02d}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    _drain(spark, dirs, files_per_batch=1, most_folders=3)
    want = live.parse_messages(live.messages_from_bars(bars))
    cols = ["symbol", "ts", "close"]

    def same():
        got = live.read_store(spark, store, want.schema).select(cols)
        assert got.count() == bars.count() and got.exceptAll(want.select(cols)).count() == 0

    same()
    assert len(C.folders(spark, store)) <= 4 and spark.read.parquet(sig).count() == bars.count()
    # broken off: an unfinished copy, and listed folders that are still there
    before = C.folders(spark, store)
    shutil.copytree(f"{store}/run={name}/batch_id=9", f"{store}/.compact-x")
    kept = {b: f"{store}-kept-{b[1]}-{b[0]}" for b in before if b[0] == name}
    for (r, n), to in kept.items():
        shutil.copytree(f"{store}/run={r}/batch_id={n}", to)
    new = order.where("n <= 1").drop("n").limit(0)
    live._write_batch(live.parse_messages(live.messages_from_bars(new)), store, name, 10)
    assert C.compact(spark, store, want.schema, most=1)
    same()
    for (r, n), to in kept.items():
        if n < 10:
            shutil.copytree(to, f"{store}/run={r}/batch_id={n}", dirs_exist_ok=True)
    same()  # listed folders do not count
    C.clean(spark, store)
    same()
    assert not [x for x in os.listdir(store) if x.startswith(".compact-")] and len(C.folders(spark, store)) == 2
    last = live.parse_messages(live.messages_from_bars(order.where("n > 180").drop("n")))
    live.live_batch(last, store, sig, f"{sig}-carry", "again", 0)  # known bars once more
    same()
