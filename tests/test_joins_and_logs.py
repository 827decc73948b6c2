import json
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kandle.operators import reports as R
from kandle.operators.interval_join import interval_join, run_trades
from kandle.sources import bars as SB, runs as SR
from test_scan_layout import walk_bars


@pytest.mark.parametrize("width", [None, 1, 7, 10 ** 6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_equals_all_pairs(spark, width, how):
    rng = random.Random(5)
    points = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(-40, 60)]), i) for i in range(300)]
    ranges = []
    for i in range(60):
        lo = rng.choice([None, *range(-50, 60)])
        ranges.append((rng.choice(["hot", "b", "none", None]), lo, None if lo is None else lo + rng.choice([-3, 0, 1, 5, 30]), i))
    ranges.append(("hot", -1000, 1000, 99))  # one range over everything
    p = spark.createDataFrame(points, "k string, at long, pid int").repartition(3)
    r = spark.createDataFrame(ranges, "k string, lo long, hi long, rid int")
    got = interval_join(p, r, ["k"], F.col("at"), F.col("lo"), F.col("hi"), width, how).select("pid", "rid").collect()
    want = [(x[2], y[3]) for x in points for y in ranges
            if x[0] is not None and x[0] == y[0] and None not in (x[1], y[1], y[2]) and y[1] <= x[1] <= y[2]]
    if how == "left":
        hit = {b for _, b in want}
        want += [(None, y[3]) for y in ranges if y[3] not in hit]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert interval_join(p.limit(0), r, ["k"], F.col("at"), F.col("lo"), F.col("hi"), width).collect() == []
    with pytest.raises(ValueError):
        interval_join(p.withColumn("lo", F.lit(1)), r, ["k"], F.col("at"), F.col("lo"), F.col("hi"), width)


def test_a_hot_key_is_many_tasks(spark):
    """All points and ranges of one key: the join's partitions share them."""
    p = spark.range(20000).select(F.lit("A").alias("k"), F.col("id").alias("at"))
    r = spark.range(400).select(F.lit("A").alias("k"), (F.col("id") * 50).alias("lo"), (F.col("id") * 50 + 20).alias("hi"))
    j = interval_join(p.repartition(8), r.repartition(8), ["k"], F.col("at"), F.col("lo"), F.col("hi"))
    assert "bin" in j._jdf.queryExecution().toString() and j.count() == 400 * 21


def test_range_requests_are_inclusive(spark):
    bars = walk_bars(spark, 200, symbols=("A", "B"))
    t0, step = 1704067200000, 1800000
    req = spark.createDataFrame([("A", "30", t0, t0 + 10 * step, 1), ("A", "30", t0 + 5 * step, t0 + 5 * step, 2), ("B", "30", t0 - 9, t0 - 1, 3)],
                                "symbol string, interval string, start_ms long, end_ms long, req long")
    got = SB.scan_requests(bars, req)
    assert got.columns == bars.columns + ["start_ms", "end_ms", "req"]
    assert {r["req"]: r["count"] for r in got.groupBy("req").count().collect()} == {1: 11, 2: 1}


def test_quantile_bins(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1.0, 1.0, 1.0, rng.gauss(0, 1)]), float(i % 7), None if i % 50 == 0 else rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "tied double, few double, holes double").repartition(6)
    edges = R.quantile_edges(df, ["tied", "few", "holes"], 10)
    for at, name in enumerate(("tied", "few", "holes")):
        values = np.sort([r[at] for r in rows if r[at] is not None])
        rank = np.searchsorted(values, values, side="left")
        want = rank * 10 // len(values)
        got = [r["b"] for r in df.select(R.binned(name, edges[name]).alias("b"), name).where(f"{name} IS NOT NULL").orderBy(name).collect()]
        # the same cuts, numbered without the empty bins
        assert np.array_equal(np.unique(want, return_inverse=True)[1], got)
    assert df.where("holes IS NULL").select(R.binned("holes", edges["holes"]).alias("b")).distinct().collect() == [(None,)]


def test_relevance_of_continuous_features(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        y = rng.random() < 0.5
        rows.append((rng.gauss(2 if y else 0, 1), rng.gauss(0, 1), int(y), int(y)))
    df = spark.createDataFrame(rows, "signal double, noise double, leak int, y int")
    got = {r["feature"]: (r["importance"], r["rank"]) for r in R.mutual_information(df, ["signal", "noise", "leak"], "y").collect()}
    assert got["leak"][1] == 1 and abs(got["leak"][0] - np.log(2)) < 1e-3
    assert 0.25 < got["signal"][0] < 0.45 and got["noise"][0] < 0.01 and got["noise"][1] == 3
    assert {r["feature"] for r in R.mutual_information(df, ["signal", "noise"], "y", min_importance=0.1).collect()} == {"signal"}
    with pytest.raises(Exception, match="two classes"):
        R.mutual_information(df.withColumn("y", F.lit(1)), ["signal"], "y").collect()


def run_rows(spark, balance):
    cols = {c: F.lit("x") for c in SR.RUN_REQUIRED}
    rows = spark.createDataFrame([("s1", "A", 0, 10), ("s1", "A", 11, 20), ("s1", "B", 0, 20), ("s2", "A", 0, 20)], "session_uuid string, symbol string, a int, b int")
    t = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    return rows.withColumns({k: v for k, v in cols.items() if k not in ("session_uuid", "symbol")}).withColumns(
        {"balance": F.lit(balance), "window_start": t("a"), "window_end": t("b")}).drop("a", "b")


def test_run_log_is_replaced_as_a_whole_and_read_back(spark):
    path = tempfile.mkdtemp(prefix="kandle-runs-") + "/log"
    trades = spark.createDataFrame([("s1", "A", s, a, "long", 1.0, 2.0) for s, a in ((3, "OPEN LONG"), (10, "AUTO SELL"), (10, "OPEN LONG"), (11, "OPEN LONG"), (20, "SL CLOSE LONG"))]
                                   + [("s2", "A", 20, "OPEN LONG", "long", 1.0, 2.0)], "session_uuid string, symbol string, s int, action string, side string, price double, qty double")
    trades = trades.withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    for balance in (1.0, 2.0):
        SR.save_model_runs(run_rows(spark, balance), trades, path)
    SR.save_model_runs(run_rows(spark, 3.0).where("session_uuid = 's2'"), trades.where("session_uuid = 's2'").limit(0), path)  # trades of s2 stay: none written
    back = {(r["session_uuid"], r["symbol"], r["window_start"].second): r for r in SR.load_runs_with_trades(spark, path).collect()}
    assert len(back) == 4 and [back[k]["balance"] for k in sorted(back)] == [2.0, 2.0, 2.0, 3.0]
    assert [t["action"] for t in back["s1", "A", 0]["trades"]] == ["OPEN LONG", "OPEN LONG", "AUTO SELL"]
    assert [t["action"] for t in back["s1", "A", 11]["trades"]] == ["OPEN LONG", "SL CLOSE LONG"]
    assert back["s1", "B", 0]["trades"] == [] and len(back["s2", "A", 0]["trades"]) == 1
    with pytest.raises(ValueError, match="params"):
        SR.save_model_runs(run_rows(spark, 1.0).drop("params"), None, path)
    with pytest.raises(ValueError, match="null"):
        SR.save_model_runs(run_rows(spark, 1.0).withColumn("date", F.lit(None).cast("string")), None, path)
    assert run_trades(run_rows(spark, 1.0), trades).count() == 6


def test_logged_params(spark):
    rows = [({"b": "2.0", "a": "0.25", "on": "true", "name": "x", "none": None}, ["l"], ["s", "t"]), ({"k": "1e3"}, None, None), ({}, ["l"], []), (None, None, None),
            ({"enabled_long_signals": "old", "z": "-7.00"}, ["new"], None)]
    df = spark.createDataFrame(rows, "p map<string,string>, l array<string>, s array<string>")
    got = [json.loads(r[0]) for r in df.select(R.logged_params(F.col("p"), F.col("l"), F.col("s"))).collect()]
    assert got == [{"a": 0.25, "b": 2, "on": True, "name": "x", "none": None, "enabled_long_signals": ["l"], "enabled_short_signals": ["s", "t"]},
                   {"k": 1000, "enabled_long_signals": [], "enabled_short_signals": []}, {}, {}, {"z": -7, "enabled_long_signals": ["new"], "enabled_short_signals": []}]


def test_broken_files(spark):
    """S08, S10-S12 with files that hold no rows of their kind."""
    base = tempfile.mkdtemp(prefix="kandle-files-")
    legs = spark.createDataFrame([("A", "2024-01-01 00:30:00", "OPEN LONG", 1.5, 0.0), ("B", "2024-01-01 00:30:00", "AUTO SELL", 2.5, -1.0)],
                                 "symbol string, timestamp string, action string, price double, pnl double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    SR.write_trades_csv(legs, f"{base}/csv")
    SR.write_trades_csv(legs.where("symbol = 'A'"), f"{base}/csv")  # B stays
    with open(f"{base}/csv/symbol=A/broken.csv", "w") as f:
        f.write("timestamp,action,price,pnl\nnever,OPEN LONG,x,y\n")
    assert sorted((r["symbol"], r["price"]) for r in SR.read_trades_csv(spark, f"{base}/csv").collect()) == [("A", 1.5), ("B", 2.5)]
    raw = spark.createDataFrame([('{"retCode": 0, "result": {"list": [{"symbol": "X"}, {"symbol": "Y"}]}}',), ('{"retCode": 10001}',), ("<html>",), (None,)], "body string")
    assert [r[0] for r in SR.symbols_from_tickers(raw).collect()] == ["X", "Y"]
    for name, text in (("A", '{"w_rsi": 1.5}'), ("B", '{"w_rsi": 2}')):
        with open(f"{base}/{name}.json", "w") as f:
            f.write(text)
    assert {(r["symbol"], r["w_rsi"]) for r in SR.best_params_files(spark, f"{base}/*.json").collect()} == {("A", 1.5), ("B", 2.0)}
    with open(f"{base}/config.txt", "w") as f:
        f.write(json.dumps({"symbols": ["P", "Q"], "interval": "30"}))
    assert [r[0] for r in SR.symbols_from_config(spark, f"{base}/config.txt").collect()] == ["P", "Q"]


def test_training_update_and_base_columns(spark):
    from kandle.operators.signals import signal_table
    from kandle.operators.walkforward import update_training
    bars = walk_bars(spark, 60, symbols=("A", "B"))
    sig = signal_table(bars)
    train = sig.where("rn < 40 OR symbol = 'B'")
    test = sig.where("symbol = 'A' AND rn >= 30 AND rn < 50")
    got = update_training(train, test)
    assert got.columns == ["symbol", "interval", "ts", "ts_ms", "open", "high", "low", "close", "volume"]
    assert {r["symbol"]: r["count"] for r in got.groupBy("symbol").count().collect()} == {"A": 50, "B": 60}
    assert got.dropDuplicates(["symbol", "ts"]).count() == 110


def test_a_signal_of_ones_own(spark):
    """a registered signal becomes a flag and counts in the score."""
    from kandle.operators import signals as S
    bars = walk_bars(spark, 80)
    try:
        S.register_signal("green", long=True)(lambda: S.flag(F.col("close") > F.col("open")))
        df = S.with_scores(S.signal_table(bars), {"enabled_long_signals": ["green"], "enabled_short_signals": [], "w_green": 3, "long_score_threshold": 3})
        rows = df.select("open", "close", "long_green", "long_score", "long_entry").collect()
        assert all(r["long_green"] == int(r["close"] > r["open"]) and r["long_score"] == 3 * r["long_green"] and r["long_entry"] == bool(r["long_green"]) for r in rows)
    finally:
        del S.LONG_SIGNALS["green"]
