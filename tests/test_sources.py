import datetime
import json
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF
from kandle.plans.common import events_bars
from kandle.sources import runs as SR
from kandle.sources import bars as SB


def _run_row(spark, **over):
    row = dict(session_uuid="u1", symbol="BTC", interval="30", date="2024-01-01", params="{}", best_params='{"k": 1}',
               balance=1000.0, loss=-0.5, pnl=1.0, winrate=0.5, risk_pct=0.05, total_trades=3, retrained=False,
               triggered_restart=False)
    row.update(over)
    return spark.createDataFrame([row])


def test_run_log_roundtrip_and_required_columns(spark):
    base = tempfile.mkdtemp(prefix="kandle-runs-")
    runs = _run_row(spark)
    trades = spark.createDataFrame([dict(session_uuid="u1", symbol="BTC", timestamp=datetime.datetime(2024, 1, 1), action="OPEN LONG", side="long",
                                         price=1.0, qty=1.0)])
    SR.save_model_runs(runs, trades, base)
    back = spark.read.parquet(f"{base}/model_runs")
    assert back.count() == 1 and back.first().symbol == "BTC"
    for name in ("pnl", "params"):  # params: required there, too
        with pytest.raises(ValueError):
            SR.validate_run_log(runs.drop(name))
    with pytest.raises(ValueError):
        SR.validate_run_log(_run_row(spark, symbol=None))


def test_load_model_runs_invalid_json_is_empty(spark):
    df = spark.createDataFrame([("u", "2024-01-02", '{"k": "7"}'), ("u", "2024-01-01", "not json")],
                               "session_uuid string, date string, best_params string")
    out = SR.load_model_runs(df, ["k"]).collect()
    assert [r.date for r in out] == ["2024-01-01", "2024-01-02"]
    assert out[0].param_k is None and out[1].param_k == "7"


def test_csv_sinks_and_config_sources(spark):
    base = tempfile.mkdtemp(prefix="kandle-sinks-")
    bars = events_bars(spark, SF)
    SR.write_trades_csv(bars.select("symbol", "ts", "close"), f"{base}/trades")
    assert sorted(os.listdir(f"{base}/trades"))[0].startswith("_SUCCESS") or any(
        d.startswith("symbol=") for d in os.listdir(f"{base}/trades"))
    SR.write_equity_csv(bars.select(F.col("ts").alias("timestamp"), F.col("close").alias("balance")), f"{base}/equity")
    assert spark.read.option("header", True).csv(f"{base}/equity").count() == bars.count()
    with open(f"{base}/config.json", "w") as f:
        json.dump({"symbols": ["BTCUSDT", "ETHUSDT"]}, f)
    assert [r.symbol for r in SR.symbols_from_config(spark, f"{base}/config.json").collect()] == ["BTCUSDT", "ETHUSDT"]
    os.makedirs(f"{base}/best")
    for s, t in (("BTCUSDT", 3), ("ETHUSDT", 4)):
        with open(f"{base}/best/{s}.json", "w") as f:
            json.dump({"long_score_threshold": t}, f)
    got = {r.symbol: r.long_score_threshold for r in SR.best_params_files(spark, f"{base}/best/*.json").collect()}
    assert got == {"BTCUSDT": 3, "ETHUSDT": 4}


def test_tickers_keep_ret_code_zero(spark):
    raw = spark.createDataFrame([('{"retCode": 0, "result": {"list": [{"symbol": "A"}, {"symbol": "B"}]}}',),
                                 ('{"retCode": 10001, "result": {"list": [{"symbol": "C"}]}}',)], "body string")
    assert sorted(r.symbol for r in SR.symbols_from_tickers(raw).collect()) == ["A", "B"]


def test_append_new_is_idempotent(spark):
    bars = events_bars(spark, SF)
    new = SB.append_new(bars, bars.union(bars))
    assert new.count() == 0
    assert SB.append_new(bars.limit(0), bars.union(bars)).count() == bars.count()


def test_registry_imports_without_spark():
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)),
                         capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
