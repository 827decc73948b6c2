"""kandle: candle research analytics as Spark DataFrame jobs.

Sub-packages:
  sources    - bars from ticks, candle store scans/appends, run logs, landed payloads, sinks
  functions  - column expressions (risk, intervals, scans, null-safe flags)
  operators  - series layout, indicators, signals, trade replay, reports, tuning, walk-forward
  plans      - the registered queries (one per SURVEY id) and their DuckDB oracles
  streaming  - Structured Streaming jobs for live candles
"""
from kandle.session import get_spark, checkpoint_dir  # noqa: F401

KEYS = ("symbol", "interval")
