"""Registered queries: candle store operations, row functions, integrity, set operations, reports."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from kandle.functions.intervals import interval_seconds
from kandle.functions.risk import dynamic_tp_sl, inverse_balance_risk, position_size, should_update
from kandle.operators.indicators import indicator_table
from kandle.operators.quality import gaps, integrity
from kandle.plans.common import BARS_SQL, events_bars, rounded
from kandle.plans.oracle_ind import indicator_sql
from kandle.plans.queries import query
from kandle.sources import bars as SB
from kandle.sources import runs as SR
from kandle.sources.tables import table

K = ["symbol", "interval"]
W = 'PARTITION BY symbol, "interval" ORDER BY ts'
D0, D1 = 1704412800000, 1705708800000          # 2024-01-05, 2024-01-20 (epoch ms)
NOW_MS = 1709251200000                           # 2024-03-01: the "now" parameter of freshness checks


@query("s01_candle_scan", f"""WITH {BARS_SQL} SELECT * FROM bars
  WHERE symbol = 'click' AND "interval" = '30' AND ts_ms BETWEEN {D0} AND {D1}""")
def s01_candle_scan(spark, sf_dir):
    return rounded(SB.scan_candles(events_bars(spark, sf_dir), "click", "30", D0, D1))


@query("j02_range_requests", f"""WITH {BARS_SQL},
req AS (SELECT symbol, "interval", min(ts_ms) + 86400000 AS start_ms, min(ts_ms) + 3*86400000 AS end_ms FROM bars GROUP BY ALL)
SELECT b.*, r.start_ms, r.end_ms FROM bars b JOIN req r ON b.symbol = r.symbol AND b."interval" = r."interval"
  AND b.ts_ms BETWEEN r.start_ms AND r.end_ms""")
def j02_range_requests(spark, sf_dir):
    """S01 batch form / J02: a request table (derived per series) range-joined, both ends inclusive."""
    b = events_bars(spark, sf_dir)
    req = b.groupBy(*K).agg((F.min("ts_ms") + 86400000).alias("start_ms"), (F.min("ts_ms") + 3 * 86400000).alias("end_ms"))
    return rounded(SB.scan_requests(b, req))


@query("t01_first_n", f"WITH {BARS_SQL} SELECT * FROM bars QUALIFY row_number() OVER ({W}) <= 100")
def t01_first_n(spark, sf_dir):
    return rounded(SB.first_n(events_bars(spark, sf_dir), 100))


@query("t02_last_n", f'WITH {BARS_SQL} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, "interval" ORDER BY ts DESC) <= 49')
def t02_last_n(spark, sf_dir):
    return rounded(SB.last_n(events_bars(spark, sf_dir), 49))


@query("s03_append_new", f"""WITH {BARS_SQL} SELECT * FROM bars b WHERE ts_ms >= {D0 + 10 * 86400000}
  AND NOT EXISTS (SELECT 1 FROM bars e WHERE e.ts_ms < {D1} AND e.symbol = b.symbol AND e."interval" = b."interval" AND e.ts = b.ts)""")
def s03_append_new(spark, sf_dir):
    """Rows of a new batch (bars from Jan 15 on) not yet stored (store = bars before Jan 20)."""
    b = events_bars(spark, sf_dir)
    existing = b.where(F.col("ts_ms") < D1)
    batch = b.where(F.col("ts_ms") >= D0 + 10 * 86400000)
    return rounded(SB.append_new(existing, batch))


@query("s04_latest_ts", f"""WITH {BARS_SQL}, s AS (SELECT DISTINCT event_type AS symbol, i AS "interval"
  FROM events, (VALUES ('30'), ('60')) v(i))
SELECT s.symbol, s."interval", CAST(coalesce(max(b.ts_ms), 0) AS BIGINT) AS latest_ms
FROM s LEFT JOIN bars b ON b.symbol = s.symbol AND b."interval" = s."interval" GROUP BY ALL""")
def s04_latest_ts(spark, sf_dir):
    """Latest stored ts per requested series (every event type x intervals 30/60), 0 if none."""
    b = events_bars(spark, sf_dir)
    ser = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct() \
        .crossJoin(spark.createDataFrame([("30",), ("60",)], "interval string"))
    return SB.latest_ts(b, ser)


@query("s05_first_candle", f"""WITH {BARS_SQL} SELECT symbol, "interval", arg_min(ts, ts) AS ts, arg_min(ts_ms, ts) AS ts_ms,
  round(arg_min(open, ts), 6) AS open, round(arg_min(high, ts), 6) AS high, round(arg_min(low, ts), 6) AS low,
  round(arg_min(close, ts), 6) AS close, round(arg_min(volume, ts), 6) AS volume FROM bars GROUP BY ALL""")
def s05_first_candle(spark, sf_dir):
    return rounded(SB.first_candle(events_bars(spark, sf_dir)))


@query("s13_backfill_plan", f"""WITH {BARS_SQL}, l AS (SELECT symbol, "interval", max(ts_ms) AS latest_ms FROM bars GROUP BY ALL),
e AS (SELECT *, CAST(floor(({NOW_MS} - (latest_ms + 1800000)) / 1800000) + 1 AS BIGINT) AS expected FROM l)
SELECT symbol, "interval", expected, CAST(n AS BIGINT) AS batch_no,
  latest_ms + 1800000 + n*1000*1800000 AS start_ms,
  least(latest_ms + 1800000 + (n*1000 + 999)*1800000, latest_ms + 1800000 + (expected - 1)*1800000) AS end_ms
FROM e, unnest(range(0, CAST(floor((expected - 1)/1000) AS BIGINT) + 1)) t(n) WHERE expected > 0""")
def s13_backfill_plan(spark, sf_dir):
    """Candle batches (1000 each) every series still lacks up to ``now``."""
    b = events_bars(spark, sf_dir)
    latest = b.groupBy(*K).agg(F.max("ts_ms").alias("latest_ms"))
    return SB.backfill_plan(latest, NOW_MS)


@query("s02_parse_klines", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts_ms, round(open, 6) AS open,
  round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume,
  round(CAST(CAST(close * volume AS VARCHAR) AS DOUBLE), 6) AS turnover, ts FROM bars""")
def s02_parse_klines(spark, sf_dir):
    """Raw kline arrays (built from bars in bounded batches of 1000) parsed back to rows."""
    raw = SR.kline_arrays(events_bars(spark, sf_dir))
    return rounded(SR.parse_klines(raw))


_RUNS_SQL = """runs AS (SELECT md5(CAST(user_id AS VARCHAR)) AS session_uuid, event_type AS symbol, '30' AS "interval",
  ts AS date, props AS best_params, value - 50 AS pnl, (event_id % 100) / 100.0 AS winrate FROM events)"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.md5(F.col("user_id").cast("string")).alias("session_uuid"), F.col("event_type").alias("symbol"),
                    F.lit("30").alias("interval"), F.col("ts").alias("date"), F.col("props").alias("best_params"),
                    (F.col("value") - 50).alias("pnl"), ((F.col("event_id") % 100) / 100.0).alias("winrate"))


@query("s07_run_log", f"""WITH {_RUNS_SQL} SELECT session_uuid, symbol, "interval", date, round(pnl, 6) AS pnl,
  round(winrate, 6) AS winrate, json_extract_string(best_params, '$.k') AS param_k FROM runs""")
def s07_run_log(spark, sf_dir):
    """Run log (stand-in from events) with the params JSON flattened, sorted by date."""
    r = SR.load_model_runs(_runs(spark, sf_dir), ["k"])
    return rounded(r.select("session_uuid", "symbol", "interval", "date", "pnl", "winrate", "param_k"))


@query("p03_losing_days", f"""WITH {_RUNS_SQL} SELECT session_uuid, symbol, date, round(pnl, 6) AS pnl,
  round(winrate, 6) AS winrate FROM runs WHERE pnl < 0 AND winrate < 0.5""")
def p03_losing_days(spark, sf_dir):
    return rounded(SR.losing_days(_runs(spark, sf_dir)).select("session_uuid", "symbol", "date", "pnl", "winrate"))


@query("p05_position_size", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts,
  round(CASE WHEN close <= 0 THEN 0 ELSE 1000*0.05*1/0.0175/close END, 6) AS position_size,
  round(CASE WHEN close <= 0 OR 0.0 <= 0 THEN 0 ELSE 1000*0.05*1/0.0/close END, 6) AS size_zero_sl FROM bars""")
def p05_position_size(spark, sf_dir):
    b = events_bars(spark, sf_dir)
    return rounded(b.select(*K, "ts", position_size(F.lit(1000.0), F.lit(0.05), F.lit(1.0), F.lit(0.0175), "close").alias("position_size"),
                            position_size(F.lit(1000.0), F.lit(0.05), F.lit(1.0), F.lit(0.0), "close").alias("size_zero_sl")))


@query("p06_dynamic_tp_sl", indicator_sql() + """
SELECT symbol, "interval", ts, round(CASE WHEN ATR > 0 AND close > 0 THEN ATR*2.0/close ELSE 0.05 END, 6) AS tp,
  round(CASE WHEN ATR > 0 AND close > 0 THEN ATR*1.2/close ELSE 0.02 END, 6) AS sl FROM ind""")
def p06_dynamic_tp_sl(spark, sf_dir):
    d = indicator_table(events_bars(spark, sf_dir), supertrend=False)
    return rounded(d.select(*K, "ts", dynamic_tp_sl("ATR", "close").alias("x")).select(*K, "ts", "x.tp", "x.sl"))


@query("p07_inverse_risk", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts,
  round(CASE WHEN close*20 <= 0 THEN 0.2 ELSE least(greatest(0.05*1000/(close*20), 0.01), 0.2) END, 6) AS risk_pct FROM bars""")
def p07_inverse_risk(spark, sf_dir):
    """P07 over a balance column derived from the data (close*20 as the current balance)."""
    b = events_bars(spark, sf_dir)
    return rounded(b.select(*K, "ts", inverse_balance_risk(F.col("close") * 20, F.lit(1000.0)).alias("risk_pct")))


@query("p09_should_update", f"""WITH {BARS_SQL}, l AS (SELECT symbol, "interval", max(ts_ms) AS latest_ms FROM bars GROUP BY ALL)
SELECT symbol, "interval", latest_ms, CAST(1800 AS BIGINT) AS interval_seconds,
  {NOW_MS} >= latest_ms + 1800*1000 - 60000 AS due FROM l""")
def p09_should_update(spark, sf_dir):
    """P08 + P09: interval code -> seconds, and whether the next candle is due at ``now``."""
    b = events_bars(spark, sf_dir)
    l = b.groupBy(*K).agg(F.max("ts_ms").alias("latest_ms"))
    return l.select(*K, "latest_ms", interval_seconds("interval").cast("bigint").alias("interval_seconds"),
                    should_update("latest_ms", "interval", NOW_MS).alias("due"))


@query("a11_integrity", f"""WITH {BARS_SQL}, g AS (SELECT symbol, "interval", ts_ms,
  lag(ts_ms) OVER (PARTITION BY symbol, "interval" ORDER BY ts_ms) AS prev FROM bars),
m AS (SELECT symbol, "interval", sum(greatest(CAST(floor((ts_ms - prev)/1800000) AS BIGINT) - 1, 0)) AS missing FROM g GROUP BY ALL),
s AS (SELECT symbol, "interval", count(*) AS rows, max(ts_ms) AS last_ms FROM bars GROUP BY ALL)
SELECT s.symbol, s."interval", s.rows, s.last_ms, CAST(coalesce(m.missing, 0) AS BIGINT) AS missing,
  {NOW_MS} - s.last_ms > 1800000 AS stale,
  s.rows > 0 AND coalesce(m.missing, 0) = 0 AND NOT ({NOW_MS} - s.last_ms > 1800000) AS ok
FROM s LEFT JOIN m ON s.symbol = m.symbol AND s."interval" = m."interval\"""")
def a11_integrity(spark, sf_dir):
    return integrity(events_bars(spark, sf_dir), NOW_MS)


@query("a11_missing_bars", f"""WITH {BARS_SQL}, g AS (SELECT symbol, "interval", ts_ms,
  lag(ts_ms) OVER (PARTITION BY symbol, "interval" ORDER BY ts_ms) AS prev FROM bars)
SELECT symbol, "interval", prev + i*1800000 AS missing_ms
FROM g, unnest(range(1, CAST(floor((ts_ms - prev)/1800000) AS BIGINT))) t(i) WHERE floor((ts_ms - prev)/1800000) > 1""")
def a11_missing_bars(spark, sf_dir):
    return gaps(events_bars(spark, sf_dir))


@query("u01_dedupe_keep_last", f"""WITH {BARS_SQL}, u AS (
  SELECT *, 0 AS prio FROM bars UNION ALL
  SELECT symbol, "interval", ts, ts_ms, open, high, low, close*1.01, volume, 1 FROM bars WHERE ts_ms >= {D1})
SELECT symbol, "interval", ts, round(close, 6) AS close FROM u
QUALIFY row_number() OVER (PARTITION BY symbol, "interval", ts ORDER BY prio DESC) = 1""")
def u01_dedupe_keep_last(spark, sf_dir):
    """Concat stored + restated bars, duplicate ts keeps the last source."""
    b = events_bars(spark, sf_dir)
    u = b.withColumn("prio", F.lit(0)).unionByName(
        b.where(F.col("ts_ms") >= D1).withColumn("close", F.col("close") * 1.01).withColumn("prio", F.lit(1)))
    w = Window.partitionBy(*K, "ts").orderBy(F.col("prio").desc())
    return rounded(u.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*K, "ts", "close"))


@query("a06_volume_limit", f"""WITH {BARS_SQL} SELECT symbol, "interval",
  round(quantile_cont(volume, 0.995) * 1.1, 6) AS volume_limit FROM bars GROUP BY ALL""")
def a06_volume_limit(spark, sf_dir):
    """99.5 % volume quantile (linear interpolation) x 1.1 per series."""
    b = events_bars(spark, sf_dir)
    return rounded(b.groupBy(*K).agg((F.percentile("volume", 0.995) * 1.1).alias("volume_limit")))


# ---------------------------------------------------------------- streaming operators, batch form
from kandle.streaming import live as LV  # noqa: E402


@query("d01_candle_messages", f"""WITH {BARS_SQL} SELECT symbol, "interval", ts_ms, round(open, 6) AS open,
  round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume,
  round(close * volume, 6) AS turnover, ts FROM bars""")
def d01_candle_messages(spark, sf_dir):
    """D01 (batch form of the stream job): JSON candle messages built from bars, parsed back."""
    return rounded(LV.parse_messages(LV.messages_from_bars(events_bars(spark, sf_dir))))


@query("d02_latest_candle", f"""WITH {BARS_SQL} SELECT symbol, "interval", max(ts_ms) AS ts_ms,
  round(arg_max(open, ts_ms), 6) AS open, round(arg_max(high, ts_ms), 6) AS high, round(arg_max(low, ts_ms), 6) AS low,
  round(arg_max(close, ts_ms), 6) AS close, round(arg_max(volume, ts_ms), 6) AS volume,
  round(arg_max(close * volume, ts_ms), 6) AS turnover, max(ts) AS ts FROM bars GROUP BY ALL""")
def d02_latest_candle(spark, sf_dir):
    """Latest candle per symbol from the message feed."""
    return rounded(LV.latest_per_symbol(LV.parse_messages(LV.messages_from_bars(events_bars(spark, sf_dir)))))
