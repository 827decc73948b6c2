import duckdb

import __spark_entry__ as E
from conftest import SF
from oracle_check import digest


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "final_balance" in df.columns


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 40


def test_some_queries_match_oracle_sf0001(spark):
    from kandle.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("w05_bbands", "w06_ema", "b04_replay_summary", "a11_integrity"):
        df = E.queries()[name](spark, SF)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(E.oracle_sql()[name])
        cols, want = [c[0] for c in res.description], res.fetchall()
        assert rows and sorted(df.columns) == sorted(cols), name
        assert digest(df.columns, rows) == digest(cols, want), name
