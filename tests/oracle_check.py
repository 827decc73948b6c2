"""Run queries() vs oracle_sql() like the driver does (row count, schema names, value hash)."""
import hashlib, sys, time
sys.path.insert(0, "/root/repo")
import duckdb
import __spark_entry__ as E
from kandle.sources.tables import TABLES

def plain_session(master="local[8]", partitions=8):
    """A session as any caller has it: ANSI on, nothing tuned for this package."""
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # one JVM runs hundreds of wide plans here: do not keep the text of a thousand of them
         .config("spark.sql.ui.retainedExecutions", 30).config("spark.ui.retainedJobs", 100).config("spark.ui.retainedStages", 100)
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s

def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if v != v:
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(int(v))
    return str(v)

def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()

def main(sf="0.01", only=None):
    d = f"/root/testdata/sf{sf}"
    spark = plain_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, d)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as ex:
            print(f"{name:32s} SPARK-ERROR {str(ex)[:300]}"); bad += 1; continue
        ts = time.time() - t
        if name not in sqls:
            print(f"{name:32s} rows={len(rows)} (no oracle) {ts:.1f}s"); continue
        try:
            res = con.execute(sqls[name])
            ocols = [c[0] for c in res.description]
            orows = res.fetchall()
        except Exception as ex:
            print(f"{name:32s} SQL-ERROR {str(ex)[:300]}"); bad += 1; continue
        same_cols = sorted(c.lower() for c in cols) == sorted(c.lower() for c in ocols)
        h1, h2 = digest(cols, rows), digest(ocols, orows)
        ok = same_cols and len(rows) == len(orows) and h1 == h2
        bad += not ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} rows={len(rows)}/{len(orows)} cols={'ok' if same_cols else (cols, ocols)} {ts:.1f}s")
        if not ok and same_cols and len(rows) == len(orows):
            order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
            oorder = sorted(range(len(ocols)), key=lambda i: ocols[i].lower())
            a = sorted("|".join(norm(r[i]) for i in order) for r in rows)
            b = sorted("|".join(norm(r[i]) for i in oorder) for r in orows)
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diffs:
                print("   spark:", x[:250]); print("   duck :", y[:250])
    print("BAD", bad)

if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:] or None)
