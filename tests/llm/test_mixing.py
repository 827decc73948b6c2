import hashlib

import duckdb
from data_llm import DOCS, WORD, docs, rows

from kandle.llm import mixing as mx
from kandle.llm.queries import MIX_SQL


def targets(sizes, most=3):
    """Round by round: share by weight, fix the sources above their cap, share the rest again."""
    total = sum(sizes.values())
    keys = sorted(sizes)
    w = {k: 1 + i % 3 for i, k in enumerate(keys)}
    fixed = {}
    while True:
        free = [k for k in keys if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * w[k] / sum(w[j] for j in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: float(most * sizes[k]) for k in over}


def test_mix_matches_targets_and_sql(edge):
    got = mx.mix_report(edge).collect()
    data = rows()
    size = {}
    for r in data:
        k = "1" if r[3] is None else "0" + r[3]
        size[k] = size.get(k, 0) + len(WORD.findall(r[1] or ""))
    want = targets(size)
    assert len(got) == len(data)
    by_source = {}
    for r in got:
        assert r["taken"] in {r["size"] * k for k in range(4)}
    ids = {}
    for r in data:
        ids.setdefault((r[0], len(WORD.findall(r[1] or ""))), "1" if r[3] is None else "0" + r[3])
    for r in got:
        s = ids[(r["doc_id"], r["size"])]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6
        by_source[s] = by_source.get(s, 0) + r["taken"]
    longest = max(len(WORD.findall(r[1] or "")) for r in data) * 3
    assert all(abs(by_source[s] - want[s]) <= longest for s in want)
    assert sum(by_source.values()) <= sum(size.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in data])
    sql = con.execute(MIX_SQL).fetchall()
    assert sorted((str(r[0]), r[1], r[4]) for r in sql) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got)


def test_rows_and_reruns(edge, none, spark):
    a = sorted(str(r["doc_id"]) for r in mx.mix_rows(edge).collect())
    b = sorted(str(r["doc_id"]) for r in mx.mix_rows(docs(spark).repartition(3)).collect())
    assert a == b and mx.mix_rows(edge).columns == DOCS.names
    want = []
    for r in mx.mix_report(edge).where("size > 0").collect():
        want += [str(r["doc_id"])] * (r["taken"] // r["size"])
    assert a == sorted(want)
    assert mx.mix_report(none).collect() == [] and mx.mix_rows(none).collect() == []


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in mx.mix_report(df).collect()}
    assert got == {1: (0, 0.0, 0), 2: (0, 0.0, 0)}


def test_shuffle_key_is_md5():
    assert hashlib.md5(b"7:mix-1").hexdigest()[:16]
