import hashlib

import pytest
from data_llm import WS, key, rows

from kandle.llm import block_naming as bn


def brute():
    groups, out = {}, []
    for r in rows():
        groups.setdefault(WS.sub(" ", r[1] or ""), []).append(r[0])
    for r in rows():
        t = WS.sub(" ", r[1] or "")
        ids = [i for i in groups[t] if i is not None]
        out.append((r[0], min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,mod", [(4096, None), (7, None), (50, 3)])
def test_groups(edge, block, mod):
    """Whole blocks, many levels, and look-up keys that collide on purpose."""
    got = bn.exact_groups(edge.select("doc_id", "text"), block_chars=block, key_mod=mod).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute()
    per = {}
    for r in got:
        per.setdefault(r["text_sha256"], []).append(r)
    for g in per.values():
        assert sum(r["kept"] for r in g) == 1
        assert next(r for r in g if r["kept"])["doc_id"] == g[0]["keep_id"]


def test_keep_first(edge, none):
    got = bn.keep_first(edge)
    assert got.columns == edge.columns
    assert len(got.collect()) == len({WS.sub(" ", r[1] or "") for r in rows()})
    assert sorted((r["doc_id"] for r in got.collect()), key=key) == sorted(
        (b[1] for b in {(b[3]): b for b in brute()}.values()), key=key)
    assert bn.exact_groups(none.select("doc_id", "text")).collect() == [] and bn.keep_first(none).collect() == []


def test_same_blocks_in_another_order(spark):
    a, b = "x" * 10, "y" * 10
    df = spark.createDataFrame([(1, a + b), (2, b + a), (3, a + b + a), (4, a + b), (5, a), (6, b), (7, a + b + a + b)], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in bn.exact_groups(df, block_chars=10).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7}


def test_clashing_names_and_long_texts(spark, edge):
    from pyspark.sql import functions as F
    extra = ["name", "rid", "h", "pos", "block", "n_blocks", "doc", "blocks", "__sha", "kept", "text_sha256", "a", "b", "best", "extra column"]
    odd = edge.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in extra])
    got = bn.exact_groups(odd, block_chars=50).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute()
    assert all(r[c] == f"own {c}" for r in got for c in extra if c not in bn.RESULT)
    kept = bn.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({b[3] for b in brute()})
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long), (2, long + "end"), (3, long.replace(" ", "\n"))], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in bn.exact_groups(df).collect()} == {1: 1, 2: 2, 3: 1}
