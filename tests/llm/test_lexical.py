import math
import re

import numpy as np
import pytest
from data_llm import rows
from pyspark.sql import functions as F

from kandle.llm import lexical as lx

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "the same three words"), (2, "a b c"), (3, None), (4, "..."), (5, "Né license MIT"), (6, "la"), (None, "words"), (7, "xyzzy absent"),
         (8, "A a a A b"), (8, "one more row"), (9, "né \U0001F600 ñ LA"), (10, "be la ci do " * 50)]
CASES = [lx.Search(), lx.Search(top=3, block_terms=5, tile_items=2, tile_terms=2, tile_docs=7), lx.Search(top=200, tile_docs=3)]


def own(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, top):
    lists = [(i, own(t)) for i, t in docs]
    n_docs, total = sum(bool(x) for _, x in lists), sum(len(x) for _, x in lists)
    df = {}
    for _, x in lists:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    want = {}
    for item, text in items:
        want.setdefault(item, set()).update(own(text))
    out = []
    for item, ts in want.items():
        scored = []
        for i, x in lists:
            m, s = 100 - 90 + 90 * len(x) * n_docs // total, 0
            for t in ts.intersection(x):
                tf = x.count(t)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([r + ("c", 1) for r in ITEMS], "item_id long, text string, score string, rank int")


@pytest.mark.parametrize("p", CASES)
def test_against_brute_force(edge, items, p):
    got = lx.search(items, edge, p=p)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == brute(ITEMS, [r[:2] for r in rows()], p.top)


def test_empty_and_clashing(spark, edge, none, items):
    assert lx.search(items, none).collect() == [] and lx.search(items.limit(0), edge).collect() == []
    odd = edge.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("id", "n", "term", "tf", "item", "task", "item_id", "rank")])
    assert lx.search(items, odd).count() == lx.search(items, edge).count()


def test_ties_over_tasks(spark):
    """One text on all rows, over many tasks: the least ids win."""
    docs = spark.range(5000).select((F.col("id") * 7 % 5000).alias("doc_id"), F.lit("same words here").alias("text")).unionByName(
        spark.range(9000, 9010).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"))).repartition(40)
    got = lx.search(spark.createDataFrame([(1, "here"), (2, "other")], "item_id int, text string"), docs).orderBy("item_id", "rank").collect()
    assert [r["doc_id"] for r in got if r["item_id"] == 2] == list(range(9000, 9010))
    assert [r["doc_id"] for r in got if r["item_id"] == 1] == list(range(10))


def test_products_are_exact():
    """Sums near 2^53 would lose units in one product; tiles keep them apart."""
    p = lx.Search(tile_terms=1 << 20)
    n = 600_000
    vocab, weight = np.arange(n), np.full(n, 45_999, np.int64)
    part = [list(range(n))]
    impact = np.full(n, 999_999, np.int64)
    impact[::2] -= 1
    got = lx.tile_scores(part, vocab, weight, np.zeros(n, np.int64), np.arange(n), impact, 1, p)
    assert int(got[0, 0]) == 45_999 * int(impact.sum()) > 1 << 53


def test_long_and_large_counts():
    tf, n = np.array([1, 10 ** 6, 5]), np.array([10 ** 7, 10 ** 7, 3])
    for docs, total in ((10, 1000), (10 ** 13, 10 ** 14)):
        assert lx.impacts(tf, n, docs, total).tolist() == [10 ** 9 * int(t) // (1000 * int(t) + 8 * (10 + 90 * int(x) * docs // total)) for t, x in zip(tf, n)]
