import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F, types as T

from kandle.llm import prefix_trie as pt

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("head", "depth", "key", "n", "arr", "pos")])
CASES = [pt.Trie(), pt.Trie(container_turns=6, block_turns=64, piece_ids=3), pt.Trie(container_turns=5, block_turns=3, piece_ids=2, broadcast_heads=0),
         pt.Trie(container_turns=10 ** 6, block_turns=2)]


def rows():
    rng = random.Random(8)
    out = []
    for c in list(range(-3, 40)) + list(range(100, 150)) + list(range(207, 215)):
        n = rng.choice([1, 2, 3, 4, 6, 9])
        same = [("user", f"hello {i % 2}") for i in range(30)] if rng.random() < 0.6 else [(rng.choice(["user", None, "a"]), rng.choice([None, "", "x", "né\U0001F600", "y" * 5000])) for _ in range(30)]
        if rng.random() < 0.3:
            same[rng.randrange(3)] = ("user", "other")
        out += [(c, k if rng.random() < 0.95 else None, *same[k]) for k in range(n)]
    out += [(300, k, "user", "hello %d" % (k % 2)) for k in range(25)] + [(301, k, "user", "hello %d" % (k % 2)) for k in range(25)]
    out += [(302, k, "user", "long %d" % k) for k in range(30)]
    out += [(None, 1, "user", "no id"), (7, None, None, None), (7, None, None, None)]
    rng.shuffle(out)
    return [r + ("z",) * 6 for r in out]


def brute(data, rebuild=True):
    convs = {}
    for c, turn, role, text, *_ in data:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    for c, ts in convs.items():
        ts.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        convs[c] = [x[1:] for x in ts]
    seqs = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seqs[c] = tuple(convs.get(base, [])[:h] + ts[h:]) if rebuild else tuple(ts)
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[:len(path)] == path]
        kids = [q for q in below if len(q) == len(path) + 1]
        leaves = sum(not any(r[:len(q)] == q and len(r) == len(q) + 1 for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if seqs[c] == path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("p", CASES)
def test_against_brute_force(spark, p):
    data = rows()
    got = pt.rebuilt_report(spark.createDataFrame(data, ROWS).repartition(5), p)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_plain_and_hot(spark):
    """Conversations as they are; copies of one conversation and a first turn that most share."""
    data = [(c, k, "user", t) for c in range(60) for k, t in enumerate(["system", "a", "b"][:1 + c % 3] + [f"own {c}"] * (c % 4 == 0))]
    df = spark.createDataFrame([r + ("z",) * 6 for r in data], ROWS)
    for p in CASES:
        got = pt.trie(*pt.plain(pt.turn_rows(df)), p)
        assert sorted(map(tuple, got.collect()), key=str) == brute(data, rebuild=False)


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    assert pt.rebuilt_report(none).collect() == []


def test_numbering_over_partitions(spark):
    """One conversation over many range partitions."""
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), (n - F.col("id")).alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    got = pt.numbered(pt.turn_rows(df)).orderBy("k").collect()
    want = [hashlib.sha256(f"1:u{i}".encode()).digest() for i in range(n - 1, -1, -1)]
    assert [r["k"] for r in got] == list(range(n)) and [bytes(r["t"]) for r in got] == want
