import zlib

import numpy as np
import pytest
from data_llm import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kandle.llm import packing as pk
from kandle.llm.token_files import TokenFormat

SMALL = pk.Packing(capacity=64, part_pieces=40, fan=3)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(TokenFormat().tokenizer_path())


def brute(tok, cap):
    out = []
    for r in rows():
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(r[0], k, a, len(ids[a:a + cap]), zlib.crc32(ids[a:a + cap].tobytes())) for k, a in enumerate(range(0, len(ids), cap))]
    return sorted(out, key=str)


def check_places(got, cap):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= cap
    return len(by)


@pytest.mark.parametrize("p", [pk.Packing(), SMALL, pk.Packing(capacity=64, part_pieces=8, fan=2)])
def test_pieces_and_places(edge, tok, p):
    got = pk.report(edge, p=p).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == brute(tok, p.capacity)
    bins = check_places(got, p.capacity)
    counts = np.bincount([r["length"] for r in got], minlength=p.capacity + 1)
    assert bins <= pk.whole(pk.lower_bound(counts)) + 1


def test_empty_clashing_and_files(spark, edge, none, tok):
    assert pk.report(none).collect() == []
    odd = edge.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("pid", "id", "length", "seq", "grp", "offset", "piece", "ids")])
    assert pk.report(odd, p=SMALL).count() == pk.report(edge, p=SMALL).count()
    cut = pk.pieces(edge, p=SMALL, with_ids=True)
    placed = pk.pack(cut.select("pid", "length"), SMALL)
    seqs = pk.sequences(cut, placed).collect()
    assert all(len(s["ids"]) == 4 * s["n_tokens"] <= 4 * 64 for s in seqs)
    flat = np.sort(np.concatenate([np.frombuffer(s["ids"], "<u4") for s in seqs]))
    want = np.sort(np.concatenate([tok.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows()]))
    assert np.array_equal(flat, want)
    row = pk.certificate(cut, placed, SMALL).first()
    assert row["lower_bound"] <= row["sequences"] <= row["lower_bound"] + 1


def optimum(lengths, cap):
    """Least number of bins, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= lengths[i]}.values():
            place(i + 1, room[:k] + [room[k] - lengths[i]] + room[k + 1:])
        place(i + 1, room + [cap - lengths[i]])

    place(0, [])
    return best[0] if lengths else 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_bound_is_no_more_than_the_optimum(lengths):
    least = optimum(lengths, 30)
    assert pk.whole(pk.lower_bound(np.bincount(lengths, minlength=31))) <= least
    at, room = pk.best_fit(sorted(lengths, reverse=True), 30)
    assert least <= len(room) and all(0 <= r < 30 for r in room) and sum(30 - r for r in room) == sum(lengths)


def test_bounds_beyond_the_sum():
    for lengths, least in (([11] * 6, 3), ([16] * 5, 5), ([20, 20, 8, 8], 2), ([21, 21, 10, 10, 10], 3)):
        assert pk.whole(pk.lower_bound(np.bincount(lengths, minlength=31))) == least == optimum(lengths, 30)


def test_exchange_closes_gaps(spark):
    """Many partitions with a loose sequence each end near the bound of the whole; a hot length changes nothing."""
    for lengths in (F.expr("1 + pmod(xxhash64(id), 700)"), F.expr("CASE WHEN id % 3 = 0 THEN 500 ELSE 1 + pmod(xxhash64(id), 1500) END")):
        items = spark.range(20000).select(F.col("id").alias("pid"), lengths.cast("long").alias("length"))
        p = pk.Packing(part_pieces=500, fan=4)
        packed = pk.pack(items, p)
        row = pk.certificate(items, packed, p).first()
        assert packed.select("pid").distinct().count() == 20000
        assert row["sequences"] <= 1.01 * row["lower_bound"] + 1  # partitions far smaller than in production
        check_places(packed.join(items, "pid").collect(), 2048)
