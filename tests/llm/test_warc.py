import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import types as T

from kandle.llm import files, warc
from kandle.llm.common import scratch_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("size", T.StringType())])
BIG = "<p>" + "é" * 60 + "</p>"
LINES = "a\r\n\r\nContent-Length: 7\r\n\r\nWARC/1.1\r\n" * 9
ROWS = [(1, "http://x/a b", BIG), (2, None, BIG), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
        (7, "u", LINES), (8, "u", LINES), (0, "z", LINES), (None, "n", BIG), (None, None, None), (9, "u", "y" * 300_000), (2, None, BIG)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", "s") for r in ROWS], PAGES).repartition(3)


@pytest.mark.parametrize("conf", [warc.Archives(), warc.Archives(archive_bytes=500, slice_records=1)])
def test_round_trip(pages, spark, conf):
    first = {}
    for i, _, h in ROWS:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        revisit = b in first and i != first[b]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    got = [tuple(r) for r in warc.round_trip(pages, conf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], PAGES), conf).collect() == []


def test_all_rows_of_a_repeated_smallest_id_are_responses(spark):
    rows = [(1, "b", BIG), (1, "a", BIG), (1, "a", BIG), (1, None, BIG), (2, "a", BIG), (2, "c", BIG), (1, "a", LINES)]
    got = warc.round_trip(spark.createDataFrame([(*r, "d", "s") for r in rows], PAGES)).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
    n = len(BIG.encode())
    assert got == sorted([(1, n, "response", None)] * 4 + [(2, n, "revisit", 1)] * 2 + [(1, len(LINES), "response", None)], key=str)


def test_normaliser_offsets_and_members(pages, spark):
    mono = warc.write_monolithic(warc.plan_records(pages), scratch_path(spark, "m"))
    out = warc.normalise(mono, scratch_path(spark, "w")).collect()
    assert sum(r["n_records"] for r in out) == len(ROWS)
    for r in out:
        _, path = files.open_fs(r["path"])
        data, lines = open(path + ".warc.gz", "rb").read(), open(path + ".idx").read().splitlines()
        whole = b""
        for line in lines:
            off, size, _ = line.split("\t")
            d = zlib.decompressobj(31)
            rec = d.decompress(data[int(off):int(off) + int(size)])
            assert d.eof and not d.unused_data and rec.startswith(b"WARC/1.1\r\n")
            whole += rec
        assert gzip.decompress(data) == whole


def test_streams_and_truncation():
    recs = [warc.record_bytes("response", k, None, b"x" * k, k, "0", None, "d") for k in (0, 5, 100)]
    raw = b"".join(recs)
    assert list(warc.split_records(raw[i:i + 3] for i in range(0, len(raw), 3))) == recs
    with pytest.raises(ValueError):
        list(warc.split_records([raw[:-5]]))


def test_inflation_is_stepped():
    """Repetitive bytes inflate a thousandfold; pieces stay as small as asked for, over members, too."""
    import io
    raw = gzip.compress(b"a" * 5_000_000) + gzip.compress(b"b" * 10) + gzip.compress(b"c" * 70_000)
    pieces = list(warc.inflated(io.BytesIO(raw), 4096))
    assert b"".join(pieces) == b"a" * 5_000_000 + b"b" * 10 + b"c" * 70_000 and max(map(len, pieces)) <= 4096


def test_archives_are_spread_over_tasks(spark):
    """Many small archives: the normaliser and the reader each run in more than one task."""
    from pyspark.sql import functions as F
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html"))
    conf = warc.Archives(archive_bytes=5000, slice_records=8)
    done = warc.normalise(warc.write_monolithic(warc.plan_records(pages, conf), scratch_path(spark, "m"), conf), scratch_path(spark, "w"), conf)
    # the names say which task wrote an archive
    assert len({r["path"].rsplit("/", 1)[-1].split("-")[1] for r in done.collect()}) > 1
    read = warc.read_records(done, conf)
    assert read.count() == 400 and read.select(F.spark_partition_id().alias("p")).distinct().count() > 1
