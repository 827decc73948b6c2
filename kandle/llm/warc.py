"""WARC (operator 5): archives of pages, and a normaliser for monolithic gzip files.

Writing. Pages become response records; of equal payloads of at least ``least_dup_bytes`` bytes
the one with the smallest id is the response and the others are revisit records that refer to it.
Each task writes archives of about ``archive_bytes``, compressed as ONE gzip stream over the whole
file, the way such files often arrive: no record can be read without inflating all before it.

Normalising. Each monolithic file is inflated once, as a stream; every record found by its
Content-Length is rewritten as a gzip member of its own, and a sidecar index
(<archive>.idx, one line per record: offset, length, type) is written next to the new archive. Memory holds
one record. A file is one task, files are bounded by the writer's archive size.

Reading. Index lines, in slices, give any task direct access to its members.

Payload equality is decided on SHA-256 digests before writing; only digests and ids are grouped.
Tasks write under attempt names and report them in rows, so lost attempts leave nothing that is read.

Edge cases: null html is an empty payload; empty and small payloads are responses; a null url or id
is left out of the record and read back as null, and never is a group's smallest id; repeated rows
(equal id and payload) are each written: all rows of a group's smallest id are responses, whatever their
urls; an empty table gives no archives and no rows.
"""
from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kandle.llm import files
from kandle.llm.common import materialize, python_ready, scratch_path


@dataclass(frozen=True)
class Archives:
    archive_bytes: int = 64 << 20  # inflated bytes after which a new archive is begun
    least_dup_bytes: int = 100
    level: int = 1
    slice_records: int = 2048
    date: str = "1970-01-01T00:00:00Z"


def record_bytes(kind: str, page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}",
            "Content-Type: " + ("text/html" if kind == "response" else "message/http"),
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~')}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[:int(fields["Content-Length"])]


def plan_records(pages: DataFrame, conf: Archives = Archives()) -> DataFrame:
    """page_id, url, payload, size, digest, refers_to (null: response)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = (rows.where(F.col("size") >= conf.least_dup_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1").drop("c"))
    joined = rows.join(first, "digest", "left")
    return joined.select("page_id", "url", F.when(F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.lit(b""))
                         .otherwise(F.col("payload")).alias("payload"), "size", "digest",
                         F.when(F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.col("first_id")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, conf: Archives = Archives()) -> DataFrame:
    """Archives of one gzip stream each: path, n_records, bytes."""
    python_ready(records.sparkSession)

    def write(batches):
        store, at = files.open_fs(folder)
        name, k, out, comp, raw, n = files.attempt_name("mono"), 0, None, None, 0, 0
        done = []

        def close():
            out.write(comp.flush())
            out.close()
            done.append((files.join(folder, f"{name}-{k}.warc.gz"), n, raw))

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{name}-{k}.warc.gz", compression=None)
                    comp, raw, n = zlib.compressobj(conf.level, zlib.DEFLATED, 31), 0, 0
                page_id, url, payload, size, digest, to = (c[i].as_py() for c in batch.columns)
                rec = record_bytes("response" if to is None else "revisit", page_id, url, payload, size, digest, to, conf.date)
                out.write(comp.compress(rec))
                raw, n = raw + len(rec), n + 1
                if raw >= conf.archive_bytes:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_records": pa.array([d[1] for d in done], pa.int64()),
                                              "bytes": pa.array([d[2] for d in done], pa.int64())})

    rows = records.select("page_id", "url", "payload", "size", "digest", "refers_to")
    return materialize(rows.mapInArrow(write, "path string, n_records long, bytes long"), "monolithic")


def split_records(chunks):
    """Whole records out of a stream of inflated bytes, by their Content-Length; holds one record."""
    buf = bytearray()
    need = None
    for c in chunks:
        buf += c
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(buf[:end]).lower()
                at = head.rindex(b"\r\ncontent-length:") + 17
                need = end + 4 + int(head[at:].split(b"\r\n", 1)[0]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf:
        raise ValueError("truncated record at the end of an archive")


def inflated(f, step: int = 1 << 20):
    """Bytes of a gzip file, member after member, as a stream of pieces of at most ``step`` bytes, however well they are packed."""
    d = zlib.decompressobj(31)
    while True:
        raw = f.read(step)
        if not raw:
            break
        while raw:
            yield d.decompress(raw, step)
            if d.eof:
                raw, d = d.unused_data, zlib.decompressobj(31)
            else:
                raw = d.unconsumed_tail


def normalise(archives: DataFrame, folder: str, conf: Archives = Archives()) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar index: path, n_records."""
    python_ready(archives.sparkSession)

    def run(frames):
        store, at = files.open_fs(folder)
        store.create_dir(at, recursive=True)
        for pdf in frames:
            for i, src in enumerate(pdf["path"]):
                name = f"{files.attempt_name('warc')}-{src.rsplit('/', 1)[-1].removesuffix('.warc.gz')}"
                source, path = files.open_fs(src)
                pos, lines = 0, []
                with source.open_input_stream(path, compression=None) as f, store.open_output_stream(f"{at}/{name}.warc.gz", compression=None) as out:
                    for rec in split_records(inflated(f)):
                        c = zlib.compressobj(conf.level, zlib.DEFLATED, 31)
                        member = c.compress(rec) + c.flush()
                        out.write(member)
                        kind = "revisit" if b"WARC-Type: revisit\r\n" in rec[:200] else "response"
                        lines.append(f"{pos}\t{len(member)}\t{kind}\n")
                        pos += len(member)
                with store.open_output_stream(f"{at}/{name}.idx") as idx:
                    idx.write("".join(lines).encode())
                yield pd.DataFrame({"path": [files.join(folder, name)], "n_records": [len(lines)]})

    # a path is a few bytes but an archive's work: an explicit count, or AQE would merge them into one task
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = archives.select("path").repartition(tasks, "path")
    return materialize(spread.mapInPandas(run, "path string, n_records long"), "normalised")


def read_records(archives: DataFrame, conf: Archives = Archives()) -> DataFrame:
    """Records by their index lines: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    python_ready(archives.sparkSession)
    step = conf.slice_records
    slices = archives.where("n_records > 0").select(
        "path", "n_records", F.explode(F.sequence(F.lit(0), F.col("n_records") - 1, F.lit(step))).alias("lo"))
    slices = slices.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "lo")

    def page(urn):
        return None if urn is None else int(urn[len("<urn:page:"):-1])

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                store, path = files.open_fs(r.path)
                with store.open_input_stream(path + ".idx") as f:
                    lines = f.read().decode().splitlines()[r.lo:r.lo + step]
                rows = []
                with store.open_input_file(path + ".warc.gz") as f:
                    for line in lines:
                        off, size, kind = line.split("\t")
                        fields, body = parse_record(zlib.decompress(f.read_at(int(size), int(off)), 31))
                        assert fields["WARC-Type"] == kind
                        named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response":
                            n, digest = len(body), hashlib.sha256(body).hexdigest()
                            if digest != named:
                                raise ValueError(f"payload of {fields.get('WARC-Record-ID')} does not match its digest")
                        else:
                            n, digest = int(fields["X-Payload-Length"]), named
                        rows.append((page(fields.get("WARC-Record-ID")), n, digest, kind, page(fields.get("WARC-Refers-To"))))
                cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                out = pd.DataFrame(rows, columns=cols)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return slices.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, conf: Archives = Archives()) -> DataFrame:
    """Plan, write monolithic archives, normalise them, read the records back."""
    spark = pages.sparkSession
    mono = write_monolithic(plan_records(pages, conf), scratch_path(spark, "mono"), conf)
    return read_records(normalise(mono, scratch_path(spark, "warc"), conf), conf)
