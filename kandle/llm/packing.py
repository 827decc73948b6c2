"""Best-fit packing with bound-certified repacking (operator 13).

Documents become token pieces of at most ``capacity`` ids (only longer documents are cut), and pieces
are packed into sequences of that capacity:

1. Full pieces are sequences of their own. The others are dealt by hash to partitions of about
   ``part_pieces`` pieces, whatever documents they stem from, and each partition packs its pieces by
   best-fit decreasing.
2. Dual feasible functions bound every partition's number of sequences from below: a function f with
   sum f(x_i) <= 1 whenever sum x_i <= 1 makes sum f(length / capacity) a bound. Used are the identity,
   the threshold functions U_e (pieces above 1 - e count as whole, those below e not at all) and the
   rounding functions u_k, alone and after U_e. A partition whose count meets the bound is certified and
   final.
3. A partition with a gap keeps its tight sequences and hands the pieces of its loosest ones on:
   ``fan`` partitions exchange what they handed on and run best-fit decreasing on it again. That
   goes on group by group until no gap or one group is left. A repacking that needs more
   sequences than before is not taken. What a group hands on is bounded by ``part_pieces / 2`` pieces,
   so no task ever holds more than ``fan * part_pieces / 2``; what it does not hand on stays packed.

``certificate`` sets the number of sequences against the bound of the whole table, from its histogram of lengths.

Edge cases: null and empty texts hold the end id alone (one piece of length 1); very long texts give
many full pieces; repeated rows are packed each; null ids are kept; an empty table gives no rows; further
columns are not read, so their names cannot clash.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kandle.llm.common import materialize, python_ready
from kandle.llm.token_files import TokenFormat, _encoder, steps


@dataclass(frozen=True)
class Packing:
    path: str = ""  # "": the public word BPE
    capacity: int = 2048
    end_id: int = 0
    part_pieces: int = 16384
    fan: int = 8


# ---------------------------------------------------------------- bounds and best fit
def lower_bound(counts: np.ndarray) -> float:
    """Least number of sequences for ``counts[n]`` pieces of length n, n = 0 .. capacity, not rounded up."""
    cap = len(counts) - 1
    size = np.arange(cap + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = float((counts * size).sum()) / cap

    def rounded(values: np.ndarray, k: int) -> np.ndarray:
        """u_k of lengths as multiples of 1 / (cap * k)."""
        up = (k + 1) * values
        return np.where(up % cap == 0, values * k, up // cap * cap)

    for k in range(1, 17):
        best = max(best, float((counts * rounded(size, k)).sum()) / (cap * k))
    held = np.flatnonzero(counts)
    for e in held[held <= cap // 2].tolist():
        kept = np.where(size > cap - e, cap, np.where(size < e, 0, size))
        best = max(best, float((counts * kept).sum()) / cap)
        for k in (1, 2, 3, 4):
            best = max(best, float((counts * rounded(kept, k)).sum()) / (cap * k))
    return best


def whole(bound: float) -> int:
    return int(np.ceil(bound - 1e-6))


def best_fit(lengths, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Sequence of every length (given in descending order), and the room left in each: the fullest that still
    takes the piece. Sequences stand in stacks by room, and the stacks in use are the bits of one integer."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, room, out = 0, [], np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        fits = used >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            stack = stacks[left]
            at = stack.pop()
            if not stack:
                used ^= 1 << left
        else:
            at, left = len(room), capacity
            room.append(0)
        left -= n
        room[at] = left
        if left:
            if not stacks[left]:
                used |= 1 << left
            stacks[left].append(at)
        out[i] = at
    return out, room


def repack(pdf: pd.DataFrame, p: Packing, turn: int, last: bool) -> pd.DataFrame:
    """One group's pieces (pid, length, part, grp, seq) packed; ``loose`` marks those handed on to the next round."""
    pdf = pdf.sort_values(["length", "pid"], ascending=[False, True], kind="stable", ignore_index=True)
    lengths = pdf["length"].to_numpy()
    at, room = best_fit(lengths.tolist(), p.capacity)
    if turn and len(room) > pdf["seq"].nunique():  # never worse than what came in
        at = pd.factorize(pdf["seq"])[0]
        room = (p.capacity - np.bincount(at, weights=lengths).astype(np.int64)).tolist()
    room = np.array(room, np.int64)
    # places: running sums within a sequence, in order of length
    order = np.argsort(at, kind="stable")
    upto = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, at[order][1:] != at[order][:-1]]
    offset = np.empty(len(at), np.int64)
    offset[order] = upto - np.maximum.accumulate(np.where(first, upto, 0))
    loose = np.zeros(len(room), bool)
    gap = len(room) - lower_bound(np.bincount(lengths, minlength=p.capacity + 1))
    if not last and gap > 1e-6:
        by_room = np.argsort(-room, kind="stable")
        pieces = np.cumsum(np.bincount(at, minlength=len(room))[by_room])
        loose[by_room[(room[by_room] > 0) & (pieces <= p.part_pieces // 2)]] = True
    grp = int(pdf["grp"].iloc[0])
    return pd.DataFrame({"pid": pdf["pid"], "length": lengths, "part": grp,
                         "seq": (turn << 56) + (grp << 28) + at, "offset": offset, "loose": loose[at]})


# ---------------------------------------------------------------- Spark
def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """The token pieces: pid (unique), the id, piece, start, length, ids_crc32 and, if asked for, ``ids`` (little-endian
    unsigned 32-bit integers). Written to the shared folder once."""
    python_ready(docs.sparkSession)
    cap, path = p.capacity, TokenFormat(p.path).tokenizer_path
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext
        enc = _encoder(path())
        end = np.array([p.end_id], "<u4").tobytes()
        pid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text")
            for i, j in _slices(texts):
                of, no, size, crc, ids = [], [], [], [], []
                for k, raw in enumerate(enc([t or "" for t in texts.slice(i, j - i).to_pylist()]), i):
                    raw = np.frombuffer(raw, enc.dtype).astype("<u4").tobytes() + end
                    for n, a in enumerate(range(0, len(raw), 4 * cap)):
                        one = raw[a:a + 4 * cap]
                        of.append(k)
                        no.append(n)
                        size.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        if with_ids:
                            ids.append(one)
                columns = [pa.array(range(pid, pid + len(of)), pa.int64()), batch.column("id").take(pa.array(of)), pa.array(no, pa.int32()),
                           pa.array([n * cap for n in no], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                pid += len(of)
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []),
                                                 ["pid", "id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"pid long, id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return materialize(rows.mapInArrow(cut, schema), "pieces", "zstd" if with_ids else "snappy")


def _slices(texts: pa.Array):
    """Steps of a column by its characters' bytes."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    return steps([range(n) for n in sizes])


def _repacking(p: Packing, turn: int, last: bool):
    return lambda pdf: repack(pdf, p, turn, last)


def pack(items: DataFrame, p: Packing = Packing()) -> DataFrame:
    """(pid, length) of pieces -> (pid, sequence_id, offset). ``pid`` is unique, ``length`` 1 .. capacity."""
    spark = items.sparkSession
    python_ready(spark)
    full = items.where(F.col("length") >= p.capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = items.where(F.col("length") < p.capacity)
    n = short.count()
    parts = max(1, -(-n // p.part_pieces))
    held = short.select("pid", "length", F.pmod(F.xxhash64("pid"), F.lit(parts)).alias("grp"), F.lit(0).cast("long").alias("seq"))
    out, turn = [full], 0
    while True:
        # pieces are a few bytes each but work: an explicit number of tasks, or AQE would merge them
        tasks = max(1, min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        last = parts == 1
        done = held.repartition(tasks, "grp").groupBy("grp").applyInPandas(
            _repacking(p, turn, last), "pid long, length long, part long, seq long, offset long, loose boolean")
        done = materialize(done, f"packed-{turn}")
        out.append(done.where("NOT loose").select("pid", F.col("seq").alias("sequence_id"), "offset"))
        if last or done.where("loose").isEmpty():
            break
        turn, parts = turn + 1, -(-parts // p.fan)
        held = done.where("loose").select("pid", "length", F.floor(F.col("part") / p.fan).alias("grp"), "seq")
    all_of = out[0]
    for more in out[1:]:
        all_of = all_of.unionByName(more)
    return all_of


def certificate(items: DataFrame, packed: DataFrame, p: Packing = Packing()) -> DataFrame:
    """One row: sequences, lower_bound (of any packing of these pieces) and whether they are equal."""
    counts = np.zeros(p.capacity + 1, np.int64)
    for r in items.groupBy("length").agg(F.count("*").alias("c")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["c"]
    return packed.agg(F.countDistinct("sequence_id").alias("sequences")).select(
        "sequences", F.lit(whole(lower_bound(counts))).cast("long").alias("lower_bound")).withColumn("certified", F.expr("sequences = lower_bound"))


def sequences(with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    one = with_ids.join(packed, "pid").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"), F.sum("length").alias("n_tokens"))
    return one.select("sequence_id", F.expr("aggregate(all.ids, X'', (a, b) -> concat(a, b))").alias("ids"), "n_tokens")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: Packing = Packing()) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, id_col, text, p)
    placed = pack(cut.select("pid", "length"), p)
    return cut.join(placed, "pid").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
