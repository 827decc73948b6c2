"""SentencePiece encoding and decoding with a max-plus parallel scan (operator 7).

Short documents are encoded whole. A giant document is cut into chunks of ``chunk_chars`` code
points wherever that falls, and the chunks are worked on by different tasks:

1. A boundary's states are the pieces that may end at it or cross it. They follow from the text
   around the boundary alone, so both neighbours list them alike.
2. Each chunk yields its transfer matrix: entry (i, j) is the best weight of a way through the
   piece lattice from state i at its left boundary to state j at its right one, -inf if none.
3. Matrices are combined in the (max, +) semiring, ``fan`` at a time and level by level; the product
   is associative. Going down again fixes the best state at every boundary.
4. Each chunk is backtraced alone between its two states, and the pieces are put together.

Weights. ``objective="unigram"`` adds piece scores: the best segmentation. ``objective="bpe"`` is for
merge models as the public one: a segmentation is what the merges yield exactly if every piece is
what its own text merges to and every two neighbours are what their joint text merges to. So a way
weighs 0 if all its neighbours agree and -inf otherwise, and the one way left is the library's
result (tests compare with the library text by text).

Where no piece holds a space mark behind another character, nothing crosses a word start: the
lattice passes through one point there, the matrix is an outer sum, and whole words inside a chunk
are looked up in a bounded table filled by the library. Otherwise the lattice is walked in full.

Normalisation is the model's: a leading space mark, spaces as marks, byte pieces for unknown
characters. Decoding undoes it; a literal U+2581 in a text reads as a space afterwards.

Edge cases: null and empty texts have no ids; repeated rows (also of one id) are encoded each on
its own; an empty table gives no rows; other columns pass through ``encode`` untouched, whatever they are called
(rows travel as one struct; a column called like ``out`` is replaced). Memory: a task holds an Arrow batch and the ids of one
text at a time as Python objects; very long texts are cut into windows that are handed on in steps.
"""
from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from kandle.llm.common import materialize, python_ready
from kandle.llm.token_files import steps

MARK = "▁"
NEG = float("-inf")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Scan:
    path: str = ""  # "": the public model
    objective: str = "bpe"
    giant_chars: int = 16384
    chunk_chars: int = 8192
    fan: int = 32


class Pieces:
    """Vocabulary, lattice and word table. ``words`` encodes a list of words (marks as spaces, first mark left out)."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], objective: str, words=None, table: int = 200_000):
        self.scores, self.byte_ids, self.bpe = scores, byte_ids, objective == "bpe"
        self.longest = max(map(len, scores), default=1)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in scores) and words is not None
        self.words, self.table, self.known, self.pairs, self.own = words, table, {}, {}, {}

    @classmethod
    def load(cls, path: str, objective: str) -> "Pieces":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        scores, byte_ids = {}, [0] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                scores[p] = (i, sp.get_score(i))
        self = cls(scores, byte_ids, objective, lambda ws: sp.encode(ws, num_threads=1))
        raw = [sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                raw[i] = b""
        self.raw = raw
        return self

    # ------------------------------------------------------------ lattice
    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored neighbours first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s[1] > best):
                    best, at = s[1], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: str, b: str) -> bool:
        if not a or not self.bpe:
            return True
        k = (a, b)
        if k not in self.pairs:
            if len(self.pairs) > self.table:
                self.pairs.clear()
            self.pairs[k] = self.merged(a + b) == [a, b]
        return self.pairs[k]

    def at(self, s: str, p: int, end: int) -> list[str]:
        """Pieces starting at ``p``: of the vocabulary, and the character itself if it is no piece."""
        out = []
        for q in range(p + 1, min(p + self.longest, end) + 1):
            t = s[p:q]
            if t in self.scores:
                if self.bpe and t not in self.own:
                    self.own[t] = self.merged(t) == [t]
                if not self.bpe or self.own[t]:
                    out.append(t)
        if s[p] not in self.scores:
            out.append(s[p])
        return out

    def weight(self, piece: str) -> float:
        if self.bpe:
            return 0.0
        # an unknown character weighs less than any piece
        return self.scores[piece][1] if piece in self.scores else self.worst

    @property
    def worst(self) -> float:
        if not hasattr(self, "_worst"):
            self._worst = min((s for _, s in self.scores.values()), default=0.0) - 10.0
        return self._worst

    def is_cut(self, s: str, p: int) -> bool:
        return self.cuts and 0 < p < len(s) and s[p] == MARK and s[p - 1] != MARK

    def states(self, s: str, b: int) -> list[tuple[int, str]]:
        """(end, piece) of the pieces that start before ``b`` and end at or behind it; one state at a word start."""
        if b <= 0 or b >= len(s) or self.is_cut(s, b):
            return [(b, "")]
        out = []
        for p in range(max(0, b - self.longest), b):
            out += [(p + len(t), t) for t in self.at(s, p, len(s)) if p + len(t) >= b]
        return sorted(set(out))

    def walk(self, s: str, start: tuple[int, str], stop: int) -> dict:
        """Best ways from a state to the pieces that reach ``stop``: {(end, piece): (weight, state before)},
        with all states on the way."""
        best = {start: (0.0, None)}
        by_pos = {start[0]: [start]}
        for p in range(start[0], stop):
            here = by_pos.get(p)
            if not here:
                continue
            for t in self.at(s, p, len(s)):
                to, w = (p + len(t), t), self.weight(t)
                for st in here:
                    v = best[st][0] + w
                    if (to not in best or v > best[to][0]) and self.agree(st[1], t):
                        if to not in best:
                            by_pos.setdefault(to[0], []).append(to)
                        best[to] = (v, st)
        return best

    @staticmethod
    def trace(best: dict, st: tuple[int, str]) -> list[str]:
        out = []
        while best[st][1] is not None:
            out.append(st[1])
            st = best[st][1]
        return out[::-1]

    def top(self, best: dict, at: int):
        """The best state that ends at a point all ways pass through."""
        ends = [k for k in best if k[0] == at]
        return max(ends, key=lambda k: (best[k][0], k[1])) if ends else None

    # ------------------------------------------------------------ words
    def learn(self, words) -> None:
        new = list(set(words).difference(self.known))
        if len(self.known) > self.table:
            self.known.clear()
            new = list(set(words))
        if new:
            for w, ids in zip(new, self.words([w[1:].replace(MARK, " ") for w in new])):
                # the library drops a lone mark
                self.known[w] = np.array(ids if w != MARK else [self.scores[MARK][0]], np.uint32).tobytes()

    def word_ids(self, words: list[str]) -> bytes:
        self.learn(words)
        return b"".join(map(self.known.__getitem__, words))

    def ids(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            out += [self.scores[p][0]] if p in self.scores else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return np.array(out, np.uint32).tobytes()

    # ------------------------------------------------------------ chunks
    def _spans(self, s: str, b: int, e: int):
        """First and last word start inside (b, e), or None."""
        if not self.cuts:
            return None
        at = [m.start() + 1 for m in re.finditer(f"[^{MARK}]{MARK}", s[max(b, 0):e])]
        at = [max(b, 0) + x for x in at if b < max(b, 0) + x < e]
        return (at[0], at[-1]) if at else None

    def _middle(self, s: str, c1: int, c2: int) -> tuple[bytes, float]:
        raw = self.word_ids(re.findall(f"{MARK}+[^{MARK}]*", s[c1:c2]))
        if self.bpe:
            return raw, 0.0
        by_id = getattr(self, "_by_id", None)
        if by_id is None:
            by_id = self._by_id = {i: w for i, w in self.scores.values()}
        return raw, float(sum(by_id.get(i, self.worst) for i in np.frombuffer(raw, np.uint32).tolist()))

    def matrix(self, s: str, b: int, e: int) -> np.ndarray:
        """Transfer matrix of s[b:e]; ``s`` holds ``longest`` characters more on either side where there are any."""
        left, right = self.states(s, b), self.states(s, e)
        index = {st: j for j, st in enumerate(right)}
        m = np.full((len(left), len(right)), NEG)
        spans = self._spans(s, b, e)

        def ends(best) -> np.ndarray:
            v = np.full(len(right), NEG)
            for st, (w, _) in best.items():
                if right == [(e, "")]:
                    if st[0] == e:
                        v[0] = max(v[0], w)
                elif st in index:
                    v[index[st]] = max(v[index[st]], w)
            return v

        if spans is None:
            for i, st in enumerate(left):
                m[i] = ends(self.walk(s, st, e))
            return m
        c1, c2 = spans
        tail = ends(self.walk(s, (c2, ""), e))
        mid = 0.0 if self.bpe else self._middle(s, c1, c2)[1]
        for i, st in enumerate(left):
            best = self.walk(s, st, c1)
            k = self.top(best, c1)
            if k is not None:
                m[i] = best[k][0] + mid + tail
        return m

    def backtrace(self, s: str, b: int, e: int, i: int, j: int) -> bytes:
        """Ids of the pieces that start in s[b:e], on the best way from state i to state j."""
        left, right = self.states(s, b), self.states(s, e)

        def last(best):
            return self.top(best, e) if right == [(e, "")] else right[j]

        spans = self._spans(s, b, e)
        if spans is None:
            best = self.walk(s, left[i], e)
            return self.ids(self.trace(best, last(best)))
        c1, c2 = spans
        head = self.walk(s, left[i], c1)
        tail = self.walk(s, (c2, ""), e)
        return (self.ids(self.trace(head, self.top(head, c1))) + self._middle(s, c1, c2)[0]
                + self.ids(self.trace(tail, last(tail))))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def boundary_states(mats: list[np.ndarray], i: int, j: int) -> list[int]:
    """States at all boundaries of a run of matrices, given the first and the last; the lowest of equals."""
    fwd = [mats[0][i]]
    for m in mats[1:]:
        fwd.append((fwd[-1][:, None] + m).max(0))
    out = [j]
    for t in range(len(mats) - 1, 0, -1):
        out.append(int(np.argmax(fwd[t - 1] + mats[t][:, out[-1]])))
    return [i] + out[::-1]


_LOADED: dict = {}


def pieces(scan: Scan) -> Pieces:
    key = (scan.path, scan.objective)
    if key not in _LOADED:
        _LOADED[key] = Pieces.load(scan.path or model_path(), scan.objective)
    return _LOADED[key]


def escaped(text: str) -> str:
    return MARK + text.replace(" ", MARK)


# ---------------------------------------------------------------- Spark
def _lists(parts: list[bytes]) -> pa.ListArray:
    """Id lists as one Arrow array; no Python object per id."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))


def _text_ids(m: Pieces, text: str | None) -> bytes:
    if not text:
        return b""
    s = escaped(text)
    return m.word_ids(re.findall(f"{MARK}+[^{MARK}]*", s)) if m.cuts else m.backtrace(s, 0, len(s), 0, 0)


def _fields(m: Pieces, ids: bytes, text: str | None) -> tuple:
    """n_tokens, crc32 of the ids as little-endian unsigned 32-bit integers, whether decoding gives the text."""
    x = np.frombuffer(ids, "<u4")
    return len(x), zlib.crc32(ids), decoded(m, x) == (text or "").replace(MARK, " ")


#: a step of the Arrow functions below holds about so many characters of text as Python objects
STEP_CHARS = 1 << 18
#: fields of the report
REPORT = "n_tokens long, ids_crc32 long, round_trip boolean"


def _short_ids(scan: Scan, text: str, keep: list[str]):
    """Rows (doc) -> (doc: its columns ``keep``, enc: ids and report fields), handed on in steps."""
    def encode(batches):
        m = pieces(scan)
        for batch in batches:
            doc = batch.column("doc")
            texts = doc.field(text)
            kept = pa.StructArray.from_arrays([doc.field(c) for c in keep], keep)
            for i, j in steps(_lengths(texts), STEP_CHARS):
                ids, rows = [], []
                for t in texts.slice(i, j - i):
                    t = t.as_py()
                    raw = _text_ids(m, t)
                    ids.append(raw)
                    rows.append(_fields(m, raw, t))
                yield pa.RecordBatch.from_arrays([kept.slice(i, j - i), _enc(_lists(ids), rows)], ["doc", "enc"])

    return encode


def _lengths(texts: pa.Array) -> list[range]:
    """Stand-ins for the texts, as long as they are in bytes."""
    return [range(n) for n in pc.fill_null(pc.binary_length(texts), 0).to_pylist()]


def _enc(ids: pa.Array, rows: list[tuple]) -> pa.StructArray:
    n, crc, same = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays([ids, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                                      ["ids", "n_tokens", "ids_crc32", "round_trip"])


def _windows(scan: Scan):
    def windows(frames):
        """A window at a time; what is handed on holds about STEP_CHARS characters."""
        pad, size = pieces(scan).longest, scan.chunk_chars
        rows, held = [], 0
        for batch in frames:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text")):
                s = escaped(text.as_py())
                for k, b in enumerate(range(0, len(s), size)):
                    lo, e = max(0, b - pad - 1), min(len(s), b + size)
                    rows.append((rid, k, s[lo:e + pad + 1], b - lo, e - lo))
                    held += e - lo
                    if held >= STEP_CHARS:
                        yield _window_batch(rows)
                        rows, held = [], 0
        if rows:
            yield _window_batch(rows)

    return windows


WINDOW = "rid long, chunk long, win string, b int, e int"


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    rid, chunk, win, b, e = zip(*rows)
    return pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "win": pa.array(win, pa.string()),
                                       "b": pa.array(b, pa.int32()), "e": pa.array(e, pa.int32())})


def _matrices(scan: Scan):
    def matrices(win: pd.Series, b: pd.Series, e: pd.Series) -> pd.DataFrame:
        m, rows = pieces(scan), []
        for s, x, y in zip(win, b, e):
            a = m.matrix(s, x, y)
            rows.append((a.shape[0], a.shape[1], a.ravel()))
        return pd.DataFrame(rows, columns=["r", "c", "m"])

    return F.pandas_udf(matrices, "r int, c int, m array<double>")


def _traces(scan: Scan):
    def traces(win: pa.Array, b: pa.Array, e: pa.Array, i: pa.Array, j: pa.Array) -> pa.Array:
        m = pieces(scan)
        at = zip(*(x.to_pylist() for x in (b, e, i, j)))
        return _lists([m.backtrace(s.as_py(), *w) for s, w in zip(win, at)])

    return F.arrow_udf(traces, "array<int>")


def _mats(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(m, float).reshape(r, c) for r, c, m in zip(pdf["r"], pdf["c"], pdf["m"])]


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    acc, *rest = _mats(pdf)
    for m in rest:
        acc = product(acc, m)
    return pd.DataFrame([(pdf["rid"].iloc[0], pdf["grp"].iloc[0], acc.shape[0], acc.shape[1], acc.ravel())],
                        columns=["rid", "chunk", "r", "c", "m"])


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    st = boundary_states(_mats(pdf), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]))
    return pd.DataFrame({"rid": pdf["rid"], "chunk": pdf["chunk"], "i": st[:-1], "j": st[1:]})


def scan_giants(giants: DataFrame, scan: Scan) -> DataFrame:
    """(rid, text) of giant documents -> (rid, ids)."""
    # small in bytes but not in work: keep the tasks AQE would merge
    tasks = int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    win = giants.select("rid", "text").mapInArrow(_windows(scan), WINDOW)
    win = materialize(win.repartition(tasks, "rid", "chunk"), "windows", "zstd")
    level = materialize(win.select("rid", "chunk", _matrices(scan)("win", "b", "e").alias("x")).select("rid", "chunk", "x.*"), "matrices-0")
    levels = [level]
    top = level.agg(F.max("chunk")).first()[0] or 0
    while top > 0:
        grouped = levels[-1].withColumn("grp", F.floor(F.col("chunk") / scan.fan).cast("long"))
        up = grouped.repartition(tasks, "rid", "grp").groupBy("rid", "grp").applyInPandas(_combine, "rid long, chunk long, r int, c int, m array<double>")
        levels.append(materialize(up, f"matrices-{len(levels)}"))
        top //= scan.fan
    bounds = levels[-1].select("rid", "chunk", F.lit(0).alias("i"), F.lit(0).alias("j"))
    for lower in levels[-2::-1]:
        held = lower.withColumn("grp", F.floor(F.col("chunk") / scan.fan).cast("long")).join(
            bounds.withColumnRenamed("chunk", "grp"), ["rid", "grp"]).repartition(tasks, "rid", "grp")
        bounds = held.groupBy("rid", "grp").applyInPandas(_resolve, "rid long, chunk long, i int, j int")
    traced = win.join(bounds, ["rid", "chunk"]).repartition(tasks, "rid", "chunk").select("rid", "chunk", _traces(scan)("win", "b", "e", "i", "j").alias("ids"))
    # the ids of one document, no more than a few times its text
    whole = traced.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("all"))
    return whole.select("rid", F.flatten(F.col("all.ids")).alias("ids"))


def _encoded(docs: DataFrame, text: str, scan: Scan, keep: list[str]) -> DataFrame:
    """(doc: the columns ``keep`` of a row, enc: its ids and report fields) of every row."""
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.withColumn(text, docs[text].cast("string"))
    schema = T.StructType([docs.select(F.struct(*[docs[c] for c in keep]).alias("doc")).schema["doc"],
                           T.StructField("enc", T.StructType.fromDDL(f"ids array<int>, {REPORT}"))])
    rows = docs.select(F.struct(*[docs[c] for c in dict.fromkeys([*keep, text])]).alias("doc"))
    of = F.col("doc").getField(text)
    giant = F.coalesce(F.length(of) > scan.giant_chars, F.lit(False))
    short = rows.where(~giant).mapInArrow(_short_ids(scan, text, keep), schema)
    big = materialize(rows.where(giant).select(F.monotonically_increasing_id().alias("rid"), "doc"), "giants", "zstd")
    if big.isEmpty():
        return short
    big = big.withColumn("text", of)
    ids = scan_giants(big.select("rid", "text"), scan)
    long = big.join(ids, "rid").select(F.struct(*[F.col("doc").getField(c).alias(c) for c in keep]).alias("doc"), _with_fields(scan)("ids", "text").alias("enc"))
    return short.unionByName(long)


def encode(docs: DataFrame, text: str = "text", out: str = "token_ids", scan: Scan = Scan()) -> DataFrame:
    """``docs`` with the ids of every whole text in ``out``; a column that is called so already is replaced."""
    enc = _encoded(docs, text, scan, docs.columns)
    return enc.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c != out], F.col("enc.ids").alias(out))


def _with_fields(scan: Scan):
    def fields(ids: pa.Array, texts: pa.Array) -> pa.Array:
        m = pieces(scan)
        return _enc(ids, [_fields(m, x.values.to_numpy().astype("<u4").tobytes(), t.as_py()) for x, t in zip(ids, texts)])

    return F.arrow_udf(fields, f"ids array<int>, {REPORT}")


def decoded(m: Pieces, ids) -> str:
    return b"".join(map(m.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def decode(df: DataFrame, ids: str = "token_ids", out: str = "text", scan: Scan = Scan()) -> DataFrame:
    """Texts of id lists (null ids: null)."""
    python_ready(df.sparkSession)

    def texts(col: pa.Array) -> pa.Array:
        m = pieces(scan)
        return pa.array([decoded(m, x.values.to_numpy()) if x.is_valid else None for x in col], pa.string())

    return df.withColumn(out, F.arrow_udf(texts, "string")(F.col(ids)))


def token_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scan: Scan = Scan()) -> DataFrame:
    """One row per document: id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit), round_trip."""
    enc = _encoded(docs.select(id_col, text), text, scan, [id_col])
    return enc.select(F.col("doc").getField(id_col).alias(id_col), "enc.n_tokens", "enc.ids_crc32", "enc.round_trip")


def tokenised(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", scan: Scan = Scan()) -> DataFrame:
    """One row per document: id, source, the fields of the report and token_ids."""
    enc = _encoded(docs.select(id_col, source, text), text, scan, [id_col, source])
    return enc.select(F.col("doc").getField(id_col).alias(id_col), F.col("doc").getField(source).alias(source),
                      "enc.n_tokens", "enc.ids_crc32", "enc.round_trip", F.col("enc.ids").alias("token_ids"))
