"""Token-id output (operator 2): flat unsigned integer files, 64-bit document offsets, prefix-sum bases.

Format, per part (parts follow each other in ascending id order):
  <part>.tok   token ids of all documents, one after the other, little-endian unsigned integers of
               16 bits if the vocabulary allows, else of 32
  <part>.off   n_docs + 1 little-endian signed 64-bit offsets into <part>.tok, in ids
  <part>.doc   n_docs little-endian signed 64-bit document ids (-2^63 for a null id)
and one manifest row per part (path, n_docs, n_tokens, base). A part's base, the number of ids
before it in the whole corpus, is the prefix sum of the earlier parts' n_tokens: parts are written
independently and a document starts at base + offset.

Encoding runs before the range shuffle (ids are smaller than texts) and once only: encoded rows are
written to the shared folder, since range partitioning looks at its input twice. Where the tokenizer's
settings say that its rules never join across spaces and line ends, words between them are encoded apart, many in
one library call, and kept in a bounded table (tests compare with whole-text calls); other tokenizers encode whole texts.
Equal ids are spread over parts by the hash of their tokens, so no id can flood a part.

Edge cases: null and empty texts hold the end id alone; null ids come first; repeated rows are
written each; an empty table gives no parts and no rows; further columns are not read.
"""
from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kandle.llm import files
from kandle.llm.common import materialize, python_ready, scratch_path

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class TokenFormat:
    path: str = ""  # "": the public word BPE
    end_id: int = 2
    part_bytes: int = 64 << 20
    slice_docs: int = 4096  # documents a reader task row covers

    def tokenizer_path(self) -> str:
        if self.path:
            return self.path
        import public_tokenizers
        return public_tokenizers.path("word_bpe_49k.json")


_LOADED: dict = {}


#: letters that the normaliser takes one by one: composed already, and their lower case is one letter
_LETTERS = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº"]
_LATIN = re.compile(f"[{''.join(_LETTERS)}]+")
#: ASCII signs but the apostrophe, which may join the letters before it
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _words_apart(spec: dict) -> bool:
    """Whether a tokenizer file cuts at every space and line end and drops them, so that a text's ids are those of
    its words one after the other, the last piece of every pre-token marked: told by its settings."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer")])
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer")])[0] or {}
    model = spec.get("model") or {}
    return (all(n is None or n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
                for n in steps)
            and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and r"[\p{L}]+|" in first["pattern"].get("Regex", "") and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
            and bool(model.get("end_of_word_suffix")) and not model.get("ignore_merges") and not model.get("dropout"))


class WordEncoder:
    """Ids of texts by way of a bounded table of words. New words of plain letters go straight to the merges. Other
    new words are encoded many at a time, as one text: words of letters alone are one pre-token each, so they end where
    a piece with the word-end mark stands; a zero character between the others tells them apart. A tokenizer that does not split like that (``_words_apart``)
    encodes whole texts."""

    def __init__(self, path: str, words: int = 700_000, chunk: int = 4_000):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.known, self.most, self.chunk = {"": b""}, words, chunk
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = _words_apart(spec)
        if self.apart:
            suffix = spec["model"]["end_of_word_suffix"]
            vocab = self.tok.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            zero = self._ids("\0")
            # what the tokenizer's own normaliser and pre-tokenizer make of a letter: its folded bytes as letters
            steps_of = self.tok.normalizer, self.tok.pre_tokenizer
            self.folded = {ord(c): steps_of[1].pre_tokenize_str(steps_of[0].normalize_str(c))[0][0] for c in _LETTERS}
            self.typecode = "H" if self.dtype == "<u2" else "I"
            self.apart = len(zero) == 1
            self.zero = zero[0] if self.apart else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _keep(self, words: list, ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        """Ids of ``words`` up to ``ends``, each followed by ``skip`` ids of no word."""
        raw, size = ids.tobytes(), ids.itemsize
        stop = (ends * size).tolist()
        start = [0] + [e + skip * size for e in stop[:-1]]
        self.known.update(zip(words, [raw[a:b] for a, b in zip(start, stop)]))

    def _learn(self, words: set) -> None:
        new = words.difference(self.known)
        if not new:
            return
        if len(self.known) > self.most:
            self.known, new = {"": b""}, words - {""}
        letters = {w for w in new if w.isalpha()}
        # letters with signs behind them: two pre-tokens, the letters' and the signs'
        signed, mixed = [], set()
        for w in new.difference(letters):
            stem = w.rstrip(_SIGNS)
            if stem.isalpha() and (stem.isascii() or _LATIN.fullmatch(stem)):
                signed.append((w, stem, w[len(stem):]))
            elif w:
                mixed.add(w)
        letters.update({x for _, x, _ in signed}.difference(self.known))
        mixed.update({x for _, _, x in signed}.difference(self.known))
        odd = [w for w in mixed if "\0" in w]
        mixed = list(mixed.difference(odd))
        plain = [w for w in letters if w.isascii() or _LATIN.fullmatch(w)]
        letters = list(letters.difference(plain))
        # plain letters go to the merges at once: folded, and one pre-token each
        merge, code = self.tok.model.tokenize, self.typecode
        self.known.update(zip(plain, [array(code, [t.id for t in merge(w)]).tobytes() for w in " ".join(plain).translate(self.folded).split(" ") if w]))
        for i in range(0, len(letters), self.chunk):
            part = letters[i:i + self.chunk]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self._keep(part, ids, ends, 0)
            else:  # a letter whose lower case is more than letters
                odd += part
        for i in range(0, len(mixed), self.chunk):
            part = mixed[i:i + self.chunk]
            ids = self._ids(" \0 ".join(part) + " \0")
            ends = np.flatnonzero(ids == self.zero)
            if len(ends) == len(part):
                self._keep(part, ids, ends, 1)
            else:
                odd += part
        for w in odd:
            self.known[w] = self._ids(w).tobytes()
        known = self.known
        for w, stem, rest in signed:
            known[w] = known[stem] + known[rest]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def steps(texts, chars: int = 1 << 20):
    """Slices (from, to) of a list of texts that hold about ``chars`` characters each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 64
        if held >= chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _encode(fmt: TokenFormat):
    def encode(texts: pd.Series) -> pd.Series:
        enc = _encoder(fmt.tokenizer_path())
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress  # ids travel and wait compressed
        end = np.array([fmt.end_id], enc.dtype).tobytes()
        out = []
        for i, j in steps(texts):
            out += [pack(b + end) for b in enc([t or "" for t in texts.iloc[i:j]])]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(encode, "binary")


def _id_bytes(spark: SparkSession, fmt: TokenFormat) -> int:
    from tokenizers import Tokenizer
    return 2 if Tokenizer.from_file(fmt.tokenizer_path()).get_vocab_size() <= 1 << 16 else 4


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", fmt: TokenFormat = TokenFormat()) -> DataFrame:
    """Write the files under ``folder`` (shared); the manifest: part, path, width, n_docs, n_tokens, base."""
    spark = docs.sparkSession
    python_ready(spark)
    width = _id_bytes(spark, fmt)
    enc = materialize(docs.select(F.col(id_col).cast("long").alias("id"), _encode(fmt)(F.col(text)).alias("ids")), "encoded", "uncompressed")
    total = enc.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(1, -(-total // fmt.part_bytes), min(spark.sparkContext.defaultParallelism, total // (1 << 20)))
    ranged = enc.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("ids"))
    ranged = ranged.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("ids"))

    def write_part(batches):
        from pyspark import TaskContext
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        store, at = files.open_fs(folder)
        name = files.attempt_name("part")
        out = None
        ends, ids = [], []
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(f"{at}/{name}.tok")
            sizes = []
            for b in batch.column("ids"):
                raw = unpack(b.as_buffer())
                out.write(raw)
                sizes.append(len(raw) // width)
            ends.append(np.array(sizes, np.int64))
            ids.append(pc.fill_null(batch.column("id"), NO_ID).to_numpy())
        if out is None:
            return
        out.close()
        off = np.concatenate([[0], np.cumsum(np.concatenate(ends))]).astype("<i8")
        for suffix, data in (("off", off), ("doc", np.concatenate(ids).astype("<i8"))):
            with store.open_output_stream(f"{at}/{name}.{suffix}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [files.join(folder, name)],
            "width": pa.array([width], pa.int32()), "n_docs": pa.array([len(off) - 1], pa.int64()),
            "n_tokens": pa.array([int(off[-1])], pa.int64())})

    rows = ranged.mapInArrow(write_part, "part long, path string, width int, n_docs long, n_tokens long")
    rows = materialize(rows, "parts")
    # one row per file: prefix sums over a table as short as the folder's listing
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(rows.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def read(manifest: DataFrame, fmt: TokenFormat = TokenFormat()) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit)."""
    python_ready(manifest.sparkSession)
    step = fmt.slice_docs
    slices = manifest.where("n_docs > 0").select(
        "path", "width", "base", "n_docs", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(step))).alias("lo"))
    # a slice row is a few bytes: an explicit count, or AQE would merge them all into one task
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = slices.repartition(tasks, F.col("path"), F.col("lo"))

    def read_slices(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                n = min(step, r.n_docs - r.lo)
                off = np.array(files.read_array(r.path + ".off", "<i8", r.lo, n + 1))
                ids = np.array(files.read_array(r.path + ".doc", "<i8", r.lo, n))
                tok = files.read_array(r.path + ".tok", f"<u{r.width}", int(off[0]), int(off[-1] - off[0]))
                at = off - off[0]
                crc = [zlib.crc32(tok[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy() if (ids != NO_ID).all() else
                                    pd.array([None if i == NO_ID else int(i) for i in ids], "Int64"),
                                    "start": r.base + off[:-1], "n_tokens": np.diff(off), "ids_crc32": crc})

    return slices.mapInPandas(read_slices, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, fmt: TokenFormat = TokenFormat()) -> DataFrame:
    """Write the corpus to the shared folder and read it back."""
    return read(write(docs, scratch_path(docs.sparkSession, "tokens"), fmt=fmt), fmt)
