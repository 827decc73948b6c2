"""Quality rules: compression bands (operator 1).

Zstandard ratios (raw bytes / compressed bytes) of the whole document and of fixed-size chunks.
Repetitive text compresses too well, random or encoded text hardly at all; both limits depend on
the length, since a short text has little history to draw on. The greatest ratios of whole texts are learned from labelled
texts: per half octave of length, the 99.5th percentile of good training texts and 3.5 % on top (``fit_limits``). A document is rejected when its
whole ratio leaves the band of its length class, or when more than ``bad_chunk_share`` of its
chunks leave the chunk band. Chunks are laid from the head and, if that leaves a rest, from the end as well;
the worse count is the document's, so every byte is judged and junk weighs the same at either end. Texts of
less than two chunks are cut into short chunks with a band of their own. The base rule (fewer than 50 words, or
over half of the words inside repeated 3-word windows) rejects as well.

Each document is judged alone: no shuffle, one Arrow batch at a time.

Edge cases: null and empty texts have no words and are rejected by the base rule (ratio null);
a text shorter than one short chunk counts as one chunk; repeated rows get equal verdicts; an empty
table gives no rows; further columns are passed through untouched by ``with_quality``.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kandle.llm.common import python_ready
from kandle.llm.labelled import training_rows


#: Learned by ``fit_limits`` on the labelled rows of 10,000 documents outside the held-out fold: half octave of the length in bytes
#: (k: from 2^(k/2) bytes on) -> greatest ratio. Of held-out texts that the base rule keeps they reject 39 of 63 bad and 0 of 670 good
#: ones; of 18,251 labelled texts of another table, 920 of 1,345 bad and 6 of 16,906 good ones.
LEARNED = {16: 1.716, 17: 1.892, 18: 1.919, 19: 2.012, 20: 2.093, 21: 2.158, 22: 2.213, 23: 2.272, 24: 2.347, 25: 2.415, 26: 2.45,
           27: 2.486, 28: 2.521, 29: 2.521}
#: least ratios: of encoded or random text, well below any prose. (bytes below, ratio)
LEAST = ((256, 0.90), (512, 1.05), (1024, 1.15), (2048, 1.36), (4096, 1.38), (16384, 1.40), (float("inf"), 1.42))


def whole_bands(learned: dict, open_end: float = 4.6) -> tuple:
    """(bytes below, least ratio, greatest ratio), ascending; lengths for which nothing is learned keep a wide limit."""
    ends = sorted({float(b) for b, _ in LEAST} | {2 ** ((k + 1) / 2) for k in learned} | {2 ** (min(learned) / 2)})
    out, at = [], 1.0
    for end in ends:
        least = next(r for below, r in LEAST if at < below)
        k = int(math.floor(2 * math.log2(at) + 1e-9))
        out.append((end, least, learned.get(k, 3.0 if k < min(learned) else open_end)))
        at = end
    return tuple(out)


@dataclass(frozen=True)
class Bands:
    """``whole``: (bytes below, least ratio, greatest ratio), ascending; the last row has no end."""
    level: int = 3
    chunk_bytes: int = 2048
    whole: tuple = whole_bands(LEARNED)
    chunk: tuple = (1.36, 3.8)
    #: for texts of less than two chunks; 256 bytes of base64 reach 1.08, of labelled prose 1.22 to 1.71 (sf0.1)
    short_bytes: int = 256
    short: tuple = (1.10, 3.0)
    bad_chunk_share: float = 0.25
    min_words: int = 50
    repeat_pct: int = 50


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean")
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrence included."""
    mark, first = bytearray(len(words)), {}
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(w, i)
        if j != i:
            mark[i:i + 3] = b"\1\1\1"
            mark[j:j + 3] = b"\1\1\1"
    return sum(mark)


def profile(text: str | None, bands: Bands, compress) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes.split() knows exactly the six ASCII white-space characters
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    repeat = repeated_words(words)
    n = len(words)
    base_failed = n < bands.min_words or 100 * repeat > bands.repeat_pct * n
    if not raw:
        return n, chars, symbols, dup, repeat, None, 0, 0, base_failed, False
    ratio = len(raw) / len(compress(raw))
    low, high = next((lo, hi) for below, lo, hi in bands.whole if len(raw) < below)
    size, (least, most) = bands.chunk_bytes, bands.chunk
    if len(raw) < 2 * size:
        size, (least, most) = bands.short_bytes, bands.short
    view, n_chunks = memoryview(raw), len(raw) // size
    bad = 0
    for start in {0, len(raw) - n_chunks * size}:
        chunks = (view[i:i + size] for i in range(start, start + n_chunks * size, size))
        bad = max(bad, sum(not least <= size / len(compress(c)) <= most for c in chunks))
    in_band = low <= ratio <= high and bad <= bands.bad_chunk_share * n_chunks
    return (n, chars, symbols, dup, repeat, ratio, max(1, n_chunks), bad if n_chunks else int(not in_band),
            base_failed, in_band and not base_failed)


def _udf(bands: Bands):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def profiles(texts: pd.Series) -> pd.DataFrame:
        import zstandard
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        return pd.DataFrame([profile(t, bands, compress) for t in texts], columns=names)

    return F.pandas_udf(profiles, SCHEMA)


def with_quality(docs: DataFrame, text: str = "text", out: str = "quality_bands",
                 bands: Bands = Bands()) -> DataFrame:
    """``docs`` with a struct column ``out`` (fields of ``SCHEMA``)."""
    python_ready(docs.sparkSession)
    return docs.withColumn(out, _udf(bands)(F.col(text)))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   bands: Bands = Bands()) -> DataFrame:
    """One row per document: its id and the fields of ``SCHEMA``."""
    q = with_quality(docs.select(id_col, text), text, "_q", bands)
    return q.select(id_col, "_q.*")


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their own columns only."""
    mark = "__quality_bands"
    return with_quality(docs, text, mark, bands).where(f"{mark}.kept").select(*docs.columns)


def fit_limits(docs: DataFrame, labels: DataFrame, share: float = 0.995, margin: float = 0.035, id_col: str = "doc_id", text: str = "text",
               least: int = 3) -> dict[int, float]:
    """Greatest ratio per half octave of length, from labelled training rows that the base rule keeps: the ``share`` percentile of
    the good ones and ``margin`` on top, never falling with the length. Lengths with fewer than ``least`` good texts learn nothing.
    A few dozen numbers, from counts over all labelled rows."""
    good = training_rows(docs, labels, "quality", id_col, text).where("y = 1").select("id", "text")
    q = with_quality(good, "text", "q").where("NOT q.base_failed").select("q.ratio", F.octet_length("text").alias("n"))
    k = F.floor(F.log2("n") * 2).cast("int")
    rows = q.groupBy(k.alias("k")).agg(F.percentile("ratio", share).alias("top"), F.count("*").alias("c")).where(F.col("c") >= least).orderBy("k").collect()
    out, most = {}, 0.0
    for r in rows:
        most = max(most, r["top"] * (1 + margin))
        out[r["k"]] = round(most, 3)
    return out
