import random
import zlib

import numpy as np
import pytest
import sentencepiece
from data_llm import DOCS, rows

from kandle.llm import sp_scan as sc


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=sc.model_path())


def chunked(m, text, size):
    s, pad, win = sc.escaped(text), m.longest, []
    for b in range(0, len(s), size):
        lo, e = max(0, b - pad - 1), min(len(s), b + size)
        win.append((s[lo:e + pad + 1], b - lo, e - lo))
    mats = [m.matrix(*w) for w in win]
    st = sc.boundary_states(mats, 0, 0)
    return np.frombuffer(b"".join(m.backtrace(*w, st[k], st[k + 1]) for k, w in enumerate(win)), np.uint32).tolist()


def test_chunks_equal_the_library(lib):
    m, rng = sc.Pieces.load(sc.model_path(), "bpe"), random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "    ", "\n", "é", "日本", "\U0001F600", "x" * 9, "tion", ".", "|", " the", "▁"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert chunked(m, t, rng.randint(3, 30)) == lib.encode(t), t


def test_without_word_starts(lib):
    """The lattice walked in full (no look-up of words), as for a vocabulary whose pieces cross spaces."""
    m = sc.Pieces.load(sc.model_path(), "bpe")
    m.cuts = False
    for t in ("internationalization and normalisation of the", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "xx  yy   zz"):
        assert chunked(m, t, 7) == lib.encode(t)


def test_unigram_is_the_best_segmentation():
    """Against all segmentations, with pieces that cross spaces."""
    rng = random.Random(5)
    vocab = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "a▁", "▁a", "b▁c", "cab", "▁▁"]
    m = sc.Pieces({p: (i + 256, -rng.uniform(0.5, 6)) for i, p in enumerate(vocab)}, list(range(256)), "unigram")

    def best(s):
        v = [0.0] + [sc.NEG] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 4), e):
                if s[b:e] in m.scores:
                    v[e] = max(v[e], v[b] + m.scores[s[b:e]][1])
                elif e - b == 1:
                    v[e] = max(v[e], v[b] + m.worst)
        return v[-1]

    by_id = {i: w for i, w in m.scores.values()}
    for _ in range(200):
        t = "".join(rng.choice("abc d") for _ in range(rng.randint(1, 25)))
        got = sum(by_id.get(i, m.worst) for i in chunked(m, t, rng.randint(2, 9)))
        assert abs(got - best(sc.escaped(t))) < 1e-9


def test_product_is_associative():
    rng = np.random.default_rng(2)
    a, b, c = (rng.normal(size=s) for s in ((2, 3), (3, 4), (4, 2)))
    assert np.allclose(sc.product(sc.product(a, b), c), sc.product(a, sc.product(b, c)))


@pytest.mark.parametrize("scan", [sc.Scan(), sc.Scan(giant_chars=40, chunk_chars=23, fan=3)])
def test_report(edge, none, lib, scan):
    """Whole texts, and with nearly every text as a giant over several levels."""
    got = sorted((tuple(r) for r in sc.token_report(edge, scan=scan).collect()), key=str)
    want = []
    for r in rows():
        ids = np.array(lib.encode(r[1] or ""), "<u4")
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes()), True))
    assert got == sorted(want, key=str)
    assert sc.token_report(none, scan=scan).collect() == []


def test_encode_keeps_columns_and_decodes(edge):
    enc = sc.encode(edge, scan=sc.Scan(giant_chars=500, chunk_chars=100))
    assert enc.columns == DOCS.names + ["token_ids"]
    back = sc.decode(enc.withColumnRenamed("text", "was"), out="text").select("was", "text").collect()
    assert all((r["was"] or "") == r["text"] for r in back)


def test_clashing_names_and_long_texts(spark, edge, lib):
    from pyspark.sql import functions as F
    from kandle.llm.sp_scan import Scan, encode
    odd = edge.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("token_ids", "doc", "enc", "rid", "ids", "chunk", "a b", "n_tokens")])
    got = encode(odd, scan=Scan(giant_chars=500, chunk_chars=200, fan=3))
    assert set(got.columns) == set(odd.columns)
    assert sorted((r["doc_id"], r["token_ids"], r["a b"]) for r in got.where("doc_id is not null").collect()) == sorted(
        (r[0], lib.encode(r[1] or ""), 7) for r in rows() if r[0] is not None)


def test_worker_memory_is_bounded():
    """10,000 texts of 2,300 characters in one Arrow batch: a worker's peak grows by little more than the batch itself."""
    import subprocess
    import sys
    code = """
import resource, random
import pyarrow as pa
from kandle.llm.sp_scan import Scan, _short_ids
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(60000)]
doc = pa.StructArray.from_arrays([pa.array([" ".join(rng.choices(words, k=360)) for _ in range(10000)])], ["text"])
batch = pa.RecordBatch.from_arrays([doc], ["doc"])
run = _short_ids(Scan(), "text", ["text"])
next(run(iter([batch.slice(0, 10)])))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in run(iter([batch])))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd="/root/repo").stdout.split())
    assert n == 10000 and grown < 100, grown
