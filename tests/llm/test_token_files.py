import zlib

import numpy as np
import pytest
from data_llm import key, rows
from tokenizers import Tokenizer

from kandle.llm import files, token_files as tf
from kandle.llm.common import scratch_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tf.TokenFormat().tokenizer_path())


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.mark.parametrize("fmt", [tf.TokenFormat(), tf.TokenFormat(part_bytes=2000, slice_docs=3)])
def test_round_trip(edge, none, tok, fmt):
    got = tf.round_trip(edge, fmt).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(
        ((r[0], len(ids_of(tok, r[1])), zlib.crc32(ids_of(tok, r[1]).tobytes())) for r in rows()), key=str)
    # starts: ids of all documents before, in ascending id order
    got.sort(key=lambda r: (r["start"], r["n_tokens"]))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=key)
    assert tf.round_trip(none, fmt).collect() == []


def test_words_apart_equal_whole_texts(tok):
    enc = tf.WordEncoder(tf.TokenFormat().tokenizer_path())
    texts = ["Don't  stop\n\nÀ lá carte x y", "á ́b", "İstanbul ΣΑΣ\tx\x0by", "<|endoftext|> a<|startoftext|>b", "'s 're x's 12 3,4",
             "Word, WORD. word|!? Ünï;: ÀÉ. ß straße, ÿ| a.b x_y it's. ½x ª", "ΑΣ. Σ, İ. ǅ; ﬁ.", "..., ||| !?x"]
    assert [np.frombuffer(b, "<u2").tolist() for b in enc(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_are_flat_and_mapped(edge, spark, tok):
    man = tf.write(edge, scratch_path(spark, "t"), fmt=tf.TokenFormat(part_bytes=5000)).orderBy("part").collect()
    assert len(man) > 1 and [m["base"] for m in man] == list(np.cumsum([0] + [m["n_tokens"] for m in man[:-1]]))
    m = man[0]
    off = files.read_array(m["path"] + ".off", "<i8", 0, m["n_docs"] + 1)
    assert isinstance(off, np.memmap) and off[-1] == m["n_tokens"]
    assert len(files.read_array(m["path"] + ".tok", "<u2", 0, m["n_tokens"])) == m["n_tokens"]
