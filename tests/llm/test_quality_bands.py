import base64
import random

import pytest
import zstandard
from data_llm import DOCS, WORD, rows

from kandle.llm import quality_bands as qb


def brute_base(text):
    w = WORD.findall(text or "")
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    dup, seen = 0, []
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.append(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_report_matches_brute_force(edge):
    got = sorted((tuple(r[:6]) + (r["base_failed"],) for r in qb.quality_report(edge).collect()), key=str)
    want = []
    for r in rows():
        n = brute_base(r[1])
        want.append((r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("text", ["a\nb\na\n \n \na b", "x\x0by\x0cz", " a b", "a b c a b c a", "a\r\nb\r\nb\r\nb"])
def test_base_counts(text):
    assert qb.profile(text, qb.Bands(), zstandard.ZstdCompressor(3).compress)[:5] == brute_base(text)


def test_bands_reject_both_ends():
    rng = random.Random(1)
    squeeze = zstandard.ZstdCompressor(level=3).compress

    def kept(t):
        return qb.profile(t, qb.Bands(), squeeze)[-1]

    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(900))
    assert kept(prose)
    code = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) + chr(rng.randint(33, 0x7F0)) for _ in range(12)) for _ in range(300))
    assert not kept(code)  # hardly compressible
    lines = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(12)) for _ in range(6)]
    boiler = " ".join(f"{rng.choice(lines)} {i}" for i in range(200))
    assert not kept(boiler)
    half = prose + " " + " ".join("spam" + str(i % 7) for i in range(900))  # repetitive chunks in a good document
    assert not kept(half)


@pytest.mark.parametrize("good, junk", [(2048, 1990), (600, 500), (1200, 700), (2600, 1300), (4600, 2040), (9000, 4090)])
def test_junk_is_judged_wherever_it_stands(good, junk):
    rng = random.Random(good)
    squeeze = zstandard.ZstdCompressor(level=3).compress

    def profile(t):
        return qb.profile(t, qb.Bands(), squeeze)

    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = ""
    while len(prose) < good:
        prose += rng.choice(vocabulary) + " "
    prose, encoded = prose[:good], base64.b64encode(rng.randbytes(junk))[:junk].decode()
    # a line break each 76 characters, so that the base rule's words are there
    encoded = "\n".join(encoded[i:i + 76] for i in range(0, junk, 77))
    assert profile(prose)[-1] and profile(prose)[-3] == 0
    for t in (prose + " " + encoded, encoded + " " + prose):
        assert profile(t)[-3] > 0 and not profile(t)[-1]


def test_overlap_of_the_layouts_counts_once():
    rng = random.Random(3)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000))
    junk = base64.b64encode(rng.randbytes(4096)).decode()
    got = qb.profile(prose[:4 * 2048] + junk[:2048] + "x", qb.Bands(), squeeze)
    assert got[6:8] == (5, 1) and got[-1]  # a fifth of the bytes is junk
    assert qb.profile(prose[:4 * 2048], qb.Bands(), squeeze)[6:8] == (4, 0)
    assert [qb.profile(prose[:n], qb.Bands(), squeeze)[6] for n in (255, 300, 512, 4095, 4097)] == [1, 1, 2, 15, 2]


def test_keep_good_keeps_columns(edge, none):
    good = qb.keep_good(edge)
    assert good.columns == edge.columns
    kept = {r["doc_id"] for r in qb.quality_report(edge).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and kept
    assert qb.quality_report(none).collect() == [] and qb.keep_good(none).collect() == []
    assert DOCS.names == good.columns


def brute_verdict(text):
    """The verdict from the rule's description alone: limits by length, chunks from the head and from the end."""
    raw, size_of = (text or "").encode("utf-8", "replace"), lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    n_words, _, _, _, repeated = brute_base(text)
    if n_words < 50 or 100 * repeated > 50 * n_words:
        return False
    n = len(raw)
    if n < 256:
        most = 3.0
    elif n >= 32768:
        most = 4.6
    else:
        most = qb.LEARNED[max(k for k in qb.LEARNED if n >= 2 ** (k / 2))]
    least = 0.9 if n < 256 else 1.05 if n < 512 else 1.15 if n < 1024 else 1.36 if n < 2048 else 1.38 if n < 4096 else 1.4 if n < 16384 else 1.42
    if not least <= n / size_of(raw) <= most:
        return False
    chunk, low, high = (2048, 1.36, 3.8) if n >= 4096 else (256, 1.10, 3.0)
    worst = 0
    for start in (0, n % chunk):
        part = [raw[i:i + chunk] for i in range(start, n - chunk + 1, chunk)]
        worst = max(worst, sum(not low <= chunk / size_of(c) <= high for c in part))
    return worst <= 0.25 * (n // chunk)


SF01 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, qb.quality_report(docs).join(labels, "doc_id").cache()


def test_verdict_matches_brute_force(spark, edge, labelled):
    got = {(r["doc_id"], r["kept"]) for r in qb.quality_report(edge).collect() if r["doc_id"] is not None}
    assert got == {(r[0], brute_verdict(r[1])) for r in rows() if r[0] is not None}
    docs, _, report = labelled
    some = report.join(docs.select("doc_id", "text"), "doc_id").where("doc_id % 7 = 0").select("kept", "text").collect()
    assert len(some) > 300 and all(r["kept"] == brute_verdict(r["text"]) for r in some)


def test_limits_are_learned_and_bind(labelled):
    """The shipped limits follow from the training rows; on held-out rows they reject most bad texts and hardly a good one."""
    docs, labels, report = labelled
    learned = qb.fit_limits(docs, labels)
    assert set(learned) == set(qb.LEARNED) and all(abs(learned[k] - v) < 2e-3 for k, v in qb.LEARNED.items())
    from kandle.llm.labelled import fold
    held = report.where(fold("doc_id") == 0).where("NOT base_failed").groupBy("quality").pivot("kept", [True, False]).count().fillna(0).collect()
    by = {r["quality"]: (r["true"], r["false"]) for r in held}
    assert by[0][1] > 0.6 * sum(by[0]) and by[1][1] < 0.01 * sum(by[1])
