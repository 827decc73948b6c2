import random

import numpy as np
from data_llm import WORD, docs, key, rows
from pyspark.sql import functions as F

from kandle.llm import minhash as mh

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(data):
    sets = [shingles(r[1]) for r in data]
    comp = list(range(len(data)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = root(i), root(j)
                    comp[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(data)), key=str)


def test_components(edge):
    got = mh.near_report(edge).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_and_hot_group(spark):
    """A chain of copies whose ends are not alike, and many copies of one base with few words changed each."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    data, chain = [], list(base)
    for i in range(12):
        data.append((i, " ".join(chain)))
        for k in rng.sample(range(200), 4):
            chain[k] = f"c{i}x{k}"
    hot = [f"h{i}" for i in range(120)]
    for i in range(150):
        c = list(hot)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            c[k] = f"m{rng.randint(0, 10 ** 6)}"
        data.append((100 + i, " ".join(c)))
    got = mh.near_report(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(data)


def families(copies=300, pairs=5):
    """Texts that share buckets with most others, which they are not alike to (0.69); a few have a partner (0.77)."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(164)]
    texts = [base + [f"o{i}x{k}" for k in range(36)] for i in range(copies)]
    texts += [texts[i][:174] + [f"p{i}x{k}" for k in range(26)] for i in range(pairs)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_links_that_no_hub_ties(spark):
    data = families()
    got = mh.near_report(spark.createDataFrame(data, "doc_id long, text string"), hubs=1, sketch=mh.Sketch(bands=4, rows=1)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(data)


def test_later_passes_compare_what_looks_alike(spark, monkeypatch):
    """200 texts around one passage (0.35) share buckets and no links but those of five pairs; passes compare few of them."""
    rng = random.Random(22)
    texts = [[f"b{i}" for i in range(104)] + [f"o{i}x{k}" for k in range(96)] for i in range(200)]
    texts += [texts[i][:190] + [f"p{i}x{k}" for k in range(10)] for i in range(5)]
    rng.shuffle(texts)
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    asked, plain = [], mh._confirmed

    def confirmed(edges, sets, percent):
        asked.append(edges.count())
        return plain(edges, sets, percent)

    monkeypatch.setattr(mh, "_confirmed", confirmed)
    got = mh.near_report(spark.createDataFrame(data, "doc_id long, text string"), sketch=mh.Sketch(bands=100, rows=2)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(data)
    assert len(asked) > 2 and sum(asked[1:]) < 100


def test_open_links_are_all_links(spark):
    """Random sets of many sizes around shared stocks: the join finds what comparing all pairs finds."""
    rng = random.Random(5)
    stock = [rng.sample(range(10 ** 6), 90) for _ in range(4)]
    sets = []
    for i in range(300):
        k = rng.choice([1, 2, 5, 14, 31, 33, 60, 75, 90])
        sets.append(sorted(set(rng.choice(stock)[:k] + rng.sample(range(10 ** 6), rng.randint(0, k // 3 + 1)))))
    comp = [rng.randint(0, 150) for _ in sets]
    for percent in (75, 60):
        want = {(i, j) for j in range(300) for i in range(j) if comp[i] != comp[j]
                and 100 * len({*sets[i]} & {*sets[j]}) >= percent * len({*sets[i]} | {*sets[j]})}
        members = spark.createDataFrame([(i, len(x), comp[i]) for i, x in enumerate(sets)], "cid long, n long, comp long")
        hashes = spark.createDataFrame(list(enumerate(sets)), "cid long, hashes array<long>")
        got = [(r["a"], r["b"]) for r in mh._open_links(members, hashes, percent).collect()]
        assert len(want) > 500 and sorted(got) == sorted(want)
    n = spark.range(1, 5000).select("id", F.expr(mh._size_class("id")).alias("c")).orderBy("id").collect()
    assert all(0 <= y["c"] - x["c"] <= 1 for x, y in zip(n, n[1:]))


def test_shingler_counts_and_bins():
    sh, band = mh.Shingler(5), mh.Bander(mh.Sketch())
    for r in rows():
        h = sh(r[1])
        assert len(h) == len(shingles(r[1]))
        if len(h):
            assert set(band.sketch(h)) <= set(h.tolist())
    assert (sh("A b C d E f") == sh("a B c D e F")).all() and len(sh("É a b c d")) == len(sh("é a b c d")) == 1
    assert (sh("É a b c d") != sh("é a b c d")).all()


def test_bin_agreement_is_the_similarity():
    rng = np.random.default_rng(1)
    band, agree = mh.Bander(mh.Sketch(bands=100, rows=5)), []
    for _ in range(40):
        u = np.unique(rng.integers(0, 2 ** 63, 60).astype(np.uint64) * np.uint64(2))
        a, b = u[:52], u[8:]  # 44 of 60
        agree.append((band.sketch(np.sort(a)) == band.sketch(np.sort(b))).mean())
    assert abs(np.mean(agree) - 44 / 60) < 0.05


def test_keep_one(edge, none, spark):
    got = mh.keep_one(edge)
    assert got.columns == edge.columns
    ids = [r["doc_id"] for r in got.where("doc_id is not null").collect()]
    want = {c for i, n, c in brute(rows()) if i == c and i is not None}
    assert set(ids) == want and len(ids) == len(want)
    assert mh.near_report(none).collect() == [] and mh.keep_one(none).collect() == []


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r["node"]: r["comp"] for r in mh.components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[200] == got[150] == 100
