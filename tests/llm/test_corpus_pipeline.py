"""Every stage against brute force on what its predecessor kept."""
import corpus_pipeline as cp
import numpy as np
import sentencepiece
import zstandard
from data_llm import DOCS, WS, key, rows
from test_minhash import brute as components

from kandle.llm import quality_bands as qb, sp_scan


def test_stages(spark, edge, tmp_path):
    squeeze = zstandard.ZstdCompressor(level=3).compress
    docs, want = edge, rows()
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "unused")
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = docs.collect()
        if name == "quality_bands":
            want = [r for r in want if qb.profile(r[1], qb.Bands(), squeeze)[-1]]
        elif name == "exact_dedup":
            least = {}
            for r in want:
                least.setdefault(WS.sub(" ", r[1]), []).append(r)
            want = [min(g, key=lambda r: key(r[0])[::-1]) for g in least.values()]
        elif name == "near_dedup":
            keep = {c for i, n, c in components(want) if i == c}
            want = [r for r in want if r[0] in keep]
        elif name == "fair_queue_mix":
            assert docs.columns == DOCS.names and {r["doc_id"] for r in got} <= {r[0] for r in want} and got
            texts = {r[0]: r[1] for r in want}
            counts = {}
            for r in got:
                counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
            assert max(counts.values()) <= 3
            break
        assert docs.columns == DOCS.names
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    lib = sentencepiece.SentencePieceProcessor(model_file=sp_scan.model_path())
    last = cp.STAGES[-1][1](spark, docs, "unused").collect()
    assert len(last) == sum(counts.values())
    for r in last:
        assert r["token_ids"] == lib.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) and r["round_trip"]


def test_run_and_empty(spark, none):
    d = "/root/testdata/sf0.001"
    got = cp.run(spark, d)
    assert got.count() > 50 and "token_ids" in got.columns
    docs = none
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, d)
    assert docs.collect() == []
    assert np.all([len(cp.STAGES) == 5])
