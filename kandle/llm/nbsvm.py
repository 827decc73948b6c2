"""Quality classifier (operator 6): naive Bayes support vectors.

A text is a set of hashed n-gram indicators: word unigrams and bigrams, bigrams and trigrams of
word shapes (runs of capitals, letters, digits, other signs), and immediate repetitions. Each indicator is
scaled by its log-count ratio r = log((p + a) / |p|) - log((q + a) / |q|) between good and bad
training documents; the scaled, length-normalised vectors train a linear model under hinge loss by
dual coordinate descent. Margins become probabilities by a logistic curve (Platt).

The counts behind r cover every labelled training row: each task adds up arrays of ``dims`` counts
and Spark sums them per indicator, so at most ``dims`` rows reach the driver. The linear model and
the curve are fitted on at most ``fit_rows`` training rows (three quarters and one quarter).

Only rows with crc32(id) mod 5 <> 0 teach; id, language and source are no inputs. Scoring is one pass
over whole texts, without joins or shuffles.

Edge cases: null and empty texts have no indicators and get the score of the bias alone; without
training rows, or with one class only, the score is the smoothed share of good labels; repeated
rows score alike; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kandle.llm.common import python_ready
from kandle.llm.labelled import fold, sample, training_rows
from kandle.llm.minhash import _M1, _M2, _mix


@dataclass(frozen=True)
class NbsvmConfig:
    dims: int = 1 << 18
    alpha: float = 1.0
    cost: float = 1.0
    epochs: int = 20
    fit_rows: int = 8000


class Indicators:
    """Distinct hashed n-grams of a text, by array operations over its bytes."""

    _P = 0x9FB21C651E98DF25

    def __init__(self, dims: int):
        self.dims = np.uint64(dims)
        self.value = _mix(np.arange(1, 257, dtype=np.uint64) * _M2)
        self.value[65:91] = self.value[97:123]
        kind = np.full(256, 4, np.uint8)  # other signs, each its own
        kind[65:91], kind[97:123], kind[128:], kind[48:58] = 1, 2, 2, 3
        kind[[32, 9, 10, 11, 12, 13]] = 0
        self.kind = kind
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size, one = 1 << int(n).bit_length(), np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate((one, np.full(size, self._P, np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((one, np.full(size, pow(self._P, -1, 1 << 64), np.uint64))), dtype=np.uint64)

    def _spans(self, v: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(v))
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * self.up[:len(v)], dtype=np.uint64)))
        return _mix((upto[end] - upto[start]) * self.down[start])

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        kind = self.kind[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], kind == 0, [True])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.int64)
        word = self._spans(self.value[raw], start, end)
        # shape: kinds of the bytes with equal neighbours merged (signs keep their byte)
        sign = np.where(kind == 4, raw.astype(np.uint64) + np.uint64(16), kind.astype(np.uint64))
        keep = np.concatenate(([True], sign[1:] != sign[:-1]))
        at = np.cumsum(keep)
        shape = self._spans(_mix(sign[keep] * _M1 + np.uint64(7)), at[start] - 1, at[end - 1])
        grams = [word, _mix(word[1:] * _M1 ^ word[:-1] + np.uint64(1)),
                 _mix(shape[1:] * _M1 ^ shape[:-1] + np.uint64(2)),
                 _mix(_mix(shape[2:] * _M1 ^ shape[1:-1] + np.uint64(3)) * _M2 ^ shape[:-2])]
        if len(word) > 1 and (word[1:] == word[:-1]).any():
            same = (word[1:] == word[:-1]).mean()  # repeats: a graded family of indicators
            grams.append(_mix(np.arange(100, 101 + int(same * 10), dtype=np.uint64)))
        return np.unique(np.concatenate(grams) % self.dims).astype(np.int64)


def dual_coordinate_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, conf: NbsvmConfig) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + C sum max(0, 1 - y w.x), x = r at the row's indicators, scaled to length 1."""
    w, bias = np.zeros(conf.dims), 0.0
    xs = [r[i] for i in rows]
    norm = [math.sqrt(float(v @ v)) or 1.0 for v in xs]
    xs = [v / m for v, m in zip(xs, norm)]
    diag = np.array([float(v @ v) + 1.0 for v in xs])
    # classes weigh alike in total
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * conf.cost
    a = np.zeros(len(y))
    rng = np.random.default_rng(5)
    for _ in range(conf.epochs):
        worst = 0.0
        for k in rng.permutation(len(y)):
            i, v = rows[k], xs[k]
            g = y[k] * (float(w[i] @ v) + bias) - 1.0
            pg = min(g, 0.0) if a[k] == 0 else max(g, 0.0) if a[k] >= cost[k] else g
            worst = max(worst, abs(pg))
            if pg != 0.0:
                new = min(max(a[k] - g / diag[k], 0.0), cost[k])
                step = (new - a[k]) * y[k]
                w[i] += step * v
                bias += step
                a[k] = new
        if worst < 1e-3:
            break
    return w, bias


def platt(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps, targets smoothed by one row per class."""
    n1, n0 = t.sum(), len(t) - t.sum()
    z = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        s = p * (1 - p) + 1e-9
        g = np.array([((z - p) * m).sum() - 1e-3 * a, (z - p).sum()])
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -5, 5)), b + float(np.clip(d[1], -5, 5))
        if abs(d).max() < 1e-6:
            break
    return max(a, 1e-6), b


@dataclass
class NbsvmModel:
    conf: NbsvmConfig
    prior: float
    r: np.ndarray | None = None
    w: np.ndarray | None = None
    bias: float = 0.0
    curve: tuple = (1.0, 0.0)

    def margin(self, rows) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for k, i in enumerate(rows):
            v = self.r[i]
            n = math.sqrt(float(v @ v))
            if n:
                out[k] += float(self.w[i] @ v) / n
        return out

    def score(self, texts) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.prior)
        of = Indicators(self.conf.dims)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margin([of(t) for t in texts]) + b, -35, 35)))


def class_counts(train: DataFrame, conf: NbsvmConfig) -> np.ndarray:
    """[good, bad] documents per indicator, over all training rows."""
    def count(frames):
        of, c = Indicators(conf.dims), np.zeros((2, conf.dims), np.int64)
        for pdf in frames:
            for t, y in zip(pdf["text"], pdf["y"]):
                c[1 - int(y), of(t)] += 1
        i = np.flatnonzero(c.any(0))
        yield pd.DataFrame({"i": i, "p": c[0, i], "q": c[1, i]})

    sums = train.select("text", "y").mapInPandas(count, "i long, p long, q long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    got = sums.toPandas()
    out = np.zeros((2, conf.dims))
    out[0, got["i"]], out[1, got["i"]] = got["p"], got["q"]
    return out


def fit(docs: DataFrame, labels: DataFrame, conf: NbsvmConfig = NbsvmConfig(), id_col: str = "doc_id", text: str = "text",
        label: str = "quality") -> NbsvmModel:
    python_ready(docs.sparkSession)
    train = training_rows(docs, labels, label, id_col, text)
    total, pos = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (pos + 1) / (total + 2)
    if not 0 < pos < total:
        return NbsvmModel(conf, prior)
    p, q = class_counts(train, conf) + conf.alpha
    r = np.log(p / p.sum()) - np.log(q / q.sum())

    def rows(texts: pd.Series) -> pd.Series:
        of = Indicators(conf.dims)
        return pd.Series([of(t).astype(np.int32).tobytes() for t in texts], dtype=object)

    calibrate = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(4)) == 0
    got = (sample(train, total, conf.fit_rows).withColumn("x", F.pandas_udf(rows, "binary")("text"))
           .select("id", "y", "x", calibrate.alias("cal")).collect())
    got.sort(key=lambda g: (g["id"], g["y"], bytes(g["x"])))
    xs = [np.frombuffer(g["x"], np.int32) for g in got]
    y = np.array([1.0 if g["y"] else -1.0 for g in got])
    cal = np.array([g["cal"] for g in got], bool)
    if min(len(set(y[~cal])), len(set(y[cal]))) < 2:
        cal = np.zeros(len(y), bool)
    if len(set(y)) < 2:
        return NbsvmModel(conf, prior)
    fit_on, cal_on = np.flatnonzero(~cal), np.flatnonzero(cal if cal.any() else ~cal)
    w, bias = dual_coordinate_descent([xs[k] for k in fit_on], r, y[fit_on], conf)
    model = NbsvmModel(conf, prior, r, w, bias)
    model.curve = platt(model.margin([xs[k] for k in cal_on]), (y[cal_on] > 0).astype(float))
    model.r, model.w = r.astype(np.float32), w.astype(np.float32)
    return model


def score(docs: DataFrame, model: NbsvmModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of the good class."""
    python_ready(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(lambda t: pd.Series(model.score(t.tolist())), "double")(F.col(text)))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, conf: NbsvmConfig = NbsvmConfig()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, conf)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
