"""Toxicity (operator 4): gradient-boosted trees over dense features, isotonic calibration.

Features of a text (``FEATURES``): densities of a toxicity lexicon, closeness of its words to
second-person pronouns, capitals, punctuation, obfuscated and stretched spellings, and shape. The
lexicon is a short seed list plus words learned from all labelled training rows: words whose
smoothed log-odds for the toxic class pass a threshold, the strongest ``lexicon_words`` of them
(counted by Spark with map-side combination; the list that reaches the driver has that bound).

Trees (histogram splits, logistic loss, Newton leaves) are fitted on at most ``fit_rows`` training
rows, three quarters of them; the others fit the isotonic curve from margins to probabilities. Only
rows with crc32(id) mod 5 <> 0 teach; id, language and source are no inputs.

Scoring is one pass over whole texts, without joins or shuffles.

Edge cases: null and empty texts have all features 0 and get the score such a row gets; without any
training rows, or with one class only, the score is the smoothed share of toxic labels; repeated
rows score alike; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kandle.llm.common import python_ready
from kandle.llm.labelled import fold, sample, training_rows

SEED_LEXICON = frozenset("idiot stupid moron loser scum trash pathetic worthless disgusting clown fool dumb filthy ugly hate".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!+", "oieastasit")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RUN = re.compile(r"(.)\1{2,}")
_MASKED = re.compile(r"[A-Za-z][*@$!#0-9][A-Za-z*@$!#0-9]*[A-Za-z]")
FEATURES = ["seed_density", "lexicon_density", "lexicon_weight", "lexicon_max", "lexicon_distinct", "lexicon_share", "near_you",
            "you_density", "caps", "caps_words", "exclaim", "question", "punct", "symbols", "masked", "masked_hits", "stretched",
            "digits", "log_words", "word_len", "distinct_words"]


@dataclass(frozen=True)
class ToxicityConfig:
    lexicon_words: int = 2000
    least_docs: int = 8
    least_log_odds: float = 1.5
    fit_rows: int = 20_000
    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    near: int = 5


def features(text: str | None, lexicon: dict[str, float], near: int = 5) -> list[float]:
    text = text or ""
    raw = _WORD.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text.lower())
    hits = [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in hits]
    seeds = sum(w in SEED_LEXICON for w in words)
    you = [i for i, w in enumerate(words) if w in YOU]
    close = 0
    if you and hits:
        at = np.asarray(you)
        pos = np.searchsorted(at, hits)
        left = np.abs(np.asarray(hits) - at[np.maximum(pos - 1, 0)])
        right = np.abs(np.asarray(hits) - at[np.minimum(pos, len(at) - 1)])
        close = int((np.minimum(left, right) <= near).sum())
    masked = _MASKED.findall(text)
    unmasked = sum(m.lower().translate(_LEET).replace("*", "") in lexicon for m in masked)
    chars = len(text)
    upper = sum(w[0].isupper() for w in raw)
    return [seeds / n, len(hits) / n, sum(weights) / n, max(weights, default=0.0), float(len({words[i] for i in hits})),
            sum(weights) / (1 + len(hits)), close / n, len(you) / n, upper / n,
            sum(1 for w in raw if len(w) > 2 and w.isupper()) / n, text.count("!") / chars, text.count("?") / chars,
            sum(map(text.count, ".,;:")) / chars, sum(map(text.count, "#*$%&|<>@")) / chars, len(masked) / n, float(unmasked),
            len(_RUN.findall(text)) / n, sum(map(text.count, "0123456789")) / chars, math.log1p(n), chars / n, len(set(words)) / n]


# ---------------------------------------------------------------- boosted trees
@dataclass
class Trees:
    """Complete binary trees in arrays: node k has children 2k+1 and 2k+2; leaves hold the margins' steps."""
    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), int)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, conf: ToxicityConfig) -> Trees:
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, conf.bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(d)], 1)  # bin b: x > cuts[b - 1]
    share = (y.sum() + 1) / (n + 2)
    start = math.log(share / (1 - share))
    margin = np.full(n, start)
    inner, width = 2 ** conf.depth - 1, conf.bins
    feats, cut_at, leaves = [], [], []
    for _ in range(conf.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, int)
        f_, c_ = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(conf.depth):
            first, nodes = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.zeros(nodes)
            for j in range(d):
                key = local * width + binned[:, j]
                sg = np.bincount(key, g, nodes * width).reshape(nodes, width)
                sh = np.bincount(key, h, nodes * width).reshape(nodes, width)
                gl, hl = sg.cumsum(1), sh.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                gain = np.where((hl > 0.5) & (ht - hl > 0.5), gain, 0.0)[:, :len(cuts[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                for m in np.flatnonzero(top > best + 1e-9):
                    best[m], f_[first + m], c_[first + m] = top[m], j, cuts[j][k[m]]
            node = 2 * node + 1 + (x[np.arange(n), f_[node]] > c_[node])
        at = node - inner
        sg, sh = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        v = conf.rate * sg / (sh + 1)
        margin += v[at]
        feats.append(f_), cut_at.append(c_), leaves.append(v)
    return Trees(start, np.array(feats), np.array(cut_at), np.array(leaves))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (margin, probability) of the best rising curve, smoothed by one row per class."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t in zip(margin[order], y[order]):
        blocks.append([t, 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = hi
    xs, ps = [], []
    for s, c, lo, hi in blocks:
        p = (s + 0.5) / (c + 1) if len(blocks) > 1 else s / c
        xs += [lo, hi]
        ps += [p, p]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


@dataclass
class ToxicityModel:
    lexicon: dict
    trees: Trees | None
    knots: tuple | None
    prior: float
    near: int

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t, self.lexicon, self.near) for t in texts], float).reshape(-1, len(FEATURES))
        m = self.trees.margin(x)
        # the curve is flat between violators; a hundredth of the plain probability keeps the order there
        return np.clip(0.99 * np.interp(m, *self.knots) + 0.01 / (1 + np.exp(-m)), 0.0, 1.0)


def learn_lexicon(train: DataFrame, positives: int, negatives: int, conf: ToxicityConfig) -> dict[str, float]:
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "))
    seen = train.select("y", F.explode(words).alias("w")).where("length(w) > 1")
    counts = seen.groupBy("w").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where(f"pos >= {conf.least_docs}")
    odds = F.log(((F.col("pos") + 0.5) / (positives + 1)) / ((F.col("n") - F.col("pos") + 0.5) / (negatives + 1)))
    strong = counts.withColumn("odds", odds).where(F.col("odds") >= conf.least_log_odds)
    top = strong.orderBy((F.col("odds") * F.sqrt("pos")).desc(), "w").limit(conf.lexicon_words).collect()
    return {r["w"]: float(r["odds"]) for r in top}


def fit(docs: DataFrame, labels: DataFrame, conf: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id",
        text: str = "text", label: str = "toxic") -> ToxicityModel:
    python_ready(docs.sparkSession)
    train = training_rows(docs, labels, label, id_col, text)
    total, pos = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (pos + 1) / (total + 2)
    if not 0 < pos < total:
        return ToxicityModel({}, None, None, prior, conf.near)
    lexicon = learn_lexicon(train, pos, total - pos, conf)
    lexicon = {w: 2.0 for w in SEED_LEXICON} | lexicon

    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon, conf.near) for t in texts], dtype=object)

    calibrate = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(4)) == 0
    got = (sample(train, total, conf.fit_rows).withColumn("x", F.pandas_udf(rows, "array<double>")("text"))
           .select("id", "y", "x", calibrate.alias("cal")).collect())
    got.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)
    cal = np.array([r["cal"] for r in got], bool)
    if min(len(set(y[~cal])), len(set(y[cal]))) < 2:
        cal = np.zeros(len(y), bool)
    if len(set(y[~cal])) < 2:
        return ToxicityModel(lexicon, None, None, prior, conf.near)
    trees = fit_trees(x[~cal], y[~cal], conf)
    on = cal if cal.any() else ~cal
    return ToxicityModel(lexicon, trees, isotonic(trees.margin(x[on]), y[on]), prior, conf.near)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic class."""
    python_ready(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(lambda t: pd.Series(model.score(t.tolist())), "double")(F.col(text)))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, conf: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, conf)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
