"""MinHash near-dedup (operator 8): one-permutation hashing, optimal densification, banded buckets, stars.

Sketch. The distinct word shingles of a text are hashed to 64 bits with one function; the hash range
is cut in ``bands * rows`` bins and every bin keeps its least hash. An empty bin borrows from the
bin that a hash of (bin, attempt) names first among the non-empty ones (optimal densification), so
equal bins happen with probability equal to the Jaccard similarity, for short texts too. With 40
bands of 5 rows a pair of similarity 0.75 shares a bucket with probability 0.99998.

Classes. Documents with equal shingle sets are one class; only classes go on, so groups of exact
copies cost one member each however large they are.

Stars. In a shared bucket one class is the hub, first the one that shares most buckets and hence is
central, and only the others are compared with it: a bucket of m classes yields m - 1 edges, less those
whose set sizes rule a link out. Candidates are confirmed on the full shingle sets. In later passes buckets that
still hold several components get ``hubs`` other hubs each, one member of each of some components, drawn by a hash
of the shingle sets, which are compared with the members of other components that look alike (by one bit of every bin), until such a pass links nothing or ``passes`` are done.
So a pass costs at most ``hubs`` edges per member, whatever the size of a bucket. Looks decide only what passes
compare: members of buckets that stay open meet in the rest, with or without a look alike.

Rest. What is open then goes through an exact join (``_open_links``): two sets as alike as asked share one of
their rarest shingles, so only members of different components that share one early enough for their sizes
are confirmed. No link between documents that share a bucket is missed.

Components. Labels are minima over confirmed edges, spread with pointer jumping; every step is
written to the shared folder.

Edge cases: null, empty and white-space texts have no shingles and stand alone; fewer words than
``words`` make one shingle of the whole sequence; repeated rows share one class and each gets the
class's component; a null id gets its component like any other and stands for itself when alone;
an empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kandle.llm.common import discard, materialize, python_ready


@dataclass(frozen=True)
class Sketch:
    words: int = 5
    bands: int = 40
    rows: int = 5
    #: least similarity, as hundredths: 100 * common >= percent * union
    percent: int = 75

    @property
    def bins(self) -> int:
        return self.bands * self.rows


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of a text, sorted, by array operations over its bytes.

    A word's hash is a polynomial over per-byte random values (A-Z valued like a-z), taken as a
    difference of prefix sums and shifted back by the inverse power; shingles mix five of them."""

    _P = 0x9FB21C651E98DF25  # odd, hence invertible modulo 2^64

    def __init__(self, words: int):
        self.words = words
        self.value = _mix(np.arange(1, 257, dtype=np.uint64) * _M2)
        self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate((one, np.full(size, self._P, np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((one, np.full(size, pow(self._P, -1, 1 << 64), np.uint64))), dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.space[raw], [True])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        self._powers(len(raw))
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[raw] * self.up[:len(raw)], dtype=np.uint64)))
        word = _mix((upto[end] - upto[start]) * self.down[start] + (end - start).astype(np.uint64))
        k = min(self.words, len(word))
        n = len(word) - k + 1
        acc = np.full(n, k, np.uint64)
        for i in range(k):
            acc = (acc ^ word[i:n + i]) * _M1
            acc ^= acc >> np.uint64(29)
        return np.unique(_mix(acc))


class Bander:
    """Band keys of a sorted shingle set."""

    TRIES = 48  # looked up at once

    def __init__(self, s: Sketch):
        self.s = s
        self.probes = [self._probes(0)]
        self.column = np.arange(s.bins)
        self.seed = _mix(np.arange(1, s.bands + 1, dtype=np.uint64))

    def _probes(self, turn: int) -> np.ndarray:
        """The bins that tries ``turn * TRIES`` and on name for every bin."""
        j = np.arange(self.s.bins, dtype=np.uint64)[None, :] * np.uint64(1_000_003)
        t = np.arange(1 + turn * self.TRIES, 1 + (turn + 1) * self.TRIES, dtype=np.uint64)[:, None] * _M2
        return self._bin(_mix(j + t))

    def _bin(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.s.bins) >> np.uint64(32)).astype(np.int64)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """The bins: least hash each (sorted input: the first of its bin), empty ones densified."""
        where = self._bin(hashes)
        bins = np.zeros(self.s.bins, np.uint64)
        full = np.zeros(self.s.bins, bool)
        first = np.concatenate(([True], where[1:] != where[:-1]))
        bins[where[first]], full[where[first]] = hashes[first], True
        if full.all():
            return bins
        lender, open_ = np.zeros(self.s.bins, np.int64), ~full
        turn = 0
        while open_.any():  # ends, as some bin is full and tries name bins at random
            if turn == len(self.probes):
                self.probes.append(self._probes(turn))
            probe = self.probes[turn]
            hit = full[probe] & open_
            found = hit.any(0)
            lender[found] = probe[hit.argmax(0), self.column][found]
            open_ &= ~found
            turn += 1
        return np.where(full, bins, bins[lender])

    def keys(self, bins: np.ndarray) -> np.ndarray:
        sig = bins.reshape(self.s.bands, self.s.rows)
        acc = self.seed.copy()
        for r in range(self.s.rows):
            acc = _mix(acc ^ sig[:, r])
        return acc.view(np.int64)

    def look(self, bins: np.ndarray) -> np.ndarray:
        """The last bit of every bin, 64 to a number: two sets' bits agree with probability (1 + similarity) / 2."""
        bits = np.zeros(-(-self.s.bins // 64) * 64, np.uint8)
        bits[:self.s.bins] = bins & np.uint64(1)
        return np.packbits(bits).view(np.int64)


def _alike(h, s: Sketch):
    """Whether a row's look leaves a link to ``h`` likely: no more bits differ than at the least similarity, by two
    standard deviations (a short text has as many bits of its own as shingles)."""
    differ = sum(F.bit_count(F.col("look")[i].bitwiseXOR(h["look"][i])) for i in range(-(-s.bins // 64)))
    p = (100 - s.percent) / 200
    own = F.least(F.col("n"), h["n"], F.lit(s.bins))
    return differ <= s.bins * (p + 2 * F.sqrt(p * (1 - p) / own))


def _sketches(s: Sketch):
    def sketches(texts: pd.Series) -> pd.DataFrame:
        import xxhash
        shingle, band = Shingler(s.words), Bander(s)
        rows = []
        for t in texts:
            h = shingle(t)
            fp = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            bins = band.sketch(h) if len(h) else None
            rows.append((len(h), fp[0], fp[1], *((band.keys(bins), band.look(bins)) if len(h) else [np.empty(0, np.int64)] * 2)))
        return pd.DataFrame(rows, columns=["n", "fp1", "fp2", "bands", "look"])

    return F.pandas_udf(sketches, "n long, fp1 long, fp2 long, bands array<long>, look array<long>")


def _shingle_sets(s: Sketch):
    def sets(texts: pd.Series) -> pd.Series:
        shingle = Shingler(s.words)
        return pd.Series([shingle(t).view(np.int64) for t in texts], dtype=object)

    return F.pandas_udf(sets, "array<long>")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): the least node reachable. Hooks nodes and their roots to the least
    neighbouring label, then jumps; written out per step."""
    both = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    p = old = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "cc-0")
    step = 0
    while True:
        step += 1
        near = (both.join(p.select(F.col("node").alias("b"), F.col("comp").alias("m")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m")))
        seen = p.join(near, "node")
        hooks = (seen.select("node", "m").unionAll(seen.select(F.col("comp").alias("node"), "m"))
                 .groupBy("node").agg(F.min("m").alias("m")))
        hooked = p.join(hooks, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("q"))
        nxt = hooked.join(p.select(F.col("node").alias("q"), F.col("comp").alias("r")), "q").select(
            "node", "was", F.least("q", "r").alias("comp"))
        nxt = materialize(nxt, f"cc-{step}")
        discard(old)
        p, old = nxt.select("node", "comp"), nxt
        if nxt.where("comp <> was").isEmpty():
            discard(both)
            return p


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose full shingle sets are similar enough."""
    one = edges.join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb")), "b")
    two = one.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb"))
    two = two.where((F.least(F.size("ha"), F.size("hb")) * 100) >= F.greatest(F.size("ha"), F.size("hb")) * percent)
    return two.select("a", "b", common.alias("i"), (F.size("ha") + F.size("hb")).alias("s")).where(
        f"100 * i >= {percent} * (s - i)").select("a", "b")


def _sets_of(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The shingle sets that ``edges`` name: where they name few, the others need not travel."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    return sets.join(materialize(ends, "ends"), "cid", "left_semi")


def _hubs(held: DataFrame, turn: int, hubs: int) -> DataFrame:
    """(key, hubs) of the buckets that hold several components: in the first turn the member with most company, then
    a member each of some components. Draws go by ``sk`` and not by the bucket, so they are the same on every run, and buckets that
    share members share hubs: their edges are the same pairs."""
    one = F.struct("cid", "n", "comp", "sk", "look")
    if turn == 0:
        drawn = [F.max_by(one, F.struct("deg", "sk", "cid"))]
    else:
        held = held.groupBy("key", "comp").agg(F.min_by(one, F.struct(F.xxhash64(F.lit(turn * 100), "sk"), "cid")).alias("one"))
        drawn = [F.min_by("one", F.struct(F.xxhash64(F.lit(turn * 100 + k), "one.sk"), "one.cid")) for k in range(1, hubs + 1)]
    return held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array_distinct(F.array(*drawn)).alias("hubs")).where(
        "lo < hi").select("key", "hubs")


def _size_class(n: str) -> str:
    """Ascending classes of sizes, one each below 64, then 32 to a power of two."""
    e = f"(length(bin({n})) - 1)"
    return f"CASE WHEN {n} < 32 THEN {n} ELSE ({e} - 4) * 32 + shiftright({n}, {e} - 5) - 32 END"


def _open_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between ``members`` (cid, n, comp; one row per cid) of different components.

    Shingles of one component only link nothing and count as the rarest; the others are ordered by rarity. If the
    first common shingle of two sets stands at places i and j, they share at most min(n - i, m - j), which must
    reach percent / (100 + percent) of n + m. That bounds the partner's size per place, so the join is by shingle,
    own size class and partner's size class."""
    shingles = materialize(members.join(sets, "cid").select("cid", "n", "comp", F.explode("hashes").alias("t")), "open-shingles")
    shared = shingles.groupBy("t").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("t", "f")
    own = Window.partitionBy("cid")
    rows = shingles.join(shared, "t").withColumn(
        "i", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "t")) - 1)
    rows = rows.where(f"100 * (n - i) >= {percent} * n").withColumns({
        "least": F.expr(f"({percent} * n + 99) div 100"), "most": F.expr(f"(100 * n - {100 + percent} * i) div {percent}")})
    rows = materialize(rows.where("least <= most").select(
        "cid", "n", "comp", "t", "i", F.expr(_size_class("n")).alias("own"),
        F.expr(f"explode(sequence({_size_class('least')}, {_size_class('most')}))").alias("other")), "open-places")
    discard(shingles)
    a, b = rows.alias("a"), rows.alias("b")
    meet = a.join(b, F.expr(
        "a.t = b.t AND a.own = b.other AND a.other = b.own AND a.cid < b.cid AND a.comp <> b.comp "
        f"AND {100 + percent} * least(a.n - a.i, b.n - b.i) >= {percent} * (a.n + b.n)"))
    pairs = materialize(meet.select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).distinct(), "open-pairs")
    discard(rows)
    return _confirmed(pairs, _sets_of(pairs, sets), percent)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sketch: Sketch = Sketch(), hubs: int = 3, passes: int = 8) -> DataFrame:
    """One row per input row: id, th (64-bit hash of the text), n_shingles, component_id, rep_th.

    (component_id, rep_th) names the row that stands for the component."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    sig = materialize(rows.withColumn("s", _sketches(sketch)("text")).select("id", "th", "s.*"), "sketches")
    rep = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("th").alias("th")))
    classes = (sig.where("n > 0").groupBy("fp1", "fp2", "n").agg(rep.alias("rep"), F.first("bands").alias("bands"), F.first("look").alias("look"))
               .withColumns({"cid": F.monotonically_increasing_id(), "sk": F.xxhash64("fp1", "fp2", "n")}))
    classes = materialize(classes, "classes")
    member = classes.select("cid", "n", F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = materialize(member.join(sizes, "key"), "buckets")
    degree = materialize(buckets.groupBy("cid").agg(F.sum("c").alias("deg")).join(classes.select("cid", "sk", "look"), "cid"), "degrees")

    wanted = classes.join(degree, "cid").select("cid", F.col("rep.id").alias("wid"), F.col("rep.th").alias("wth"))
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    sets = materialize(found.select("cid", _shingle_sets(sketch)("text").alias("hashes")), "shingle-sets")
    if not sets.groupBy("cid").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        sets = materialize(sets.dropDuplicates(["cid"]), "shingle-sets-once")  # repeated rows

    labels, turn = degree.select(F.col("cid").alias("node"), F.col("cid").alias("comp"), "sk", "look"), 0
    held = buckets.join(degree, "cid").withColumn("comp", F.col("cid"))

    def joined(links: DataFrame) -> DataFrame:
        """The labels after ``links``; the labels and links before are discarded."""
        la = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
        lb = la.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        merged = components(lb.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        after = materialize(
            labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
            .select("node", F.coalesce("to", "comp").alias("comp"), "sk", "look"), f"labels-{turn}")
        discard(labels, links)
        return after

    while True:
        # written out, so that the look-up is a plain join whose hot buckets AQE can split
        picked = materialize(_hubs(held, turn, hubs), f"hubs-{turn}")
        if picked.isEmpty():
            break
        held = held.join(picked, "key")

        def meets(h):
            """Another component's hub, of a size that leaves a link possible."""
            return (h["comp"] != F.col("comp")) & (F.least("n", h["n"]) * 100 >= F.greatest("n", h["n"]) * sketch.percent)

        if turn == 0:
            hub = F.col("hubs")[0]
            edges = held.where(meets(hub)).select("cid", hub["cid"].alias("hub"))
        else:
            edges = held.select("cid", F.explode(F.filter("hubs", lambda h: meets(h) & _alike(h, sketch))).alias("h")).select("cid", F.col("h.cid").alias("hub"))
        edges = edges.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
        if turn:  # few: what looks alike is mostly linked by now
            edges = materialize(edges, f"edges-{turn}")
        links = materialize(_confirmed(edges, _sets_of(edges, sets) if turn else sets, sketch.percent), f"links-{turn}")
        if turn and (turn >= passes or links.isEmpty()):
            if not links.isEmpty():
                labels = joined(links)
                held = buckets.join(labels.withColumnRenamed("node", "cid"), "cid").join(picked.select("key"), "key")
            members = materialize(held.select("cid", "n", "comp").distinct(), "open-members")
            links = materialize(_open_links(members, sets, sketch.percent), "links-open")
            if not links.isEmpty():
                labels = joined(links)
            break
        labels = joined(links)
        discard(picked)
        turn += 1
        held = buckets.join(labels.withColumnRenamed("node", "cid"), "cid")
    discard(sets, buckets)

    comp = classes.select("fp1", "fp2", "n", "rep", "cid").join(labels.select(F.col("node").alias("cid"), "comp"), "cid", "left")
    comp = comp.withColumn("comp", F.coalesce("comp", "cid"))
    least = comp.groupBy("comp").agg(F.min("rep").alias("least"))
    comp = comp.join(least, "comp").select("fp1", "fp2", "n", "least")
    out = sig.drop("bands", "look").join(comp, ["fp1", "fp2", "n"], "left")
    alone = F.col("least").isNull()
    return out.select("id", "th", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
                      F.when(alone, F.col("th")).otherwise(F.col("least.th")).alias("rep_th"))


def near_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (id = component_id)."""
    g = near_groups(docs, id_col, text, **kw)
    return g.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One document of each component (the one with the least id), with the columns of ``docs``.
    Documents without shingles all stay; of rows repeated in id and text one stays."""
    g = near_groups(docs.select(id_col, text), id_col, text, **kw)
    g = g.where((F.col("n_shingles") == 0) | (F.col("id").eqNullSafe(F.col("component_id")) & F.col("th").eqNullSafe(F.col("rep_th"))))
    g = materialize(g.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("c")), "kept")
    rows = docs.withColumn("__th2", F.xxhash64(F.col(text)))
    out = rows.join(g, F.col(id_col).eqNullSafe(F.col("__id")) & F.col("__th2").eqNullSafe(F.col("__th")), "left_semi")
    if not g.where("c > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__th2"])
    return out.select(*docs.columns)
