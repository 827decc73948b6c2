"""Pointer chains as distributed table operators (no per-group loop).

``next_after``: for each probe position x, the first entry position e > x in the same group,
computed per bounded chunk of positions plus a suffix-min over per-chunk minima (a table with
one row per chunk), so no window ever spans a whole group.

``follow_chain``: the nodes reachable from each group's head by following ``nxt`` pointers:
contracted inside bounded chunks, pointer doubling over chunk entries only, one algorithm at
every size.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kandle.operators.fold import fold_chunks
from kandle.sources.scratch import materialize

CHUNK = 1 << 16


def next_after(entries: DataFrame, probes: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """entries: keys + e; probes: keys + pid + x. Returns keys + pid + nxt (NULL if none)."""
    ent = entries.select(*keys, F.col("e").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pid"))
    prb = probes.select(*keys, F.col("x").alias("pos"), F.lit(1).alias("kind"), F.col("pid").cast("long"))
    u = ent.unionByName(prb).withColumn("ch", F.floor(F.col("pos") / chunk))
    w = Window.partitionBy(*keys, "ch").orderBy("pos", "kind").rowsBetween(1, Window.unboundedFollowing)
    u = u.withColumn("_in", F.min(F.when(F.col("kind") == 0, F.col("pos"))).over(w))
    # chunks with probes only count too: they look on to later chunks
    mins = u.groupBy(*keys, "ch").agg(F.min(F.when(F.col("kind") == 0, F.col("pos"))).alias("m"))
    ws = Window.partitionBy(*keys).orderBy("ch").rowsBetween(1, Window.unboundedFollowing)
    later = mins.withColumn("_later", F.min("m").over(ws)).select(*keys, "ch", "_later")
    p = u.where(F.col("kind") == 1).join(later, [*keys, "ch"], "left")
    return p.select(*keys, "pid", F.coalesce("_in", "_later").alias("nxt"))


def first_entry_after(entries: DataFrame, probes: DataFrame, keys: list[str], chunk_of) -> DataFrame:
    """entries: keys + pos + eid; probes: keys + pid + x. For each probe, the entry with the
    smallest pos > x as (nxt_pos, nxt_id), found per bounded chunk (``chunk_of(pos)``) plus a
    suffix minimum over per-chunk minima."""
    ent = entries.select(*keys, "pos", F.lit(0).alias("kind"), F.struct("pos", "eid").alias("ent"),
                         F.lit(None).cast("long").alias("pid"))
    prb = probes.select(*keys, F.col("x").alias("pos"), F.lit(1).alias("kind"),
                        F.lit(None).cast(ent.schema["ent"].dataType).alias("ent"), F.col("pid").cast("long"))
    u = ent.unionByName(prb).withColumn("ch", chunk_of(F.col("pos")))
    w = Window.partitionBy(*keys, "ch").orderBy("pos", "kind").rowsBetween(1, Window.unboundedFollowing)
    u = u.withColumn("_in", F.min("ent").over(w))
    mins = u.groupBy(*keys, "ch").agg(F.min("ent").alias("m"))
    ws = Window.partitionBy(*keys).orderBy("ch").rowsBetween(1, Window.unboundedFollowing)
    later = mins.withColumn("_later", F.min("m").over(ws)).select(*keys, "ch", "_later")
    p = u.where(F.col("kind") == 1).join(later, [*keys, "ch"], "left")
    r = F.coalesce("_in", "_later")
    return p.select(*keys, "pid", r.pos.alias("nxt_pos"), r.eid.alias("nxt_id"))


def last_marker_before(markers: DataFrame, probes: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """markers: keys + id + tag; probes: keys + pid. For each probe the marker with the largest
    id < pid (its tag), per bounded chunk plus a prefix maximum over per-chunk maxima."""
    mk = markers.select(*keys, F.col("id").alias("pos"), F.lit(0).alias("kind"), F.struct("id", "tag").alias("mk"),
                        F.lit(None).cast("long").alias("pid"))
    pr = probes.select(*keys, F.col("pid").alias("pos"), F.lit(1).alias("kind"),
                       F.lit(None).cast(mk.schema["mk"].dataType).alias("mk"), F.col("pid").cast("long"))
    u = mk.unionByName(pr).withColumn("ch", F.floor(F.col("pos") / chunk))
    w = Window.partitionBy(*keys, "ch").orderBy("pos", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("_in", F.max("mk").over(w))
    maxs = u.groupBy(*keys, "ch").agg(F.max("mk").alias("m"))
    ws = Window.partitionBy(*keys).orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = maxs.withColumn("_earlier", F.max("m").over(ws)).select(*keys, "ch", "_earlier")
    p = u.where(F.col("kind") == 1).join(earlier, [*keys, "ch"], "left")
    r = F.coalesce("_in", "_earlier")
    return p.select(*keys, "pid", r.id.alias("marker_id"), r.tag.alias("tag"))


def _contract(keys: list[str], chunk: int):
    """Per chunk: where the pointers from each node leave it (NULL: end), and after how many nodes."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nxt, here = pdf["id"].to_numpy(), pdf["nxt"].to_numpy(), pdf["_ch"].iloc[0]
        to, hops = nxt.copy(), np.ones(len(ids), np.int64)
        inside = (nxt >= 0) & (nxt // chunk == here)
        at = np.searchsorted(ids, np.where(inside, nxt, ids))
        for i in np.flatnonzero(inside)[::-1]:
            to[i], hops[i] = to[at[i]], hops[at[i]] + 1
        return pdf.assign(nxt=to, hops=hops)[[*keys, "id", "nxt", "hops"]]
    return run


def _expand(keys: list[str], chunk: int):
    """Per chunk: the nodes on the path from its entry, numbered on from the entry's count."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nxt = pdf["id"].to_numpy(), pdf["nxt"].to_numpy()
        at, n, rows, dist = int(np.searchsorted(ids, pdf["_entry"].iloc[0])), int(pdf["_base"].iloc[0]), [], []
        while True:
            rows.append(at)
            dist.append(n)
            n += 1
            to = nxt[at]
            if to < 0 or to // chunk != pdf["_ch"].iloc[0]:
                break
            at = int(np.searchsorted(ids, to))
        return pdf.iloc[rows].assign(dist=np.array(dist, np.int64))[[*keys, "id", "dist"]]
    return run


def follow_chain(nodes: DataFrame, heads: DataFrame, keys: list[str], max_id: int, chunk: int = CHUNK) -> DataFrame:
    """nodes: keys + id + nxt (nxt > id, itself a node, or NULL); heads: keys + id. Returns keys + id + dist:
    the nodes on each group's path and their number of predecessors on it.

    Pointers are contracted inside chunks of ``chunk`` ids (one bounded task each), the chunk entries are
    followed by pointer doubling over contracted pointers (a path enters a chunk once, so
    log2(max_id / chunk) steps do, none if one chunk holds all), and every entered chunk numbers its nodes."""
    n = nodes.select(*keys, F.col("id").cast("long"), F.coalesce(F.col("nxt").cast("long"), F.lit(-1)).alias("nxt"))
    n = n.withColumn("_ch", F.floor(F.col("id") / chunk).cast("long"))
    key_fields = [f for f in n.schema.fields if f.name in keys]
    key_fields = [next(f for f in key_fields if f.name == k) for k in keys]
    longs = [T.StructField(c, T.LongType()) for c in ("id", "nxt", "hops")]
    levels = math.ceil(math.log2(max_id // chunk + 1))
    s = heads.select(*keys, F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("dist"))
    if levels:
        n = materialize(n, "chain-nodes")
        jumps = [materialize(fold_chunks(n, [*keys, "_ch"], "id", _contract(keys, chunk), T.StructType(key_fields + longs)), "jump-0")]
        for lvl in range(1, levels):
            a = jumps[-1]
            b = a.select(*keys, F.col("id").alias("nxt"), F.col("nxt").alias("_far"), F.col("hops").alias("_more"))
            jumps.append(materialize(a.join(b, [*keys, "nxt"], "left").select(
                *keys, "id", F.coalesce("_far", F.lit(-1)).alias("nxt"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops")),
                f"jump-{lvl}"))
        for jump in jumps[::-1]:
            step = s.join(jump, [*keys, "id"]).where("nxt >= 0").select(*keys, F.col("nxt").alias("id"), (F.col("dist") + F.col("hops")).alias("dist"))
            s = materialize(s.unionByName(step), "chain-entries")
    entries = s.select(*keys, F.floor(F.col("id") / chunk).cast("long").alias("_ch"), F.col("id").alias("_entry"), F.col("dist").alias("_base"))
    out = T.StructType(key_fields + [T.StructField(c, T.LongType()) for c in ("id", "dist")])
    return fold_chunks(n.join(entries, [*keys, "_ch"]), [*keys, "_ch"], "id", _expand(keys, chunk), out)
