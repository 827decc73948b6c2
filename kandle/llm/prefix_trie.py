"""Conversation prefix trie (operator 12): burst tries.

Every conversation is a sequence of turns (role, text); the trie has a node for each distinct sequence of
first turns. Turns are told apart by the SHA-256 of role and text, so texts are read once and never shuffled.

1. Turns are numbered by a range partitioning of (conversation, turn): counts per partition carry a
   conversation over its partitions, so a conversation of any length is numbered by many tasks.
2. Sequences travel as arrays of at most ``block_turns`` turns. Equal ones are merged first (with their number and
   least id), so a group of copies is one row however large it is.
3. A container holds the suffixes under one trie head, first all under the root. A container of more than
   ``container_turns`` turns is burst by its next turn id: a head for each, with the rest behind it. What is
   left of the containers is spread over tasks by head; each is sorted and swept once with a stack of open nodes.
4. Totals go from the swept containers up through the burst heads, level by level.
5. Conversations longer than a block go on in a container under the node they have reached, if others share
   it; alone they are a chain, which needs no turns at all. Totals come back up block by block.

``ends_sha256`` hashes the ids that end at a node. They are joined to pieces of text by tasks over ranges of ids, and
a node's pieces are hashed as a stream in order; a node that ends one conversation is hashed by itself.

Edge cases: null turns come first, null roles and texts are empty; rows of equal turn number are ordered by
their content (repeated rows are turns each); rows without a conversation id belong to no conversation and are left
out; very long texts count only by their digest and length; an empty table has no nodes; further columns are not read,
so their names cannot clash.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kandle.llm.common import materialize, python_ready


@dataclass(frozen=True)
class Trie:
    container_turns: int = 16384
    block_turns: int = 1024
    #: ids in a piece of text that is hashed at once
    piece_ids: int = 8192
    #: oversized containers up to which their heads (32 bytes) are broadcast
    broadcast_heads: int = 100_000


def _root():
    return F.lit(bytearray())


# ---------------------------------------------------------------- sequences
def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t: digest of role and text, chars: code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length in front keeps (role, text) apart from any other pair
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.unhex(F.sha2(both, 256)).alias("t"), F.length(text).cast("long").alias("chars"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, k, t, chars): turns numbered from 0 in each conversation."""
    spark = turns.sparkSession
    order = [F.col("turn").asc_nulls_first(), F.col("t")]
    # written before they are dealt by range, as that looks at its input twice
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(turns, "turns").repartitionByRange(tasks, "conv_id", *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "turns-ranged")
    counts = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only the first conversation of a partition can have begun in an earlier one: at most ``tasks`` rows
    carried = counts.withColumn("before", before).where("before > 0").select("part", "conv_id", "before")
    k = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    return ranged.withColumn("k", k).join(F.broadcast(carried), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "t", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their rebuilt turns (conv_id, pos, len, t, chars): the first h turns of conversation
    c - c % 100, then the own turns after the first h, h = crc32(c) % 6."""
    rows = materialize(numbered(turns), "numbered")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("long")
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 100})
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = own.join(base, "base", "left").withColumn("s", shared).withColumn("len", F.col("s") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "s", "len"), "conversations")
    later = rows.join(convs, "conv_id").where("k >= h").select("conv_id", (F.col("s") + F.col("k") - F.col("h")).alias("pos"), "len", "t", "chars")
    heads = rows.where("k < 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("k").alias("pos"), "t", "chars")
    first = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "len", "t", "chars")
    return convs.select("conv_id", "len"), later.unionByName(first)


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``rebuilt``, with the conversations as they are."""
    rows = materialize(numbered(turns), "numbered")
    convs = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("len")), "conversations")
    return convs, rows.join(convs, "conv_id").select("conv_id", F.col("k").alias("pos"), "len", "t", "chars")


# ---------------------------------------------------------------- containers
def burst(items: DataFrame, p: Trie, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Containers of bounded size, and the heads made on the way: a list of tables (head, parent, depth, chars), a
    table for each level of bursting."""
    kept, levels = [], []
    while True:
        over = items.groupBy("head").agg(F.sum(F.size("arr")).alias("turns")).where(F.col("turns") > p.container_turns).select("head")
        over = materialize(over, f"{name}-over-{len(levels)}")
        n = over.count()
        if not n:
            return kept + [items], levels
        if n <= p.broadcast_heads:
            over = F.broadcast(over)
        big = items.join(over, "head")
        # sequences that stop at the head itself stay there
        kept.append(materialize(items.join(over, "head", "left_anti").unionByName(big.where(F.size("arr") == 0)), f"{name}-kept-{len(levels)}"))
        big = big.where(F.size("arr") > 0)
        child = F.unhex(F.sha2(F.concat("head", F.col("arr")[0]["t"]), 256))
        down = big.select(F.col("head").alias("parent"), child.alias("head"), (F.col("depth") + 1).alias("depth"), F.col("arr")[0]["chars"].alias("last"),
                          "sid", "ends", "n", "least", "stop", "key", "children", "leaves", "saved", "next", F.expr("slice(arr, 2, size(arr))").alias("arr"))
        down = materialize(down, f"{name}-burst-{len(levels)}")
        levels.append(materialize(down.groupBy("head").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("last").alias("last")), f"{name}-heads-{len(levels)}"))
        items = down.drop("parent", "last")


NODE = ("head binary, is_head boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved long, key binary")
NODE_FIELDS = [c.split()[0] for c in NODE.split(", ")]


def sweep(rows: list[dict]) -> list[tuple]:
    """Nodes of one container (fields of NODE). The head's own row has the totals below it; ``saved`` of the others is
    their subtree's, the top included."""
    depth, head = rows[0]["depth"], rows[0]["head"]
    rows.sort(key=lambda r: [x["t"] for x in r["arr"]])
    out: list[list] = []

    def opened(at: int, chars: int) -> dict:
        return {"at": at, "chars": chars, "n": 0, "least": None, "children": 0, "leaves": 0, "saved": 0, "key": None, "below": []}

    def close(node: dict, into: dict | None) -> None:
        leaves = node["leaves"] if node["children"] else 1
        row = [head, into is None, node["least"], depth + node["at"], None, node["n"], node["children"], leaves, node["saved"], node["key"]]
        for child in node["below"]:
            child[4] = node["least"]
        out.append(row)
        if into is not None:
            row[8] += (node["n"] - 1) * node["chars"]
            into["n"] += node["n"]
            into["least"] = node["least"] if into["least"] is None else min(into["least"], node["least"])
            into["children"] += 1
            into["leaves"] += leaves
            into["saved"] += row[8]
            into["below"].append(row)

    stack, last = [opened(0, 0)], []
    for r in rows:
        path = [x["t"] for x in r["arr"]]
        same = 0
        while same < len(path) and same < len(last) and path[same] == last[same]:
            same += 1
        while len(stack) - 1 > same:
            node = stack.pop()
            close(node, stack[-1])
        for x in r["arr"][same:]:
            stack.append(opened(len(stack), x["chars"]))
        node = stack[-1]
        node["n"] += r["n"]
        node["least"] = r["least"] if node["least"] is None else min(node["least"], r["least"])
        for c in ("children", "leaves", "saved"):
            node[c] += r[c]
        if r["stop"]:
            node["key"] = r["key"]
        last = path
    while len(stack) > 1:
        node = stack.pop()
        close(node, stack[-1])
    close(stack[0], None)
    return out


def _sweeps(batches):
    """Containers arrive sorted by head; one is held at a time."""
    held: list[dict] = []

    def swept():
        done = sweep(held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _NODE_TYPES)], NODE_FIELDS)

    for batch in batches:
        heads = batch.column("head").to_pylist()
        at = 0
        while at < len(heads):
            to = at
            while to < len(heads) and heads[to] == heads[at]:
                to += 1
            if held and held[0]["head"] != heads[at]:
                yield swept()
                held = []
            held += batch.slice(at, to - at).to_pylist()
            at = to
    if held:
        yield swept()


_NODE_TYPES = [pa.binary(), pa.bool_(), *[pa.int64()] * 7, pa.binary()]


# ---------------------------------------------------------------- ids that end at a node
def ends_hashes(ended: DataFrame, p: Trie) -> DataFrame:
    """(key, conv_id) -> (key, ends): SHA-256 of the ids in ascending order, joined by commas."""
    tasks = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = ended.groupBy("key").agg(F.count("*").alias("c"), F.min("conv_id").alias("only"))
    single = counts.where("c = 1").select("key", F.sha2(F.col("only").cast("string"), 256).alias("ends"))
    many = materialize(ended.join(counts.where("c > 1").select("key"), "key"), "ends-many")
    if many.isEmpty():
        return single

    def texts(batches):
        """A partition's ids come sorted by (key, conv_id)."""
        held, key, n = [], None, 0

        def piece():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([held[0]], pa.int64()),
                                               "ids": pa.array([",".join(map(str, held))])})

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (k != key or len(held) >= p.piece_ids):
                    yield piece()
                    held = []
                key = k
                held.append(c)
        if held:
            yield piece()

    ranged = many.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    # a range boundary may split equal ids, not their order
    pieces = materialize(ranged.mapInArrow(texts, "key binary, first long, ids string"), "ends-pieces")

    def hashes(batches):
        key, state = None, None

        def done():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [state.hexdigest()]})

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key or state is None:
                    if state is not None:
                        yield done()
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            yield done()

    streamed = pieces.repartition(tasks, "key").sortWithinPartitions("key", "first")
    return single.unionByName(streamed.mapInArrow(hashes, "key binary, ends string"))


# ---------------------------------------------------------------- trie
def _sid():
    return F.expr("unhex(sha2(array_join(transform(arr, x -> hex(x.t)), ''), 256))")


def _key(sid):
    """Name of a sequence under its head; one that ends and one that goes on are different."""
    return F.unhex(F.sha2(F.concat("head", F.when(F.col("ends"), "/").otherwise(">").cast("binary"), sid), 256))


def _items(rows: DataFrame) -> DataFrame:
    """(head, depth, conv_id, arr, ends) -> distinct sequences of a container with their number and least id. ``key`` names the
    sequence; what lies below it (children, leaves, saved) is known for those that end or go on alone."""
    one = rows.withColumn("sid", _sid()).groupBy("head", "sid", "ends").agg(
        F.first("depth").alias("depth"), F.first("arr").alias("arr"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.min("len").alias("len"))
    goes_on, alone = ~F.col("ends"), ~F.col("ends") & (F.col("n") == 1)
    # a sequence that goes on alone takes one step more here, so that its chain has a parent
    step = F.array(F.struct(_key("sid").alias("t"), F.lit(0).cast("long").alias("chars")))
    stop = F.col("len") == F.col("depth") + F.size("arr") + 1
    chain = F.when(alone & ~stop, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return one.select("head", "depth", "sid", "ends", "n", "least", F.when(alone, F.concat("arr", step)).otherwise(F.col("arr")).alias("arr"),
                      (F.col("ends") | (alone & stop)).alias("stop"), _key("sid").alias("key"), chain.alias("children"), chain.alias("leaves"),
                      F.lit(0).cast("long").alias("saved"), F.when(goes_on & ~alone, _key("sid")).alias("next"))


def _merged(totals: DataFrame) -> DataFrame:
    """Parts of heads' totals added up."""
    return totals.groupBy("head").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
                                      F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("key").alias("key"))


def trie(convs: DataFrame, turns: DataFrame, p: Trie = Trie()) -> DataFrame:
    """Nodes of conversations (conv_id, len) with turns (conv_id, pos, len, t, chars): conv_id (least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    python_ready(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = p.block_turns
    blocks = turns.groupBy("conv_id", "len", F.floor(F.col("pos") / w).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("pos", "t", "chars"))).alias("arr"))
    blocks = materialize(blocks.select("conv_id", "len", "blk", F.expr("transform(arr, x -> named_struct('t', x.t, 'chars', x.chars))").alias("arr")), "blocks")
    nothing = F.array().cast(blocks.schema["arr"].dataType)
    here = blocks.where("blk = 0").select(_root().alias("head"), F.lit(0).cast("long").alias("depth"), "conv_id", "len", "arr", (F.col("len") <= w).alias("ends")).unionByName(
        convs.where("len = 0").select(_root().alias("head"), F.lit(0).cast("long").alias("depth"), "conv_id", "len", nothing.alias("arr"), F.lit(True).alias("ends")))

    rounds, chains, ended, reached, b = [], [], [], None, 0
    while True:
        # -- down: merge equal sequences, burst what is too large
        here = materialize(here, f"block-{b}")
        items = _items(here)
        if reached is not None:
            items = items.unionByName(reached)
        items = materialize(items, f"items-{b}")
        rounds.append(burst(items, p, f"containers-{b}"))
        key = _key(_sid())
        ended.append(here.where("ends").select(key.alias("key"), "conv_id"))
        on = items.where("NOT ends")
        if on.isEmpty():
            break
        alone = on.where("n = 1").select(F.col("least").alias("conv_id"), F.col("key"))
        chains.append(convs.join(alone, "conv_id").select("conv_id", "len", "key", F.lit((b + 1) * w).cast("long").alias("depth")))
        shared = here.where("NOT ends").select("conv_id", key.alias("head")).join(on.where("n > 1").select(F.col("key").alias("head")), "head")
        # a conversation that ends where others go on may be the node's least member: it counts as that below, too
        stays = items.where("ends").select("head", "sid", F.col("least").alias("_least"))
        reached = on.where("n > 1").join(stays, ["head", "sid"])
        zero = {c: F.lit(0).cast("long") for c in ("n", "children", "leaves", "saved")}
        reached = reached.withColumns({**zero, "head": F.col("key"), "sid": _root(), "depth": F.lit((b + 1) * w).cast("long"), "ends": F.lit(True), "stop": F.lit(False),
                                       "least": F.col("_least"), "arr": nothing, "next": F.lit(None).cast("binary")}).select(*items.columns)
        b += 1
        here = blocks.where(F.col("blk") == b).join(shared, "conv_id").select(
            "head", F.lit(b * w).cast("long").alias("depth"), "conv_id", "len", "arr", (F.col("len") <= (b + 1) * w).alias("ends"))

    # -- up: sweep the last block first; what lies below a sequence that goes on is known by then
    nodes, below = [], None
    for b in range(len(rounds) - 1, -1, -1):
        kept, levels = rounds[b]
        items = reduce(DataFrame.unionByName, kept)
        if below is not None:
            known = below.select(F.col("head").alias("next"), F.col("n_children").alias("_c"), F.col("n_leaves").alias("_l"), F.col("saved").alias("_s"))
            items = items.join(known, "next", "left").withColumns({c: F.coalesce(x, c) for c, x in (("children", "_c"), ("leaves", "_l"), ("saved", "_s"))})
        items = items.select("head", "depth", "arr", "stop", "n", "least", "key", "children", "leaves", "saved")
        swept = items.repartition(tasks, "head").sortWithinPartitions("head").mapInArrow(_sweeps, NODE)
        swept = materialize(swept, f"swept-{b}")
        nodes.append(swept.where("NOT is_head").drop("head", "is_head"))
        total = swept.where("is_head").select("head", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "key")
        for i in range(len(levels) - 1, -1, -1):
            own = (F.col("n_convs") - 1) * F.col("last")
            up = levels[i].join(total, "head").select(
                F.col("parent").alias("head"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves",
                (F.col("saved") + own).alias("saved"), F.lit(None).cast("binary").alias("key"))
            burst_heads = levels[i].select(F.col("parent").alias("head")).distinct()
            # what stops at a burst head counts as a leaf only if nothing lies below it
            residual = total.join(burst_heads, "head", "left_semi").withColumn("n_leaves", F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(F.lit(0)))
            total = materialize(total.join(burst_heads, "head", "left_anti").unionByName(_merged(up.unionByName(residual))), f"totals-{b}-{i}")
        for level in levels:
            above = total.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
            nodes.append(level.join(total, "head").join(above, "parent").select(
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("last")).alias("saved"), "key"))
        below = total
    nodes.append(below.where(F.col("head") == _root()).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                              "n_convs", "n_children", "n_leaves", "saved", "key"))
    one = F.lit(1).cast("long")
    for chain in chains:
        nodes.append(chain.where("len > depth + 1").select("conv_id", "len", "key", F.explode(F.sequence(F.col("depth") + 2, F.col("len"))).alias("depth")).select(
            "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("depth") < F.col("len"), one).otherwise(F.lit(0)).alias("n_children"),
            one.alias("n_leaves"), F.lit(0).cast("long").alias("saved"), F.when(F.col("depth") == F.col("len"), F.col("key")).alias("key")))
        ended.append(chain.select("key", "conv_id"))
    hashed = ends_hashes(reduce(DataFrame.unionByName, ended), p)
    out = reduce(DataFrame.unionByName, nodes).join(hashed, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_report(conversations: DataFrame, p: Trie = Trie()) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(turn_rows(conversations)), p)
