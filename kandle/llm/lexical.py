"""Ranked lexical search (operator 11): dense blocked BLAS multiplication.

Every item of a query table is ranked against all documents by a sum of whole-number term impacts.

1. Items are dealt to blocks of about ``block_terms`` (item, term) entries; the rest is one pass over the documents for
   each block, so what a task holds of the items is bounded however many there are. A block's vocabulary is known to all tasks.
2. Documents are read once per block: number of terms and occurrences of the vocabulary's terms, written to the shared folder
   as lists of term numbers. Counts over all documents (N, L, df) follow from that table by combinable aggregates.
3. A block's items are taken ``tile_items`` at a time with their own compact vocabulary, documents ``tile_docs`` at a time.
   A tile of weights (items x terms) times a tile of impacts (terms x documents) is one BLAS product in float64. Weights and
   impacts are whole numbers, and tiles are cut so that no sum in a product can reach 2^53: products are exact, and they are
   added up over the vocabulary's tiles in 64-bit integers.
4. A tile keeps an item's ``top`` highest scores and what ties with the last of them; ties are settled by id, per task and then
   over the tasks in two steps (by groups of tasks first, so an item is no hot key).

Weight of a term: floor(1000 ln((2N + 2) / (2df + 1))). Impact: (10^9 tf) div (1000 tf + 8m), m = 10 + (90 n N) div L.

Edge cases: null and empty texts have no terms; items without terms have no rows, nor have documents without a common
term; rows of one item id are one item; repeated documents are ranked each; null document ids come after the others of equal
score; very long texts are read whole (an item alone may exceed a block); empty tables give no rows; further columns are not
read, so their names cannot clash.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from kandle.llm.common import materialize, python_ready
from kandle.llm.token_files import steps

#: separators become spaces, A-Z become a-z; bytes from 0x80 on belong to terms
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Search:
    top: int = 10
    block_terms: int = 65536
    tile_items: int = 256
    tile_terms: int = 4096
    tile_docs: int = 512


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


# ---------------------------------------------------------------- items
def item_terms(items: DataFrame, item_col: str, text: str) -> DataFrame:
    """(item, term), each once."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text).cast("string").alias("text"))

    def split(batches):
        for batch in batches:
            for k, t in enumerate(batch.column("text")):
                own = list(set(terms(t.as_py())))
                if own:
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array([k] * len(own))), pa.array(own, pa.binary())], ["item", "term"])

    return rows.mapInArrow(split, f"item {rows.schema['item'].dataType.simpleString()}, term binary").distinct()


def item_blocks(entries: DataFrame, p: Search) -> tuple[DataFrame, int]:
    """``entries`` with a block each, none much larger than ``block_terms`` unless one item is."""
    blocks = -(-entries.count() // p.block_terms)
    while True:
        dealt = entries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))))
        worst = dealt.groupBy("block").agg(F.count("*").alias("c"), F.count_distinct(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("i")).where(
            f"c > {2 * p.block_terms} AND i > 1")
        if blocks <= 1 or worst.isEmpty():
            return dealt, blocks
        blocks *= 2


class Block:
    """A block's items: vocabulary, and tiles of items with their own compact vocabulary."""

    def __init__(self, rows: list, p: Search):
        self.items = list(dict.fromkeys(r["item"] for r in rows))
        at = {item: i for i, item in enumerate(self.items)}
        self.vocab = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        own: list[list[int]] = [[] for _ in self.items]
        for r in rows:
            own[at[r["item"]]].append(self.vocab[bytes(r["term"])])
        self.tiles = []
        for lo in range(0, len(own), p.tile_items):
            part = own[lo:lo + p.tile_items]
            self.tiles.append((lo, part, np.array(sorted(set().union(*part)), np.int64)))


# ---------------------------------------------------------------- documents
def term_counts(docs: DataFrame, id_col: str, text: str, vocab) -> DataFrame:
    """(id, n: terms with repeats, term, tf: lists over the vocabulary's terms the document holds)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def count(batches):
        known = vocab.value
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i, j in steps([range(s) for s in sizes]):
                n, ends, found, often = [], [0], [], []
                for t in texts.slice(i, j - i).to_pylist():
                    words = terms(t)
                    n.append(len(words))
                    which, tf = np.unique(np.array([known[w] for w in words if w in known], np.int32), return_counts=True)
                    found.append(which)
                    often.append(tf.astype(np.int64))
                    ends.append(ends[-1] + len(which))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(often)))], ["id", "n", "term", "tf"])

    return rows.mapInArrow(count, "id long, n long, term array<int>, tf array<long>")


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Whole-number impacts of occurrences in documents of ``n`` terms (one entry per occurrence)."""
    if 90 * docs * int(n.max(initial=0)) < 1 << 63:
        m = 10 + (90 * n * docs) // total
    else:
        m = np.array([10 + (90 * int(x) * docs) // total for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """An item's highest scores so far, ties settled by id."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)  # scores from 1 on count
        self.rows: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * items

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate((self.rows[item][0], score)), np.concatenate((self.rows[item][1], ids))
        order = np.lexsort((d, -s))[:self.top]
        self.rows[item] = s[order], d[order]
        if len(order) == self.top:
            self.least[item] = s[order[-1]]

    def add_tile(self, lo: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: items from ``lo`` on x documents. What ties with an item's last place may still replace it."""
        hit = scores >= self.least[lo:lo + len(scores), None]
        for i in np.flatnonzero(hit.any(1)):
            own = np.flatnonzero(hit[i])
            if len(own) > 4 * self.top:  # the tile's own top and its ties
                s = scores[i, own]
                own = own[s >= np.partition(s, len(s) - self.top)[len(s) - self.top]]
            self.add(lo + i, scores[i, own], ids[own])


def tile_scores(part: list[list[int]], vocab: np.ndarray, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray,
                n_docs: int, p: Search) -> np.ndarray:
    """Scores (items x documents) of one tile of items and documents; ``doc``, ``term``, ``impact``: the documents' entries."""
    place = np.searchsorted(vocab, term)
    place[place == len(vocab)] = 0
    mine = vocab[place] == term
    doc, place, impact = doc[mine], place[mine], impact[mine]
    # impacts are below 10^6: so many terms' products add up to less than 2^53
    width = max(1, min(p.tile_terms, ((1 << 53) - 1) // (max(1, int(weight[vocab].max(initial=0))) * 1_000_000)))
    out = np.zeros((len(part), n_docs), np.int64)
    local = [np.searchsorted(vocab, np.array(own)) for own in part]
    for lo in range(0, len(vocab), width):
        hi = min(lo + width, len(vocab))
        w = np.zeros((len(part), hi - lo))
        for i, own in enumerate(local):
            own = own[(own >= lo) & (own < hi)]
            w[i, own - lo] = weight[vocab[own]]
        here = (place >= lo) & (place < hi)
        d = np.zeros((hi - lo, n_docs))
        d[place[here] - lo, doc[here]] = impact[here]
        out += (w @ d).astype(np.int64)
    return out


def search(items: DataFrame, docs: DataFrame, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text: str = "text",
           p: Search = Search()) -> DataFrame:
    """The items' ``top`` documents: the item, rank (from 1), the document's id, score."""
    spark = docs.sparkSession
    python_ready(spark)
    entries = materialize(item_terms(items, item_col, item_text), "item-terms")
    dealt, blocks = item_blocks(entries, p)
    kind = entries.schema["item"].dataType.simpleString()
    found = None
    for b in range(blocks):
        block = Block(dealt.where(F.col("block") == b).select("item", "term").orderBy("item", "term").collect(), p)  # bounded by block_terms, or one item
        if not block.items:
            continue
        one = _scores(docs, id_col, text, block, p, kind)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = entries.select("item", F.lit(0).cast("long").alias("task"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    # a few rows of each task: first over groups of tasks, then over all
    some = found.withColumn("r", F.row_number().over(Window.partitionBy("item", F.pmod("task", F.lit(64))).orderBy(*order))).where(F.col("r") <= p.top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return some.select("item", "id", "score").withColumn("rank", rank).where(F.col("rank") <= p.top).select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _scores(docs: DataFrame, id_col: str, text: str, block: Block, p: Search, kind: str) -> DataFrame:
    """Each task's best rows (item, task, id, score) for the items of one block."""
    spark = docs.sparkSession
    counts = materialize(term_counts(docs, id_col, text, spark.sparkContext.broadcast(block.vocab)), "term-counts", "zstd")
    row = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("total")).first()
    n_docs, total = row["docs"], row["total"] or 0
    df = np.zeros(len(block.vocab), np.int64)
    for r in counts.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect():  # no more rows than the vocabulary
        df[r["t"]] = r["c"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    known = spark.sparkContext.broadcast((block.items, block.tiles, weight))

    def rank(batches):
        from pyspark import TaskContext
        names, tiles, weight = known.value
        best = Best(len(names), p.top)
        for batch in batches:
            for at in range(0, batch.num_rows, p.tile_docs):
                part = batch.slice(at, p.tile_docs)
                lists, n = part.column("term"), part.column("n").to_numpy()
                size = lists.value_lengths().to_numpy()
                doc = np.repeat(np.arange(len(size)), size)
                term = lists.flatten().to_numpy().astype(np.int64)
                impact = impacts(part.column("tf").flatten().to_numpy(), n[doc], n_docs, max(1, total))
                ids = pc.fill_null(part.column("id"), NO_ID).to_numpy()
                for lo, own, vocab in tiles:
                    best.add_tile(lo, tile_scores(own, vocab, weight, doc, term, impact, len(size), p), ids)
        rows = [(names[i], int(d), int(s)) for i, (score, ids) in enumerate(best.rows) for s, d in zip(score, ids)]
        if rows:
            item, ids, score = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item, item_type), "task": pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()),
                "id": pa.array([None if d == NO_ID else d for d in ids], pa.int64()), "score": pa.array(score, pa.int64())})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType
    item_type = to_arrow_type(StructType.fromDDL(f"item {kind}")["item"].dataType)
    return materialize(counts.mapInArrow(rank, f"item {kind}, task long, id long, score long"), "task-best")
