"""Labelled rows for the two classifiers: which rows may be learned from, and a bounded sample of them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5
#: label rows up to which they are broadcast (16 bytes each); beyond, Spark shuffles both sides
BROADCAST_ROWS = 1_000_000


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y) of labelled documents outside the held-out fold. Null labels teach nothing; if an
    id is labelled twice the higher label counts."""
    known = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y")))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.join(known, "id")


def sample(rows: DataFrame, total: int, most: int, seed: int = 17) -> DataFrame:
    """About ``most`` rows at most: the same rows on every run.

    A row (id, text) that is there c times comes floor(c * most / total + u) times, u in [0, 1) by its hash, so
    repeated rows keep their share and the bound holds for them too."""
    if total <= most:
        return rows
    keyed = rows.withColumn("th", F.xxhash64("text"))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), "th"), 11) / F.lit(float(1 << 53))
    drawn = (keyed.groupBy("id", "th").agg(F.count("*").alias("c"))
             .withColumn("copies", F.floor(F.col("c") * F.lit(most / total) + u).cast("int")).where("copies > 0").drop("c"))
    # no more than about ``most`` keys: texts that are not drawn are not shuffled
    once = keyed.join(F.broadcast(drawn), ["id", "th"]).dropDuplicates(["id", "th"])
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*rows.columns)
