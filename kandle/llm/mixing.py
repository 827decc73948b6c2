"""Mixing sources to target weights by weighted fair queueing (operator 10, DataFrame operations only).

Each source queues its documents in a pseudo-random order fixed by ``seed``; a source may be read
up to ``max_epochs`` times. A document's virtual finish time is the number of its source's tokens
up to and with it, divided by the source's target. Served in that order, every source advances at
the rate of its target; the order is cut where the total budget is reached.

Targets: sources sorted by code point (null last) weigh 1, 2, 3, repeating, and share the budget
(all tokens); a target stops at ``max_epochs`` times its source's size and the excess is shared
again by weight. The fixed point has a closed form over the sources sorted by cap / weight.

Running sums are taken inside (source, shuffle bucket) and shifted by the sums of the earlier
buckets, so a source with a third of all rows is spread over 4096 windows. The global order is cut
in equal ranges of finish time: the range with the cut is found from the range totals and only
that range's rows are sorted. Fair queueing itself makes the ranges even.

Edge cases: null text has size 0 and is never taken; rows that agree in id, source and size are
one unit, served together (each row then shows the same count); an empty table gives no rows;
with no words at all the targets are 0; a source of size 0 has target 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kandle.llm.common import WORD, materialize

SEED = "mix-1"
MAX_EPOCHS = 3
RANGES = 4096


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """Sorts by code point with null last, and is never null itself."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple = (1, 2, 3)) -> DataFrame:
    """(sk, source_size) -> (sk, source_size, target). One row per source goes through the windows."""
    n = len(weights)
    rank = F.row_number().over(Window.orderBy("sk"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.select("*", F.sum("source_size").over(Window.partitionBy()).alias("total"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.sum("w").over(onward).alias("w_onward"))
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_onward"))
    s = s.withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    free = F.min(F.expr("CASE WHEN NOT capped THEN struct(cap / w AS r, sk, level) END")).over(Window.partitionBy())
    return s.withColumn("free", free).select(
        "sk", "source_size",
        F.expr("CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w * free.level END").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED,
        max_epochs: int = MAX_EPOCHS, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """(sized rows, units): sized rows (id, sk, size) one per document; units (id, sk, size, source_size,
    target, copies) one per distinct (id, source, size)."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), _source_key(source).alias("sk"), n_words(text).alias("size")), "sizes")
    u = F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary")), 1, 16)
    units = sized.groupBy("id", "sk", "size").agg(F.count("*").alias("m")).withColumn("u", u)
    units = units.withColumn("bucket", F.substring("u", 1, 3))
    run = Window.partitionBy("sk", "bucket").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    units = materialize(units.withColumn("run", F.sum(F.col("m") * F.col("size")).over(run)), "queues")

    buckets = units.groupBy("sk", "bucket").agg(F.max("run").alias("in_bucket"))
    in_order = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("shift", F.coalesce(F.sum("in_bucket").over(in_order), F.lit(0))).drop("in_bucket")
    goals = materialize(targets(sized.groupBy("sk").agg(F.sum("size").alias("source_size")), max_epochs), "targets")

    queue = units.join(buckets, ["sk", "bucket"]).join(goals, "sk").withColumn("upto", F.col("shift") + F.col("run"))
    queue = materialize(queue.select("id", "sk", "size", "m", "u", "upto", "source_size", "target"), "queue")
    served = queue.where("target > 0 AND size > 0").select(
        "sk", "u", "id", "size", (F.col("m") * F.col("size")).alias("tokens"),
        F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"), "upto", "source_size", "target")
    finish = (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")
    served = served.withColumn("finish", finish).withColumn("slot", F.floor(F.col("finish") * ranges))

    # the range in which the budget ends: totals of the ranges, then their running sum (a few thousand rows)
    budget = goals.agg(F.sum("source_size").alias("budget"))
    slots = served.groupBy("slot").agg(F.sum("tokens").alias("t"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cut = (slots.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).crossJoin(F.broadcast(budget))
           .where("before <= budget AND before + t > budget").select("slot", "before", "budget"))
    order = ["finish", "sk", "u", "id", "size"]
    last = Window.partitionBy("slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = (served.join(F.broadcast(cut), "slot").withColumn("sum", F.col("before") + F.sum("tokens").over(last))
           .where("sum > budget").agg(F.min(F.struct(*order)).alias("first_out")))  # one row
    fin = [F.struct(((F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish"), "sk", "u", "id", "size")
           for e in range(max_epochs)]
    taken = sum((F.when(F.col("first_out").isNull() | (f < F.col("first_out")), 1).otherwise(0) for f in fin), F.lit(0))
    units = queue.crossJoin(F.broadcast(out)).select(
        "id", "sk", "size", "source_size", "target",
        F.when((F.col("target") > 0) & (F.col("size") > 0), taken).otherwise(0).alias("copies"))
    return sized, units


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized, units = mix(docs, **kw)
    on = sized["id"].eqNullSafe(units["id"]) & (sized["sk"] == units["sk"]) & (sized["size"] == units["size"])
    return sized.join(units, on).select(
        sized["id"].alias("doc_id"), sized["size"], "source_size", "target",
        (F.col("copies") * sized["size"]).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **kw) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it is taken."""
    units = mix(docs, id_col, source, text, **kw)[1].where("copies > 0").select(
        F.col("id").alias("__id"), F.col("sk").alias("__sk"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    rows = docs.withColumns({"__sk2": _source_key(source), "__size2": n_words(text)})
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sk2") == F.col("__sk")) & (F.col("__size2") == F.col("__size"))
    return (rows.join(units, on).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*docs.columns))
