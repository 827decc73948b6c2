"""Exact dedup by deterministic block naming (operator 3, DataFrame operations only).

1. White space is normalised and the text is cut into blocks of ``block_chars`` code points.
2. Distinct blocks are sorted and numbered: equal blocks, and only those, share an integer name.
3. Adjacent names are paired, distinct pairs are sorted and numbered again, level by level, until
   a document has one name. (number of blocks, last name) is the document's identity: no two
   different texts share it, whatever their hashes.

Names are looked up by a 64-bit key of the block, so block texts are shuffled once only, after a
map-side distinct. Should two different blocks share a key, the blocks of that key are matched by
their contents instead (``_attach``), so the result does not rest on the hash. Every level is
written to the shared folder: names are drawn once, and a lost executor cannot change them.

Hot groups: the distinct is combined before the shuffle, look-ups are plain equi-joins whose hot
keys AQE splits, and the groups are aggregates, never windows or lists.

Edge cases: null text counts as empty, and all empty texts are one group; repeated rows (also of
one doc_id) stay separate rows of one group, of which exactly one is kept; null ids sort last;
an empty table gives no rows; very long texts are cut into blocks and named level by level; further columns travel in a struct, so
their names cannot clash with those used here.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kandle.llm.common import WS, materialize

BLOCK_CHARS = 4096


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WS + "+", " ")


def _blocks(norm: Column, block_chars: int) -> Column:
    """Fixed-size blocks in order; one empty block for an empty text. Linear in the length."""
    return F.when(F.length(norm) <= block_chars, F.array(norm)).otherwise(
        F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _numbered(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows sorted inside their hash partition, each with an integer of its own."""
    return distinct.sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def _key(block: Column, key_mod: int | None) -> Column:
    h = F.xxhash64(block)
    return F.pmod(h, F.lit(key_mod)) if key_mod else h


def block_names(docs: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS,
                key_mod: int | None = None) -> DataFrame:
    """(rid, doc: struct of the other columns, text_sha256, n_blocks, name): the identity of every row.

    ``key_mod`` shrinks the look-up key (tests force collisions with it)."""
    norm = docs.withColumn("__norm", normalised(text))
    cut = norm.select(F.explode(_blocks(F.col("__norm"), block_chars)).alias("block"))
    names = materialize(
        _numbered(cut.groupBy("block").agg(F.lit(1).alias("one")), ["block"])
        .select(_key(F.col("block"), key_mod).alias("h"), "name"), "block-names")
    shared = names.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    collide = not shared.isEmpty()

    rest = [c for c in docs.columns if c != text]
    facts = norm.select(
        F.monotonically_increasing_id().alias("rid"),
        F.struct(F.sha2(F.col("__norm"), 256).alias("sha"), F.struct(*[norm[c] for c in rest], F.lit(0).alias("__none")).alias("own")).alias("doc"),
        _blocks(F.col("__norm"), block_chars).alias("blocks"))
    facts = facts.select("rid", "doc", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    facts = facts.select("rid", F.when(F.col("pos") == 0, F.col("doc")).alias("doc"), "n_blocks", "pos",
                         _key(F.col("block"), key_mod).alias("h"), "block")
    if collide:
        facts = facts.join(shared, "h", "left").withColumn("block", F.expr("CASE WHEN c > 1 THEN block END")).drop("c")
    else:
        facts = facts.drop("block")
    facts = materialize(facts, "block-facts")

    named = _attach(facts, names, shared) if collide else facts.join(names, "h")
    cur = materialize(named.select("rid", "pos", "n_blocks", "name"), "level-0")
    done = [cur.where("n_blocks = 1").select("rid", "n_blocks", "name")]
    top = facts.agg(F.max("n_blocks")).first()[0] or 0
    level, width = 0, 1
    while width < top:
        level, width = level + 1, width * 2
        pairs = (cur.where(f"n_blocks > {width // 2}")
                 .groupBy("rid", "n_blocks", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.expr("CASE WHEN pos % 2 = 0 THEN name END")).alias("a"),
                      F.coalesce(F.max(F.expr("CASE WHEN pos % 2 = 1 THEN name END")), F.lit(-1)).alias("b")))
        pairs = materialize(pairs, f"pairs-{level}")
        names = materialize(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), f"names-{level}")
        cur = materialize(pairs.join(names, ["a", "b"]).select("rid", "pos", "n_blocks", "name"), f"level-{level}")
        done.append(cur.where(f"n_blocks <= {width}").select("rid", "n_blocks", "name"))
    ids = done[0]
    for d in done[1:]:
        ids = ids.unionAll(d)
    head = facts.where("pos = 0").select("rid", "doc")
    return head.join(ids, "rid").select("rid", F.col("doc.own").alias("doc"), F.col("doc.sha").alias("text_sha256"), "n_blocks", "name")


def _attach(facts: DataFrame, names: DataFrame, shared: DataFrame) -> DataFrame:
    """Names by key; where a key has several blocks, the r-th block in order gets the key's r-th name."""
    from pyspark.sql import Window
    by_h = Window.partitionBy("h")
    plain = facts.where("block IS NULL").join(names.join(shared, "h", "left_anti"), "h")
    ranked = (facts.where("block IS NOT NULL").select("h", "block").distinct()
              .withColumn("r", F.row_number().over(by_h.orderBy("block"))))
    of_key = names.join(shared, "h", "left_semi").withColumn("r", F.row_number().over(by_h.orderBy("name")))
    by_text = facts.where("block IS NOT NULL").join(ranked.join(of_key, ["h", "r"]), ["h", "block"])
    cols = ["rid", "pos", "n_blocks", "name"]
    return plain.select(*cols).unionAll(by_text.select(*cols))


RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the further columns of ``docs``; of those, one that is
    called like a result gives way to it."""
    named = materialize(block_names(docs, text, **kw), "identities")
    own = F.col("doc").getField(id_col)
    best = F.min(F.struct(own.isNull().alias("n"), own.alias("id"), F.col("rid").alias("rid")))
    # written out, so that the look-up below is a plain join whose hot groups AQE can split
    groups = materialize(named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        *[F.col("doc").getField(c).alias(c) for c in docs.columns if c != text and c not in RESULT], F.col("best.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One document of each group of equal texts, with the columns of ``docs``.

    Kept rows are found by (id, text hash) and fetched by a semi join; where that pair repeats
    (repeated rows) one of the rows, equal in id and text, is taken."""
    groups = exact_groups(docs.select(id_col, text), id_col, text, **kw)
    kept = (groups.groupBy(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
            .agg(F.max("kept").alias("k"), F.count("*").alias("c")).where("k").select("kept_id", "kept_sha", "c"))
    kept = materialize(kept, "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.sha2(normalised(text), 256).alias("sha")).withColumn("id", F.col("doc").getField(id_col))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    if not kept.where("c > 1").isEmpty():
        out = out.dropDuplicates(["id", "sha"])
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
