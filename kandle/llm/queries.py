"""Registered queries opN_<name> of the training-data operators, and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kandle.llm import block_naming, lexical, licenses, minhash, mixing, nbsvm, packing, prefix_trie, quality_bands, sp_scan, token_files, toxicity, warc
from kandle.llm.common import Q, SQL, documents, query  # noqa: F401
from kandle.sources.tables import table

_WS = r"[\x20\x09-\x0D]"


@query("op1_quality_bands")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.quality_report(documents(spark, sf_dir))


EXACT_SQL = rf"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""


@query("op3_block_naming", EXACT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


@query("op8_minhash_stars")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_report(documents(spark, sf_dir))


MIX_SQL = r"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY sk) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY sk),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, sum(source_size) OVER () AS total FROM s),
a AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER (ORDER BY cap / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_onward FROM r),
l AS (SELECT *, (total - cap_before) / w_onward AS level FROM a),
g AS (SELECT sk, source_size, CASE WHEN cap / w <= level THEN cap ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER () END AS target,
    total FROM l),
u AS (SELECT doc_id, sk, size, count(*) AS m, substring(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 16) AS u FROM d GROUP BY ALL),
q AS (SELECT u.*, source_size, target, total, sum(m * size) OVER (PARTITION BY u.sk ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM u JOIN g USING (sk)),
e AS (SELECT q.*, epoch, (epoch * source_size + upto) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE target > 0 AND size > 0),
c AS (SELECT *, sum(m * size) OVER (ORDER BY finish, sk, u, doc_id, size ROWS UNBOUNDED PRECEDING) AS served FROM e),
t AS (SELECT doc_id, sk, size, count(*) AS copies FROM c WHERE served <= total GROUP BY ALL)
SELECT d.doc_id, d.size, source_size, target, CAST(coalesce(copies, 0) * d.size AS BIGINT) AS taken
FROM d JOIN g USING (sk) LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM d.doc_id AND t.sk = d.sk AND t.size = d.size"""


@query("op10_fair_queue_mix", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM g"""


@query("op5_warc", WARC_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op7_sentencepiece_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_scan.token_report(documents(spark, sf_dir))


@query("op9_license_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op4_toxicity_trees")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op6_nb_svm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op13_bound_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(documents(spark, sf_dir))


#: CRC-32 in SQL: the bytes of the decimal id, eight shifts each
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(c AS VARCHAR)) + 1),
      lambda i: CAST(ord(CAST(c AS VARCHAR)[i]) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
      lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""
TRIE_SQL = f"""WITH t AS (SELECT conv_id AS c, len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS both,
    sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(coalesce(text, '')) AS chars, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'t': t, 'chars': chars}} ORDER BY turn NULLS FIRST, t) AS own FROM t GROUP BY c),
h AS (SELECT *, {_CRC} % 6 AS h FROM o),
s AS (SELECT h.c, list_concat(coalesce(b.own[1:h], []), h.own[h + 1:]) AS seq FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
p AS (SELECT c, seq, d, array_to_string(list_transform(seq[1:d], lambda x: x.t), ',') AS path,
    array_to_string(list_transform(seq[1:greatest(d - 1, 0)], lambda x: x.t), ',') AS up, coalesce(seq[d].chars, 0) AS chars FROM s, unnest(range(0, len(seq) + 1)) AS u(d)),
n AS (SELECT path, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(seq[1:d]) AS seq,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(seq) = d), '')) AS ends FROM p GROUP BY path, d),
k AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path AND k.d = n.d),
b AS (SELECT array_to_string(list_transform(seq[1:x], lambda y: y.t), ',') AS path, x AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum((n_convs - 1) * chars) AS saved_tokens FROM a, unnest(range(0, d + 1)) AS u(x) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
    CAST(b.saved_tokens AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN b ON a.path = b.path AND a.d = b.d LEFT JOIN n q ON a.d > 0 AND q.path = a.up AND q.d = a.d - 1"""


@query("op12_burst_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_report(table(spark, sf_dir, "conversations"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEXICAL_SQL = f"""WITH i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM g, s),
x AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
    FROM f JOIN i USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@query("op11_blocked_blas", LEXICAL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir))
