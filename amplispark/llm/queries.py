"""Queries of the llm problems."""

from __future__ import annotations

from amplispark.llm.bpe import encode
from amplispark.llm.packing import pack
from amplispark.llm.pieces import split_oversized
from amplispark.llm.similar import similar_pairs
from amplispark.llm.sentences import sentences
from amplispark.llm.spans import shared_between
from amplispark.runtime import table
from pyspark.sql import functions as F


def p1_found(spark, sf):
    products = table(spark, sf, "products").withColumn("_name", F.regexp_replace(F.lower("primer_name"), "[^a-z0-9]", ""))
    return similar_pairs(products, "product_id", "_name", "sequence").select(F.col("a").alias("product_id_a"), F.col("b").alias("product_id_b"))


def p3_found(spark, sf):
    return shared_between([("seq", table(spark, sf, "sequences"), "seq_id", "sequence"), ("prod", table(spark, sf, "products"), "product_id", "sequence")])


def p6_found(spark, sf):
    seq = split_oversized(table(spark, sf, "sequences"), "seq_id", "sequence", "seq")
    return seq.unionByName(split_oversized(table(spark, sf, "genbank_records"), "gb_id", "seq", "gb"))


def p7_ids(spark, sf):
    return encode(table(spark, sf, "documents"))


def p8_pack(spark, sf):
    return pack(table(spark, sf, "documents"))


def p8_check(spark, sf):
    """Of p8_pack: how many documents are in it, whether each container holds at most 2,048 tokens, whether texts are whole unless larger than one."""
    packed = p8_pack(spark, sf).withColumn("size", F.col("token_end") - F.col("token_start"))
    full = packed.groupBy("container_id").agg((F.sum("size") <= 2048).alias("fits")).agg(F.min("fits").alias("fits"))
    last = F.max("token_end")
    docs = packed.groupBy("doc_id").agg(((F.sum("size") == last) & (F.min("token_start") == 0) & ((last > 2048) | (F.count(F.lit(1)) == 1))).alias("whole"))
    docs = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.min("whole").alias("whole"))
    return docs.join(F.broadcast(full), how="cross")  # one row each


def p9_found(spark, sf):
    return sentences(table(spark, sf, "documents"))


#: Common shingles counted for every pair that has any.
P1_SQL = """
WITH r AS (SELECT product_id, regexp_replace(lower(primer_name), '[^a-z0-9]', '', 'g') AS k, sequence AS s FROM products WHERE primer_name IS NOT NULL AND length(sequence) >= 8),
t AS (SELECT DISTINCT product_id, k, x FROM (SELECT product_id, k, substr(s, CAST(p + 1 AS BIGINT), 8) AS x FROM (SELECT product_id, k, s, unnest(range(0, length(s) - 7)) AS p FROM r))),
n AS (SELECT product_id, count(*) AS n FROM t GROUP BY product_id),
o AS (SELECT a.product_id AS product_id_a, b.product_id AS product_id_b, count(*) AS c FROM t a JOIN t b ON a.k = b.k AND a.x = b.x AND a.product_id < b.product_id GROUP BY 1, 2)
SELECT product_id_a, product_id_b FROM o JOIN n na ON na.product_id = product_id_a JOIN n nb ON nb.product_id = product_id_b WHERE 3 * c >= na.n + nb.n
"""

#: Every substring of 80 letters, then islands of the starts of those of more than one record.
P3_SQL = """
WITH r AS (SELECT 'seq' AS rec_kind, seq_id AS rec_id, sequence AS s FROM sequences WHERE length(sequence) >= 80
  UNION ALL SELECT 'prod', product_id, sequence FROM products WHERE length(sequence) >= 80),
k AS (SELECT rec_kind, rec_id, s, unnest(range(0, length(s) - 79)) AS p FROM r),
v AS (SELECT * FROM (SELECT rec_kind, rec_id, p, substr(s, CAST(p + 1 AS BIGINT), 80) AS x FROM k) WHERE regexp_full_match(x, '[ACGT]{80}')),
c AS (SELECT x FROM v GROUP BY x HAVING min(rec_kind || rec_id) <> max(rec_kind || rec_id)),
h AS (SELECT rec_kind, rec_id, p FROM v WHERE x IN (SELECT x FROM c)),
i AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY rec_kind, rec_id ORDER BY p) <= 80 THEN 0 ELSE 1 END AS fresh FROM h),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_kind, rec_id ORDER BY p) AS run FROM i)
SELECT rec_kind, rec_id, CAST(min(p) AS BIGINT) AS span_start, CAST(max(p) + 80 AS BIGINT) AS span_end FROM g GROUP BY rec_kind, rec_id, run
"""

#: The recurrence of the cuts, one step for each piece.
P6_SQL = r"""
WITH RECURSIVE r AS (SELECT 'seq' AS rec_kind, seq_id AS rec_id, sequence AS s FROM sequences WHERE length(sequence) > 2000
  UNION ALL SELECT 'gb', gb_id, seq FROM genbank_records WHERE length(seq) > 2000),
g AS (SELECT rec_kind, rec_id, length(s) AS len, list_filter(range(1000, length(s)), lambda p: regexp_full_match(substr(s, CAST(p - 9 AS BIGINT), 11), '[Nn]{10}[^Nn]')) AS bs FROM r),
c AS (SELECT rec_kind, rec_id, len, bs, 0 AS piece_no, CAST(0 AS BIGINT) AS a,
    CASE WHEN len <= 2000 THEN len ELSE coalesce(list_max(list_filter(bs, lambda b: b >= 1000 AND b <= 2000)), 2000) END AS e FROM g
  UNION ALL SELECT rec_kind, rec_id, len, bs, piece_no + 1, e - 100,
    CASE WHEN len - (e - 100) <= 2000 THEN len ELSE coalesce(list_max(list_filter(bs, lambda b: b >= e + 900 AND b <= e + 1900)), e + 1900) END FROM c WHERE e < len)
SELECT rec_kind, rec_id, CAST(piece_no AS BIGINT) AS piece_no, a AS piece_start, CAST(e AS BIGINT) AS piece_end FROM c
"""

QUERIES = {
    "p1_found": (p1_found, P1_SQL),
    "p3_found": (p3_found, P3_SQL),
    "p6_found": (p6_found, P6_SQL),
    "p7_ids": (p7_ids, None),
    "p8_pack": (p8_pack, None),
    "p8_check": (p8_check, "SELECT count(DISTINCT doc_id) AS n_documents, true AS whole, true AS fits FROM documents"),
    "p9_found": (p9_found, None),
}
