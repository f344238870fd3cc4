"""Queries of the general data problems: small files (2), broken rows (4), hot keys (5)."""

from __future__ import annotations

from amplispark.operators.consolidate import consolidated, read_consolidated, read_manifest
from amplispark.operators.numbering import key_summary, misnumbered
from amplispark.operators.rowparse import parse_primer_lines
from amplispark.runtime import table
from pyspark.sql import functions as F

P2_SQL = r"""
WITH c AS (SELECT source_file, content, row_number() OVER (PARTITION BY source_file ORDER BY landed_at DESC NULLS LAST, file_id DESC NULLS LAST) AS rn FROM inbox_files),
l AS (SELECT source_file, string_split(CASE WHEN starts_with(content, chr(65279)) THEN substr(content, 2) ELSE content END, chr(10)) AS ls FROM c WHERE rn = 1),
h AS (SELECT source_file, list_filter(ls, lambda x: starts_with(x, '>')) AS hs FROM l),
r AS (SELECT source_file, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS record_idx FROM h)
SELECT source_file, CAST(record_idx AS BIGINT) AS record_idx, coalesce(regexp_extract(h, '^>\s*(\S+)', 1), '') AS header FROM r
"""

P2_TOTALS_SQL = r"""
WITH c AS (SELECT coalesce(content, '') AS content, row_number() OVER (PARTITION BY source_file ORDER BY landed_at DESC NULLS LAST, file_id DESC NULLS LAST) AS rn FROM inbox_files)
SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(sum(len(regexp_extract_all(content, '(?:^|\n)\x{FEFF}?(>)'))) AS BIGINT) AS n_records, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM c WHERE rn = 1
"""

#: A field: quoted with only blanks around it, or without any quote sign.
_FIELD = r"""(?:[ \t]*"(?:[^"]|"")*"[ \t\r]*|[^",]*)"""
_VALUE = r"""trim(CASE WHEN regexp_full_match({0}, '[ \t]*"(?:[^"]|"")*"[ \t\r]*') THEN replace(regexp_extract({0}, '"((?:[^"]|"")*)"', 1), '""', '"') ELSE {0} END, chr(32) || chr(9) || chr(13) || chr(10))"""
P4_PARSED = rf"""
WITH b AS (SELECT line_id, line FROM primer_lines WHERE (line_no IS NULL OR line_no <> 1) AND line IS NOT NULL AND trim(line, chr(32) || chr(9) || chr(13) || chr(10)) <> ''),
q AS (SELECT line_id, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS quoted_well, regexp_full_match(line, '{_FIELD}(?:,{_FIELD}){{2,}}') AS three FROM b),
f AS (SELECT *, regexp_extract(line, '^({_FIELD}),({_FIELD}),({_FIELD})(?:,|$)', 1) AS f1, regexp_extract(line, '^({_FIELD}),({_FIELD}),({_FIELD})(?:,|$)', 2) AS f2, regexp_extract(line, '^({_FIELD}),({_FIELD}),({_FIELD})(?:,|$)', 3) AS f3 FROM q),
v AS (SELECT *, {_VALUE.format("f1")} AS v1, {_VALUE.format("f2")} AS v2, {_VALUE.format("f3")} AS v3 FROM f),
p AS (SELECT line_id, v1, v2, v3, CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT three THEN 'columns' WHEN v1 = '' OR v2 = '' OR v3 = '' THEN 'empty'
  WHEN NOT regexp_full_match(v2, '[ACGTRYSWKMBDHVNacgtryswkmbdhvn]*') OR NOT regexp_full_match(v3, '[ACGTRYSWKMBDHVNacgtryswkmbdhvn]*') THEN 'letters' END AS reason FROM v)
"""

P5_SQL = """
SELECT product_id FROM (
  SELECT product_id, case_number, lag(case_number) OVER (PARTITION BY reference_header, primer_name ORDER BY found_at NULLS FIRST, product_id NULLS FIRST, case_number NULLS FIRST) AS before
  FROM products WHERE reference_header IS NOT NULL AND primer_name IS NOT NULL) WHERE case_number <= before
"""
P5_KEYS_SQL = """
SELECT reference_header, primer_name, count(*) AS n_products, min(product_id) AS first_product, max(product_id) AS last_product, max(full_length) AS longest
FROM products GROUP BY ALL
"""


def p2_found(spark, sf):
    return read_consolidated(spark, consolidated(table(spark, sf, "inbox_files"))[0]).select("source_file", "record_idx", "header")


def p2_manifest(spark, sf):
    return read_manifest(spark, consolidated(table(spark, sf, "inbox_files"))[0]).select("grp", "n_files", "n_records", "n_bytes")


def p2_totals(spark, sf):
    sums = [F.sum(c).alias(c) for c in ("n_files", "n_records", "n_bytes")]
    return p2_manifest(spark, sf).agg(*sums)


def p4_found(spark, sf):
    return parse_primer_lines(table(spark, sf, "primer_lines")).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p4_loaded(spark, sf):
    return parse_primer_lines(table(spark, sf, "primer_lines")).where(F.col("reason").isNull()).select("line_id", "name", "forward", "reverse")


def p5_found(spark, sf):
    return misnumbered(table(spark, sf, "products"))


def p5_keys(spark, sf):
    return key_summary(table(spark, sf, "products"))


QUERIES = {
    "p2_found": (p2_found, P2_SQL),
    "p2_manifest": (p2_manifest, None),
    "p2_totals": (p2_totals, P2_TOTALS_SQL),
    "p4_found": (p4_found, P4_PARSED + "SELECT line_id, reason FROM p WHERE reason IS NOT NULL"),
    "p4_loaded": (p4_loaded, P4_PARSED + "SELECT line_id, v1 AS name, v2 AS forward, v3 AS reverse FROM p WHERE reason IS NULL"),
    "p5_found": (p5_found, P5_SQL),
    "p5_keys": (p5_keys, P5_KEYS_SQL),
}
