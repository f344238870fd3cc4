"""Queries of in-silico PCR over the tables sequences, products, primers and pool_primers."""

from __future__ import annotations

from amplispark.config import MatchConfig, PcrConfig
from amplispark.functions import dna
from amplispark.operators.finalize import count_by, dedup, finalize, flattened, number, number_per_call
from amplispark.operators.products import matches, pair_products, pool_products, records
from amplispark.plans import oracle
from amplispark.runtime import table
from amplispark.sources.primers import Primer, pairs_of, parse_primers, pool_of, primers_frame
from amplispark.sources.writers import fasta_text, tsv_columns
from pyspark.sql import functions as F

_RC = oracle.RC


def _recs(spark, sf):
    return records(table(spark, sf, "sequences"), "seq_id", "header", "sequence", "source_file")


def _pairs(spark, sf):
    return pairs_of(table(spark, sf, "primers"))


def _pool(spark, sf):
    return pool_of(table(spark, sf, "pool_primers"))


def _arms(spark, sf):
    """Every primer there is: the forward arms of the pairs, then their reverse arms, then the pool."""
    pairs = _pairs(spark, sf)
    return [Primer(p.name, p.forward) for p in pairs] + [Primer(p.name, p.reverse) for p in pairs] + _pool(spark, sf)


def _config(k=0, rc=False, identity=0.0, **more):
    return PcrConfig(MatchConfig(k, identity, rc), **({"min_len": 50, "max_len": 2000, "max_n_fraction": 0.1} | more))


def _scalar(name, make):
    def run(spark, sf):
        return table(spark, sf, "sequences").select("seq_id", make().alias(name))

    return run


def _out(df):
    return flattened(df).drop("source_file", "reference_header")


def _pair(**config):
    """A query of pairs and its SQL."""
    return lambda spark, sf: _out(pair_products(_recs(spark, sf), _pairs(spark, sf), _config(**config))), oracle.plain(pool=False, **_named(config))


def _pooled(self_match=False, **config):
    return lambda spark, sf: _out(pool_products(_recs(spark, sf), _pool(spark, sf), _config(**config), self_match)), oracle.plain(pool=True, self_match=self_match, **_named(config))


def _named(config):
    """The settings under the names that the SQL has for them."""
    return {{"trim_primers": "trim", "max_n_fraction": "n"}.get(k, k): v for k, v in config.items()}


def _all(spark, sf):
    return pair_products(_recs(spark, sf), _pairs(spark, sf), _config(1, True))


def _match(k, rc=False, identity=0.0):
    run = lambda spark, sf: matches(_recs(spark, sf), _arms(spark, sf), MatchConfig(k, identity, rc)).select("rec_id", "primer_idx", "start", "end", "edit_distance", "strand", "cigar", "identity")
    return run, oracle.matches(k, rc, identity)


def _given(spark, sf):
    """The products table as products."""
    match = lambda s: F.struct(F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"), F.col(f"{s}_mismatches").alias("edit_distance"), F.col("strand"), F.col(f"{s}_cigar").alias("cigar"), F.col(f"{s}_identity").alias("identity"))
    t = table(spark, sf, "products")
    return t.select(F.col("product_id").alias("rec_id"), F.lit(0).cast("bigint").alias("primer_idx"), F.lit(0).cast("bigint").alias("rev_idx"), "reference_header", "source_file", "primer_name", "sequence", "full_length", match("fwd").alias("fwd"), match("rev").alias("rev"), "strand", "is_circular_wrap", "original_start", "original_end", "case_number")


def dedup_by_reference(spark, sf):
    return dedup(_given(spark, sf)).select(F.col("rec_id").alias("product_id"), "reference_header")


def case_numbers(spark, sf):
    return number(_given(spark, sf).drop("case_number")).select(F.col("rec_id").alias("product_id"), "case_number")


def header_format(spark, sf):
    t = table(spark, sf, "products")
    return t.select("product_id", dna.amplicon_id("reference_header", "primer_name", "strand", "is_circular_wrap", "case_number").alias("amplicon_id"))


def summary_totals(spark, sf):
    seqs = table(spark, sf, "sequences").agg(F.count(F.lit(1)).alias("total_sequences"))
    prims = table(spark, sf, "primers").agg(F.count(F.lit(1)).alias("total_primers"))
    prods = table(spark, sf, "products").agg(F.count(F.lit(1)).alias("total_products"))
    return seqs.join(F.broadcast(prims), how="cross").join(F.broadcast(prods), how="cross")  # one row each


def identity(spark, sf):
    t = table(spark, sf, "products")
    sides = [(f"{s}_{name}", c) for s in ("fwd", "rev") for name, c in (("computed", dna.identity(f"{s}_mismatches", F.col(f"{s}_end") - F.col(f"{s}_start"))), ("text", dna.identity_text(f"{s}_identity")))]
    return t.select("product_id", *[c.alias(name) for name, c in sides])


def wrap_and_origpos(spark, sf):
    t = table(spark, sf, "products")
    sides = [(f"{s}_{name}", c) for s in ("fwd", "rev") for name, c in (("wraps", dna.is_circular_wrap(f"{s}_end", "full_length")), ("original", dna.original_pos(f"{s}_start", "full_length")))]
    return t.select("product_id", *[c.alias(name) for name, c in sides])


def genbank_header(spark, sf):
    """Header and searched sequence of each GenBank record; those without letters are no records."""
    t = table(spark, sf, "genbank_records").where(F.length("seq") > 0)
    return t.select("gb_id", dna.genbank_header("name", "accession", "definition", "gb_id").alias("header"), dna.ascii_upper("seq").alias("sequence"), "is_circular")


def primers_inline(spark, sf):
    """The usable pairs, written as name:forward:reverse;... and parsed again."""
    usable = [p for p in _pairs(spark, sf) if p.forward and p.reverse and not set(p.name) & set(":;")]
    return primers_frame(spark, parse_primers(";".join(f" {p.name} :{p.forward.lower()}:{p.reverse}" for p in usable)))


def format_detect(spark, sf):
    return table(spark, sf, "inbox_files").select("file_id", dna.file_format("source_file").alias("format"), dna.is_gzipped("source_file").alias("gzipped"))


def primer_validate(spark, sf):
    """Both arms of the pairs and the pool."""
    arms = table(spark, sf, "primers").select("primer_idx", F.explode(F.create_map(F.lit("forward"), "forward", F.lit("reverse"), "reverse")).alias("arm", "raw"))
    arms = arms.unionByName(table(spark, sf, "pool_primers").select("primer_idx", F.lit("pool").alias("arm"), F.col("sequence").alias("raw")))
    seq = dna.ascii_upper(F.trim("raw"))
    return arms.select("primer_idx", "arm", seq.rlike("^[ACGTRYSWKMBDHVN]*$").alias("valid"), (~F.length(seq).between(10, 50)).alias("unusual"))


_AMPLICON = r"CASE WHEN regexp_matches(reference_header, '\S') THEN regexp_extract(reference_header, '\S+') ELSE reference_header END || ':' || primer_name || CASE WHEN strand = '-' THEN '_rc' ELSE '' END || CASE WHEN is_circular_wrap THEN '_wrap' ELSE '' END || ':' || case_number"
_NUMBER = "row_number() OVER (PARTITION BY reference_header ORDER BY product_id)"
_FASTA_EXT, _GB_EXT = ("'" + "','".join(e) + "'" for e in (dna.FASTA_EXTENSIONS, dna.GENBANK_EXTENSIONS))
_EXT = r"regexp_extract(regexp_replace(lower(source_file), '\.gz$', ''), '[^/]\.([^./]+)$', 1)"

QUERIES = {
    "rc": (_scalar("rc", lambda: dna.reverse_complement("sequence")), f"SELECT seq_id, {_RC.format('sequence')} AS rc FROM sequences"),
    "complement": (_scalar("complement", lambda: dna.complement("sequence")), f"SELECT seq_id, reverse({_RC.format('sequence')}) AS complement FROM sequences"),
    "canonical": (_scalar("canonical", lambda: dna.canonical("sequence")), f"SELECT seq_id, least(sequence, {_RC.format('sequence')}) AS canonical FROM sequences"),
    "n_fraction": (_scalar("n_fraction", lambda: dna.n_fraction("sequence")), "SELECT seq_id, CASE WHEN length(sequence) = 0 THEN 0.0::DOUBLE ELSE (length(sequence) - length(replace(sequence, 'N', ''))) / length(sequence) END AS n_fraction FROM sequences"),
    "circular_extend": (_scalar("extended", lambda: dna.circular_extend("sequence", 100)), "SELECT seq_id, sequence || substr(sequence, 1, 99) AS extended FROM sequences"),
    "ascii_upper": (_scalar("upper", lambda: dna.ascii_upper("sequence")), f"SELECT seq_id, translate(sequence, '{dna.LOWER_AZ}', '{dna.AZ}') AS upper FROM sequences"),
    "reference_id": (_scalar("reference_id", lambda: dna.reference_id("header")), r"SELECT seq_id, CASE WHEN regexp_matches(header, '\S') THEN regexp_extract(header, '\S+') ELSE header END AS reference_id FROM sequences"),
    "wrap80": (_scalar("lines", lambda: dna.wrapped("sequence")), r"SELECT seq_id, rtrim(regexp_replace(sequence, '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS lines FROM sequences"),
    "identity": (identity, "SELECT product_id, " + ", ".join(f"CASE WHEN {x}_end = {x}_start THEN 0.0 ELSE greatest({x}_end - {x}_start - {x}_mismatches, 0) / ({x}_end - {x}_start) END AS {x}_computed, format('{{:.4f}}', round_even({x}_identity, 4)) AS {x}_text" for x in ("fwd", "rev")) + " FROM products"),
    "wrap_and_origpos": (wrap_and_origpos, "SELECT product_id, " + ", ".join(f"{x}_end >= full_length AS {x}_wraps, CASE WHEN full_length <> 0 THEN (({x}_start % full_length) + full_length) % full_length END AS {x}_original" for x in ("fwd", "rev")) + " FROM products"),
    "format_detect": (format_detect, f"SELECT file_id, CASE WHEN {_EXT} IN ({_FASTA_EXT}) THEN 'fasta' WHEN {_EXT} IN ({_GB_EXT}) THEN 'genbank' END AS format, ends_with(lower(source_file), '.gz') AS gzipped FROM inbox_files"),
    "primer_validate": (primer_validate, "SELECT primer_idx, arm, regexp_full_match(upper(trim(raw, ' ')), '[ACGTRYSWKMBDHVN]*') AS valid, length(trim(raw, ' ')) NOT BETWEEN 10 AND 50 AS unusual FROM (SELECT primer_idx, 'forward' AS arm, forward AS raw FROM primers UNION ALL SELECT primer_idx, 'reverse', reverse FROM primers UNION ALL SELECT primer_idx, 'pool', sequence FROM pool_primers)"),
    "genbank_header": (genbank_header, f"SELECT gb_id, coalesce(nullif(name, ''), nullif(accession, ''), nullif(definition, ''), 'unknown_' || gb_id) AS header, translate(seq, '{dna.LOWER_AZ}', '{dna.AZ}') AS sequence, is_circular FROM genbank_records WHERE length(seq) > 0"),
    "primers_inline": (primers_inline, oracle.INLINE),
    "match_exact": _match(0),
    "match_approx": _match(2),
    "match_identity_filter": _match(2, identity=0.95),
    "match_rc_strand": _match(1, True),
    "pair_linear": _pair(),
    "pair_trimmed": _pair(trim_primers=True),
    "pair_n_filter": _pair(max_n_fraction=1.0),
    "pair_len_filter": _pair(min_len=150, max_len=400),
    "pair_approx": _pair(k=2),
    "pair_rc_strand": _pair(k=1, rc=True),
    "pair_circular": _pair(k=1, circular=True),
    "pool_basic": _pooled(),
    "pool_self_match": _pooled(self_match=True),
    "pool_circular": _pooled(circular=True),
    "pool_rc_strand": _pooled(k=1, rc=True),
    "pcr_finalized": (lambda spark, sf: _out(finalize(_all(spark, sf), True)), oracle.numbered(distinct=True, pool=False, k=1, rc=True)),
    "pcr_numbered": (lambda spark, sf: _out(finalize(_all(spark, sf))), oracle.numbered(pool=False, k=1, rc=True)),
    "pcr_numbered_per_call": (lambda spark, sf: _out(number_per_call(_all(spark, sf))), oracle.numbered(per_call=True, pool=False, k=1, rc=True)),
    "dedup_by_reference": (dedup_by_reference, f"SELECT min(product_id) AS product_id, reference_header FROM (SELECT product_id, reference_header, least(sequence, {_RC.format('sequence')}) AS c FROM products) GROUP BY reference_header, c"),
    "case_numbers": (case_numbers, f"SELECT product_id, {_NUMBER} AS case_number FROM products"),
    "header_format": (header_format, f"SELECT product_id, {_AMPLICON} AS amplicon_id FROM products"),
    "fasta_records": (lambda spark, sf: fasta_text(_given(spark, sf)), rf"SELECT '>' || {_AMPLICON} || chr(9) || 'pos=' || original_start || '-' || original_end || chr(9) || 'strand=' || strand || chr(9) || 'len=' || full_length || chr(10) || rtrim(regexp_replace(sequence, '(.{{80}})', '\1' || chr(10), 'g'), chr(10)) AS value FROM products"),
    "tsv_rows": (lambda spark, sf: tsv_columns(_given(spark, sf)), f"SELECT {_AMPLICON} AS amplicon_id, coalesce(reference_header, '') AS reference_id, coalesce(source_file, '') AS source_file, coalesce(primer_name, '') AS primer_name, length(sequence)::VARCHAR AS product_len, coalesce(full_length::VARCHAR, '') AS full_len, "
        + ", ".join(f"coalesce({s}_start::VARCHAR, '') AS {s}_start, coalesce({s}_end::VARCHAR, '') AS {s}_end, coalesce({s}_mismatches::VARCHAR, '') AS {s}_mismatches, coalesce(format('{{:.4f}}', round_even({s}_identity, 4)), '') AS {s}_identity, coalesce({s}_cigar, '') AS {s}_cigar" for s in ("fwd", "rev"))
        + ", coalesce(strand, '') AS strand, coalesce(is_circular_wrap::VARCHAR, '') AS is_circular_wrap, coalesce(sequence, '') AS product_seq FROM products"),
    "count_by_primer": (lambda spark, sf: count_by(table(spark, sf, "products"), "primer_name"), "SELECT primer_name, count(*) AS n_products FROM products GROUP BY primer_name"),
    "count_by_reference": (lambda spark, sf: count_by(table(spark, sf, "products"), "reference_header"), "SELECT reference_header, count(*) AS n_products FROM products GROUP BY reference_header"),
    "summary_totals": (summary_totals, "SELECT (SELECT count(*) FROM sequences) AS total_sequences, (SELECT count(*) FROM primers) AS total_primers, (SELECT count(*) FROM products) AS total_products"),
}
