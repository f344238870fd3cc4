"""Column functions over DNA strings. A null gives null."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Each letter's complement. Lower case stays lower; every other letter becomes N.
LETTERS = "ACGTURYSWKMBVDHNacgturyswkmbvdhn"
COMPLEMENTS = "TGCAAYRSWMKVBHDNtgcaayrswmkvbhdn"
AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 80


class _Complements(dict):
    """For str.translate: every letter that isn't listed becomes N."""

    def __missing__(self, letter: int) -> str:
        return "N"


COMPLEMENT_OF = _Complements(str.maketrans(LETTERS, COMPLEMENTS))


def rc_text(seq: str) -> str:
    """reverse_complement of a Python string."""
    return seq.translate(COMPLEMENT_OF)[::-1]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(c: Column | str) -> Column:
    return F.translate(F.regexp_replace(_col(c), f"[^{LETTERS}]", "N"), LETTERS, COMPLEMENTS)


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(complement(c))


def canonical(c: Column | str) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(_col(c), reverse_complement(c))


def identity(distance: Column | str, length: Column | str) -> Column:
    """1 - distance / length, at least 0; 0 for length 0."""
    d, n = _col(distance).cast("double"), _col(length).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(n - d, F.lit(0.0)) / n)


def circular_extend(c: Column | str, max_len: int) -> Column:
    """The sequence followed by its first max_len - 1 letters, or as many as it has."""
    s = _col(c)
    return F.concat(s, F.substring(s, 1, max(max_len - 1, 0)))


def is_circular_wrap(pos: Column | str, length: Column | str) -> Column:
    return _col(pos) >= _col(length)


def original_pos(pos: Column | str, length: Column | str) -> Column:
    """Position in the sequence before extension; null for length 0."""
    n = _col(length)
    return F.when(n != 0, F.pmod(_col(pos), n))


def n_fraction(c: Column | str) -> Column:
    """Share of the letter N; 0 for an empty sequence."""
    s = _col(c)
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise((F.length(s) - F.length(F.replace(s, F.lit("N"), F.lit("")))) / F.length(s))


def ascii_upper(c: Column | str) -> Column:
    return F.translate(_col(c), LOWER_AZ, AZ)


def reference_id(header: Column | str) -> Column:
    """First word of a header; the header itself if it has no word."""
    h = _col(header)
    return F.when(h.rlike(r"\S"), F.regexp_extract(h, r"\S+", 0)).otherwise(h)


def genbank_header(name: Column | str, accession: Column | str, definition: Column | str, n: Column | str) -> Column:
    """Header of a GenBank record, the n-th of its file: the first of name, accession and definition that isn't null or empty."""
    filled = [F.when(_col(c) != "", _col(c)) for c in (name, accession, definition)]
    return F.coalesce(*filled, F.concat(F.lit("unknown_"), _col(n).cast("string")))


def amplicon_id(header: Column | str, primer: Column | str, strand: Column | str, wrap: Column | str, case: Column | str) -> Column:
    return F.concat(
        reference_id(header), F.lit(":"), _col(primer),
        F.when(_col(strand) == "-", "_rc").otherwise(""), F.when(_col(wrap), "_wrap").otherwise(""),
        F.lit(":"), _col(case).cast("string"),
    )


def identity_text(c: Column | str) -> Column:
    """Four decimals, ties to even."""
    return F.when(_col(c).isNotNull(), F.format_string("%.4f", F.bround(_col(c), 4)))


def wrapped(c: Column | str, width: int = WIDTH) -> Column:
    """Lines of `width` letters."""
    return F.regexp_replace(_col(c), f"(.{{{width}}})(?!$)", "$1\n")


# Extensions of the two formats, lower case, after one .gz is taken off.
FASTA_EXTENSIONS = ("fasta", "fa", "fna", "ffn", "faa", "frn", "fas")
GENBANK_EXTENSIONS = ("gb", "gbk", "gbff", "genbank", "gbf")


def file_format(path: Column | str) -> Column:
    """fasta, genbank or null, by extension."""
    ext = F.regexp_extract(F.regexp_replace(F.lower(_col(path)), r"\.gz$", ""), r"[^/]\.([^./]+)$", 1)
    return F.when(ext.isin(*FASTA_EXTENSIONS), "fasta").when(ext.isin(*GENBANK_EXTENSIONS), "genbank")


def is_gzipped(path: Column | str) -> Column:
    return F.lower(_col(path)).endswith(".gz")


def register(spark: SparkSession) -> None:
    """The scalar functions for SQL: dna_complement, dna_rc, dna_canonical, dna_upper, n_fraction, seq_identity, circular_extend."""
    comp = f"translate(regexp_replace(s, '[^{LETTERS}]', 'N'), '{LETTERS}', '{COMPLEMENTS}')"
    for signature, kind, body in (
        ("dna_complement(s STRING)", "STRING", comp),
        ("dna_rc(s STRING)", "STRING", f"reverse({comp})"),
        ("dna_canonical(s STRING)", "STRING", f"least(s, reverse({comp}))"),
        ("dna_upper(s STRING)", "STRING", f"translate(s, '{LOWER_AZ}', '{AZ}')"),
        ("n_fraction(s STRING)", "DOUBLE", "CASE WHEN length(s) = 0 THEN 0.0D ELSE (length(s) - length(replace(s, 'N', ''))) / length(s) END"),
        ("seq_identity(d BIGINT, n BIGINT)", "DOUBLE", "CASE WHEN n = 0 THEN 0.0D ELSE CAST(greatest(n - d, 0) AS DOUBLE) / n END"),
        ("circular_extend(s STRING, m INT)", "STRING", "concat(s, substring(s, 1, greatest(m - 1, 0)))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
