"""Table functions for SQL: primer_matches and pcr_products."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from amplispark.config import MatchConfig, PcrConfig
from amplispark.operators.kernel import find_matches
from amplispark.operators.products import _pair_hits, _pool_hits, _searched
from amplispark.sources.primers import Primer, PrimerPair


@udtf(returnType="start: bigint, end: bigint, edit_distance: int, strand: string, cigar: string, identity: double")
class PrimerMatches:
    """primer_matches(sequence, primer, max_errors, search_rc)"""

    def eval(self, sequence: str, primer: str, max_errors: int, search_rc: bool) -> Iterator[tuple]:
        for m in find_matches(primer or "", sequence or "", MatchConfig(max_errors, search_rc=search_rc)):
            yield m.start, m.end, m.edit_distance, m.strand, m.cigar, m.identity


@udtf(returnType="product_start: bigint, product_end: bigint, fwd_edits: int, rev_edits: int, strand: string, product: string")
class PcrProducts:
    """pcr_products(sequence, forward, reverse, max_errors, min_len, max_len, circular, search_rc); positions in what was searched"""

    def eval(self, sequence: str, forward: str, reverse: str, max_errors: int, min_len: int, max_len: int, circular: bool, search_rc: bool) -> Iterator[tuple]:
        config = PcrConfig(MatchConfig(max_errors, search_rc=search_rc), min_len, max_len, circular)
        yield from _rows(sequence, config, lambda t: _pair_hits(t, [PrimerPair("", forward or "", reverse or "")], config))


@udtf(returnType="product_start: bigint, product_end: bigint, fwd_edits: int, rev_edits: int, strand: string, product: string")
class PoolProducts:
    """pool_products(sequence, primers with ; between, max_errors, min_len, max_len, self_match, search_rc)"""

    def eval(self, sequence: str, primers: str, max_errors: int, min_len: int, max_len: int, self_match: bool, search_rc: bool) -> Iterator[tuple]:
        config = PcrConfig(MatchConfig(max_errors, search_rc=search_rc), min_len, max_len)
        pool = [Primer(p, p) for p in (primers or "").split(";") if p]
        yield from _rows(sequence, config, lambda t: _pool_hits(t, pool, config, self_match))


def _rows(sequence: str, config: PcrConfig, hits) -> Iterator[tuple]:
    for strand in ("+", "-")[: 1 + config.match.search_rc]:
        text = _searched([sequence or ""], config, strand)
        for _, _, _, _, _, f, r in hits(text) if text[0] else ():
            if config.min_len <= r.end - f.start <= config.max_len:
                yield f.start, r.end, f.edit_distance, r.edit_distance, strand, text[0][f.start : r.end]


def register(spark: SparkSession) -> None:
    spark.udtf.register("primer_matches", PrimerMatches)
    spark.udtf.register("pcr_products", PcrProducts)
    spark.udtf.register("pool_products", PoolProducts)
