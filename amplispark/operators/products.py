"""Matches of primers in records, and products made of two matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplispark.config import MatchConfig, PcrConfig
from amplispark.functions.dna import AZ, LOWER_AZ, original_pos, rc_text
from amplispark.operators.kernel import Match, Texts, to_bits
from amplispark.runtime import slices
from amplispark.sources.primers import PAIRS_A_RUN, POOL_A_RUN, Primer, PrimerPair, pairs_in_runs, pool_in_runs

RECORD = ("rec_id", "header", "source_file", "sequence")
_MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("edit_distance", pa.int32()), ("strand", pa.string()), ("cigar", pa.string()), ("identity", pa.float64())])
MATCH_SQL = "struct<start:bigint,end:bigint,edit_distance:int,strand:string,cigar:string,identity:double>"
_RAW = pa.schema([
    ("rec_id", pa.int64()), ("reference_header", pa.string()), ("source_file", pa.string()), ("len", pa.int64()), ("strand", pa.string()),
    ("primer_idx", pa.int64()), ("rev_idx", pa.int64()), ("primer_name", pa.string()), ("sequence", pa.string()), ("fwd", _MATCH), ("rev", _MATCH),
])
RAW_SQL = f"rec_id bigint, reference_header string, source_file string, len bigint, strand string, primer_idx bigint, rev_idx bigint, primer_name string, sequence string, fwd {MATCH_SQL}, rev {MATCH_SQL}"
UPPER = str.maketrans(LOWER_AZ, AZ)
#: Letters of a longer record that one task searches, and letters of context to their left.
TILE_LETTERS, HALO = 1 << 22, 1 << 16
#: Product rows that a worker holds before it hands them over.
HELD = 5_000
#: Pairs of matches of a record that are filtered at once.
PAIRED = 1 << 19


def records(df: DataFrame, rec_id: str, header: str, sequence: str, source_file: str | None = None) -> DataFrame:
    """A table's columns as records: rec_id (bigint, gives the order), header, source_file, sequence; null sequences left out."""
    source = F.col(source_file) if source_file else F.lit(None).cast("string")
    return df.where(F.col(sequence).isNotNull()).select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(header).alias("header"), source.alias("source_file"), F.col(sequence).alias("sequence"))


def _searched(seqs: list[str], config: PcrConfig, strand: str) -> list[str]:
    """What is searched: the sequence or its reverse complement, extended where it is circular."""
    if strand == "-":
        seqs = [rc_text(s) for s in seqs]
    return [s + s[: max(config.max_len - 1, 0)] for s in seqs] if config.circular else seqs


def _strands(config: PcrConfig) -> tuple[str, ...]:
    return ("+", "-") if config.match.search_rc else ("+",)


Found = Iterator[tuple[int, str, int, int, str, Match, Match]]


def _pair_hits(texts: list[str], primers: Sequence[PrimerPair], config: PcrConfig) -> Found:
    """Each forward match with the matches of the reverse primer downstream.

    These are looked for in the slice from the forward match's end to its start + max_len alone: the slice's ends
    are ends of text for the search.
    """
    bits = [to_bits(t) for t in texts]
    laid = Texts(bits, config.match.max_errors)
    for i, p in enumerate(primers):
        if not p.forward or not p.reverse:
            continue
        hits = [(t, f) for t, f in laid.find(to_bits(p.forward), config.match) if f.end < min(f.start + config.max_len, len(bits[t]))]
        if not hits:
            continue
        rev = to_bits(rc_text(p.reverse))
        for lo in range(0, len(hits), 2000):
            part = hits[lo : lo + 2000]
            down = Texts([bits[t][f.end : f.start + config.max_len] for t, f in part], config.match.max_errors)
            for h, r in down.find(rev, config.match):
                t, f = part[h]
                yield t, p.name, i, i, "", f, Match(r.start + f.end, r.end + f.end, r.edit_distance, r.strand, r.cigar, r.identity)


def _pool_hits(texts: list[str], primers: Sequence[Primer], config: PcrConfig, self_match: bool, others: Sequence[Primer] | None = None, shift: int = 0) -> Found:
    """Each match of each primer with each match of the reverse complement of each (other) primer that ends further on.

    The other ones are `others`, of which the i-th is the same primer as the (i + shift)-th of the first, or else the same list.

    The matches of a record are sorted by end, so the partners of one are a range of them. Pairs are filtered as arrays, as a long
    run of N alone, which any primer matches, makes millions.
    """
    laid = Texts([to_bits(t) for t in texts], config.match.max_errors)
    fwd: dict[int, list[tuple[int, Match]]] = {}
    rev: dict[int, list[tuple[int, int, Match]]] = {}
    others = primers if others is None else others
    for j, p in enumerate(primers):
        for t, m in laid.find(to_bits(p.sequence), config.match) if p.sequence else ():
            fwd.setdefault(t, []).append((j, m))
    for j, p in enumerate(others):
        for t, m in laid.find(to_bits(rc_text(p.sequence)), config.match) if p.sequence else ():
            rev.setdefault(t, []).append((m.end, j, m))
    for t in sorted(fwd.keys() & rev.keys()):
        ahead, back = fwd[t], sorted(rev[t], key=lambda x: x[:2])
        i, start, end = (np.array(c, np.int64) for c in zip(*((i, m.start, m.end) for i, m in ahead)))
        stop, j, begin = (np.array(c, np.int64) for c in zip(*((e, j, m.start) for e, j, m in back)))
        lo = np.searchsorted(stop, np.maximum(start + 1, start + config.min_len))
        upto = np.cumsum(np.maximum(np.searchsorted(stop, start + config.max_len, side="right") - lo, 0))
        passes, done = _passes(texts[t], config), 0
        while done < len(ahead):
            before = int(upto[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(upto, before + PAIRED, side="right")))
            n = np.diff(upto[done:to], prepend=before)
            f = np.repeat(np.arange(done, to), n)
            r = np.repeat(lo[done:to] - np.cumsum(n) + n, n) + np.arange(len(f))
            good = passes(start[f], end[f], begin[r], stop[r]) & (self_match | (i[f] != j[r] + shift))
            for x, y in zip(f[good].tolist(), r[good].tolist()):
                (a, m), (_, b, w) = ahead[x], back[y]
                yield t, f"{primers[a].name}+{others[b].name}", a, b, "", m, w
            done = to


def _passes(text: str, config: PcrConfig) -> Callable:
    """Which products (arrays of the starts and ends of both matches) keep to the bounds of length and share of N."""
    ns = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode("latin-1", "replace"), np.uint8) == ord("N"))])

    def passes(start, end, begin, stop):
        a, b = (end, begin) if config.trim_primers else (start, stop)
        size = stop - start
        good = (size >= config.min_len) & (size <= config.max_len) & (a < b)
        return good & ((ns[b] - ns[np.minimum(a, b)]) / np.maximum(b - a, 1) <= config.max_n_fraction)

    return passes


def _tiled(recs: DataFrame, strands: tuple[str, ...], reach: int, circular: int = 0) -> DataFrame:
    """The records, longer ones than TILE_LETTERS in tiles: rec_id, header, source_file, len, strand, lo, hi, at, sequence, more.

    A tile is of what is searched: the record or, for strand -, its reverse complement, followed by its first `circular` letters.
    It has the match ends in (lo, hi], begins at `at`, HALO before lo, and goes on for `reach` beyond hi. sequence and `more` are
    the stretches of the record, as it stands, that it consists of. A record that is not cut has no strand.
    """
    n, tile = F.length("sequence").cast("bigint"), F.lit(TILE_LETTERS).cast("bigint")
    rows = recs.select(*RECORD, n.alias("len"), (n > tile).alias("_cut"), (n + F.least(n, F.lit(circular))).alias("_all"))
    rows = rows.withColumn("strand", F.explode(F.when(F.col("_cut"), F.array(*map(F.lit, strands))).otherwise(F.array(F.lit(None).cast("string")))))
    last = F.when(F.col("_cut"), F.ceil(F.col("_all") / tile) - 1).otherwise(F.lit(0).cast("bigint"))
    rows = rows.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("lo", F.col("lo") * tile)
    rows = rows.withColumn("hi", F.when(F.col("_cut"), F.col("lo") + tile).otherwise(F.col("_all")))
    rows = rows.withColumn("at", F.greatest(F.col("lo") - HALO, F.lit(0))).withColumn("_to", F.least(F.col("hi") + reach, F.col("_all")))

    def stretch(a, b):
        a, b = F.when(F.col("strand") == "-", F.col("len") - b).otherwise(a), F.when(F.col("strand") == "-", F.col("len") - a).otherwise(b)
        return F.substring("sequence", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    own = stretch(F.least("at", "len"), F.least("_to", "len"))
    more = stretch(F.greatest(F.col("at"), F.col("len")) - F.col("len"), F.greatest(F.col("_to"), F.col("len")) - F.col("len"))
    whole = F.col("strand").isNull()
    return rows.select("rec_id", "header", "source_file", "len", "strand", "lo", "hi", "at", F.when(whole, F.col("sequence")).otherwise(own).alias("sequence"), F.when(~whole, more).alias("more"))


def _pieces(batches: Iterator[pa.RecordBatch], strands: tuple[str, ...], extended: Callable[[list[str], str], list[str]]) -> Iterator[tuple[list[tuple], str, list[str]]]:
    """What is searched together: (rec_id, header, source_file, len, lo, hi, at) of each text, strand, texts."""
    for batch in slices(batches, "sequence"):
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        whole = [(*r[:4], 0, r[6], 0) for r in rows if r[4] is None]
        texts = [(r[8] or "").translate(UPPER) for r in rows if r[4] is None]
        for strand in strands if whole else ():
            yield whole, strand, extended(texts, strand)
        for r in rows:
            if r[4] is not None:
                parts = [(x or "").translate(UPPER) for x in r[8:10]]
                yield [(*r[:4], *r[5:8])], r[4], ["".join(parts if r[4] == "+" else map(rc_text, parts))]


def _worker(config: PcrConfig, hits: Callable[[list[str]], Found]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for of, strand, texts in _pieces(batches, _strands(config), lambda seqs, strand: _searched(seqs, config, strand)):
            last, passes = -1, None
            for t, name, i, j, _, f, r in hits(texts):
                if t != last:
                    last, passes = t, _passes(texts[t], config)
                rec, head, file, n, lo, hi, at = of[t]
                if (len(of) == 1 and not lo < f.end + at <= hi) or not passes(f.start, f.end, r.start, r.end):
                    continue
                a, b = (f.end, r.start) if config.trim_primers else (f.start, r.end)
                rows.append((rec, head, file, n, strand, i, j, name, texts[t][a:b], f, r, at))
                if len(rows) >= HELD:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
                rows = []

    return go


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """The rows column by column."""
    *plain, fwd, rev, at = zip(*rows)
    sides = []
    for side in (fwd, rev):
        parts = ([m.start + x for m, x in zip(side, at)], [m.end + x for m, x in zip(side, at)], [m.edit_distance for m in side], plain[4], [m.cigar for m in side], [m.identity for m in side])
        sides.append(pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, _MATCH)], fields=list(_MATCH)))
    return pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(plain, _RAW)), *sides], schema=_RAW)


#: Bytes of input, by the optimizer's estimate, for each core, below which records are spread over the cores before they are searched.
SMALL_INPUT = 64 << 20


def _spread(recs: DataFrame, spread: bool | None, *by: str) -> DataFrame:
    """The records in enough partitions for all cores. Searching costs far more than moving a small table's records; a large one has
    partitions enough and isn't moved. If it isn't said, what the optimizer estimates decides, so no job runs; streams stay as they are."""
    if recs.isStreaming or spread is False:
        return recs
    cores = recs.sparkSession.sparkContext.defaultParallelism
    size = int(recs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return recs.repartition(4 * cores, *by) if spread or size < SMALL_INPUT * cores else recs


def _products(recs: DataFrame, config: PcrConfig, hits: Callable[[list[str]], Found], spread: bool | None = None) -> DataFrame:
    tiles = _tiled(recs.where(F.length("sequence") > 0), _strands(config), config.max_len + HALO, max(config.max_len - 1, 0) if config.circular else 0)
    raw = _spread(tiles, spread, "rec_id", "strand", "lo").mapInArrow(_worker(config, hits), RAW_SQL)
    a, b = (F.col("fwd.end"), F.col("rev.start")) if config.trim_primers else (F.col("fwd.start"), F.col("rev.end"))
    a, b = original_pos(a, "len"), original_pos(b, "len")
    back = F.col("strand") == "-"
    zero = F.lit(0).cast("bigint")
    wrap = (F.col("rev.end") - 1 >= F.col("len")) if config.circular else F.lit(False)
    return raw.select(
        "rec_id", "primer_idx", "rev_idx", "reference_header", "source_file", "primer_name", "sequence",
        (F.col("rev.end") - F.col("fwd.start")).alias("full_length"), "fwd", "rev", "strand", wrap.alias("is_circular_wrap"),
        F.when(back, F.greatest(F.col("len") - b, zero)).otherwise(a).alias("original_start"),
        F.when(back, F.greatest(F.col("len") - a, zero)).otherwise(b).alias("original_end"),
    )


def pair_products(recs: DataFrame, primers: Sequence[PrimerPair], config: PcrConfig = PcrConfig(), spread: bool | None = None) -> DataFrame:
    """Products of primer pairs in records, one row each, not numbered yet.

    Columns: rec_id, primer_idx, rev_idx, reference_header, source_file, primer_name, sequence, full_length, fwd and rev
    (start, end, edit_distance, strand, cigar, identity in what was searched: extended if circular, of the reverse
    complement for strand -), strand, is_circular_wrap, original_start, original_end. Length and wrap go by the span
    with primers, N content by the sequence given. Null and empty sequences and primers without both arms have no
    products; repeated records have theirs each; other columns are ignored. Only a scan and projections, the primers
    travel with the tasks; records of too few files for all cores are spread first, long ones in tiles, so that one
    chromosome keeps all cores busy. Streams are not spread. In a record longer than TILE_LETTERS, a run of more than HALO
    equally good ends with edits is taken as if nothing better stood before it.
    """
    primers = list(primers)
    return _products(recs, config, lambda texts: _pair_hits(texts, primers, config), spread)


def pool_products(recs: DataFrame, primers: Sequence[Primer], config: PcrConfig = PcrConfig(), self_match: bool = False, spread: bool | None = None) -> DataFrame:
    """Products of any two primers of a pool, as pair_products; the two may overlap. Names are joined by +."""
    primers = list(primers)
    return _products(recs, config, lambda texts: _pool_hits(texts, primers, config, self_match), spread)


def pair_products_of(recs: DataFrame, primers: DataFrame, config: PcrConfig = PcrConfig(), spread: bool | None = None, most: int = PAIRS_A_RUN) -> DataFrame:
    """pair_products of a table of primers (primer_idx, name, forward, reverse) of any size: a search for each `most` of them."""
    found, first = [], 0
    for run in pairs_in_runs(primers, most):
        found.append(_numbered_from(pair_products(recs, run, config, spread), first, first))
        first += len(run)
    return reduce(DataFrame.unionByName, found) if found else pair_products(recs, [], config, spread)


def pool_products_of(recs: DataFrame, primers: DataFrame, config: PcrConfig = PcrConfig(), self_match: bool = False, spread: bool | None = None, most: int = POOL_A_RUN) -> DataFrame:
    """pool_products of a table of primers (primer_idx, name, sequence) of any size: a search for each two groups of `most` of them."""
    runs = list(pool_in_runs(primers, most))
    found = []
    for a, ahead in enumerate(runs):
        for b, back in enumerate(runs):
            hits = partial(_pool_hits, primers=ahead, config=config, self_match=self_match, others=back, shift=(b - a) * most)
            found.append(_numbered_from(_products(recs, config, hits, spread), a * most, b * most))
    return reduce(DataFrame.unionByName, found) if found else pool_products(recs, [], config, self_match, spread)


def _numbered_from(products: DataFrame, first: int, other: int) -> DataFrame:
    return products.withColumns({"primer_idx": F.col("primer_idx") + first, "rev_idx": F.col("rev_idx") + other})


def matches(recs: DataFrame, primers: Sequence[Primer], config: MatchConfig = MatchConfig()) -> DataFrame:
    """Matches of each primer in each record: rec_id, primer_idx, primer_name, start, end, edit_distance, strand, cigar, identity.

    With search_rc also those of the primers' reverse complements, as strand -. Positions are those of the record.
    """
    primers = list(primers)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, _, texts in _pieces(batches, ("+",), lambda seqs, strand: seqs):
            laid = Texts([to_bits(t) for t in texts], config.max_errors)
            rows = []
            for i, p in enumerate(primers):
                for strand, text in (("+", p.sequence), ("-", rc_text(p.sequence)))[: 1 + config.search_rc]:
                    for t, m in laid.find(to_bits(text), config):
                        rec, _, _, _, lo, hi, at = of[t]
                        if len(of) > 1 or lo < m.end + at <= hi:
                            rows.append((rec, i, p.name, m.start + at, m.end + at, m.edit_distance, strand, m.cigar, m.identity))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64())
            names = ["rec_id", "primer_idx", "primer_name", "start", "end", "edit_distance", "strand", "cigar", "identity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    tiles = _tiled(recs.where(F.length("sequence") > 0), ("+",), HALO)
    return _spread(tiles, None, "rec_id", "strand", "lo").mapInArrow(go, "rec_id bigint, primer_idx bigint, primer_name string, start bigint, end bigint, edit_distance int, strand string, cigar string, identity double")
