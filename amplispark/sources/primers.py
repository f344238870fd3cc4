"""Primer pairs and pools from text, files or rows. Small by nature, so read on the driver."""

from __future__ import annotations

import csv
import logging
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from amplispark.errors import CsvFormat
from amplispark.functions.dna import AZ, LOWER_AZ

LOG = logging.getLogger("amplispark")
NOT_IUPAC = re.compile("[^ACGTRYSWKMBDHVN]")
SHORTEST, LONGEST = 10, 50
UPPER = str.maketrans(LOWER_AZ, AZ)


@dataclass(frozen=True)
class PrimerPair:
    name: str
    forward: str
    reverse: str


@dataclass(frozen=True)
class Primer:
    name: str
    sequence: str


def validate_iupac_sequence(seq: str, name: str, arm: str) -> str:
    """The sequence in upper case; an error that names the first letter that is no IUPAC code, and its place."""
    seq = seq.translate(UPPER)
    if m := NOT_IUPAC.search(seq):
        raise CsvFormat(f"primer '{name}', {arm}: invalid letter '{m[0]}' at position {m.start() + 1}")
    return seq


def warn_length(name: str, arm: str, seq: str) -> bool:
    """Logs a warning if a primer is unusually short or long."""
    if SHORTEST <= len(seq) <= LONGEST:
        return False
    LOG.warning("primer '%s', %s: %d letters, usual are %d to %d", name, arm, len(seq), SHORTEST, LONGEST)
    return True


def _make(fields: list[str], where: str, arms: tuple[str, ...]) -> list[str]:
    fields = [f.strip() for f in fields]
    if not all(fields):
        raise CsvFormat(f"{where}: empty field")
    out = fields[:1]
    for arm, seq in zip(arms, fields[1:]):
        out.append(validate_iupac_sequence(seq, fields[0], arm))
        warn_length(fields[0], arm, seq)
    return out


def _from_csv(path: str, columns: int, arms: tuple[str, ...]) -> list[list[str]]:
    with open(path, newline="", encoding="utf-8") as f:
        rows = csv.reader(f)
        head = next(rows, None)
        if head is None or len(head) < columns:
            raise CsvFormat(f"{path}: at least {columns} columns are needed in the header row")
        out = []
        for i, row in enumerate(rows, 2):
            if not row:
                continue
            if len(row) < columns:
                raise CsvFormat(f"{path}, row {i}: at least {columns} columns are needed")
            out.append(_make(row[:columns], f"{path}, row {i}", arms))
    if not out:
        raise CsvFormat(f"{path}: no primers")
    return out


def _from_text(text: str, columns: int, arms: tuple[str, ...]) -> list[list[str]]:
    out = []
    for spec in filter(str.strip, text.split(";")):
        fields = spec.split(":")
        if len(fields) != columns:
            raise CsvFormat(f"'{spec.strip()}': {columns} parts with ':' between are needed")
        out.append(_make(fields, f"'{spec.strip()}'", arms))
    if not out:
        raise CsvFormat("no primers")
    return out


def parse_primers(source: str) -> list[PrimerPair]:
    """Pairs from a CSV file of that name, else from name:forward:reverse;..."""
    arms = ("forward", "reverse")
    return [PrimerPair(*f) for f in (_from_csv if os.path.isfile(source) else _from_text)(source, 3, arms)]


def parse_pool_primers(source: str) -> list[Primer]:
    """Pool primers from a CSV file of that name, else from name:sequence;..."""
    return [Primer(*f) for f in (_from_csv if os.path.isfile(source) else _from_text)(source, 2, ("sequence",))]


def _clean(seq: str | None) -> str:
    """Trimmed and in upper case; empty, which matches nothing, if it is null or has other letters than IUPAC codes."""
    seq = (seq or "").strip().translate(UPPER)
    return "" if NOT_IUPAC.search(seq) else seq


#: Pairs, and primers of a pool, that travel together with the tasks of one search.
PAIRS_A_RUN, POOL_A_RUN = 100_000, 10_000


def _runs(df: DataFrame, columns: tuple[str, ...], most: int) -> Iterator[list]:
    """The rows in order of primer_idx and name, at most so many at a time."""
    held: list = []
    for r in df.select(*columns).orderBy("primer_idx", "name").toLocalIterator():
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def pairs_in_runs(df: DataFrame, most: int = PAIRS_A_RUN) -> Iterator[list[PrimerPair]]:
    """Pairs of a table primer_idx, name, forward, reverse, in order of primer_idx. An unusable arm is empty and matches nothing."""
    for rows in _runs(df, ("primer_idx", "name", "forward", "reverse"), most):
        yield [PrimerPair(r["name"], _clean(r["forward"]), _clean(r["reverse"])) for r in rows]


def pool_in_runs(df: DataFrame, most: int = POOL_A_RUN) -> Iterator[list[Primer]]:
    """Pool primers of a table primer_idx, name, sequence, as pairs_in_runs."""
    for rows in _runs(df, ("primer_idx", "name", "sequence"), most):
        yield [Primer(r["name"], _clean(r["sequence"])) for r in rows]


def pairs_of(df: DataFrame) -> list[PrimerPair]:
    """All pairs of a table as one list, for a table of no more than a run; pair_products_of takes any."""
    return _single(pairs_in_runs(df))


def pool_of(df: DataFrame) -> list[Primer]:
    """All primers of a pool as one list; pool_products_of takes a table of any size."""
    return _single(pool_in_runs(df))


def _single(runs: Iterator[list]) -> list:
    first = next(runs, [])
    if next(runs, None):
        raise ValueError("too many primers for one list: give the table to pair_products_of or pool_products_of")
    return first


def primers_frame(spark: SparkSession, primers: list[PrimerPair]) -> DataFrame:
    rows = [(i, p.name, p.forward, p.reverse) for i, p in enumerate(primers)]
    return spark.createDataFrame(rows, "primer_idx bigint, name string, forward string, reverse string")
