"""FASTA and GenBank records out of lines."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from amplispark.functions.dna import AZ, LOWER_AZ

LOG = logging.getLogger("amplispark")
UPPER = str.maketrans(LOWER_AZ, AZ)
NOT_LETTERS = bytes(c for c in range(256) if not (chr(c).isascii() and chr(c).isalpha()))
LONGEST_LINE = 100_000
# Fixed value: the column from which on the values of a GenBank record's parts stand.
COLUMN = 12
#: The one parser there is, for FASTA as for GenBank.
PARSER = "lines"


def parser_name() -> str:
    return PARSER


@dataclass
class GenbankRecord:
    name: str | None = None
    accession: str | None = None
    definition: str | None = None
    is_circular: bool = False
    seq: str = ""
    complete: bool = True

    def header(self, n: int) -> str:
        """The first of name, accession and definition that isn't empty, else unknown_n."""
        return self.name or self.accession or self.definition or f"unknown_{n}"


def fasta(lines: Iterable[bytes], full_header: bool = False) -> Iterator[tuple[str, str]]:
    """(header, sequence in upper case) of each record; records without letters too. Lines before the first > are no record."""
    head: str | None = None
    parts: list[str] = []
    for raw in lines:
        line = raw.decode("latin-1")
        if line.startswith(">"):
            if head is not None:
                yield head, "".join(parts).translate(UPPER)
            head = line[1:] if full_header else (line[1:].split() or [""])[0]
            parts = []
        elif head is not None:
            parts.append("".join(line.split()))
    if head is not None:
        yield head, "".join(parts).translate(UPPER)


def genbank(lines: Iterable[bytes], path: str = "") -> Iterator[GenbankRecord]:
    """Records from LOCUS to //. One without // ends at the next LOCUS or the file's end, there with a warning.

    Name, accession and definition stand before FEATURES and ORIGIN. The sequence is the letters after the first
    ORIGIN, in their case. A definition goes on in the indented lines below it, whatever their first word. What stands
    before the first LOCUS is skipped.
    """
    now: GenbankRecord | None = None
    part, seq = "", []

    def done(complete: bool) -> GenbankRecord:
        now.seq, now.complete = "".join(seq), complete
        return now

    for raw in lines:
        line = raw.decode("latin-1")
        if line.startswith("LOCUS"):
            if now:
                yield done(True)
            value = line[COLUMN:]
            now, part, seq = GenbankRecord(re.split("[ \t]", value, maxsplit=1)[0] or None, is_circular="circular" in line.lower()), "LOCUS", []
        elif now is None:
            continue
        elif line.strip() == "//":
            yield done(True)
            now = None
        elif part == "ORIGIN":
            seq.append(raw.translate(None, NOT_LETTERS).decode("ascii"))
        elif line.startswith("ORIGIN"):
            part = "ORIGIN"
        elif part == "FEATURES":
            continue
        elif line.startswith("DEFINITION"):
            part, now.definition = "DEFINITION", line[COLUMN:].strip() or None
        elif part == "DEFINITION" and line[:1].isspace() and line.strip():
            now.definition = " ".join(filter(None, (now.definition, line.strip())))
        elif line.startswith("ACCESSION"):
            part, now.accession = "ACCESSION", (line[COLUMN:].split() or [None])[0]
        elif not line[:1].isspace():
            part = "FEATURES" if line.startswith("FEATURES") else "OTHER"
    if now:
        LOG.warning("%s: the last record has no //", path)
        yield done(False)


def genbank_records(lines: Iterable[bytes], path: str = "") -> Iterator[tuple[str, str]]:
    """(header, sequence in upper case) of each record with letters; others are skipped with a warning."""
    for n, r in enumerate(genbank(lines, path), 1):
        if r.is_circular:
            LOG.info("%s: record %d is circular", path, n)
        if not r.seq:
            LOG.warning("%s: record %d has no sequence", path, n)
            continue
        yield r.header(n), r.seq.translate(UPPER)
