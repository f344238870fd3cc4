"""FASTA and TSV output, as single ordered files or as a folder written in parallel."""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amplispark.errors import OutputDirMissing, OutputNotWritable
from amplispark.functions.dna import amplicon_id, identity_text, wrapped

# The columns of the TSV, in order.
TSV_COLUMNS = (
    "amplicon_id", "reference_id", "source_file", "primer_name", "product_len", "full_len",
    "fwd_start", "fwd_end", "fwd_mismatches", "fwd_identity", "fwd_cigar",
    "rev_start", "rev_end", "rev_mismatches", "rev_identity", "rev_cigar",
    "strand", "is_circular_wrap", "product_seq",
)
BGZF_BLOCK = 65_280
# Fixed value: how each block of a BGZF file begins, up to its size.
BGZF_HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
# Fixed value: the empty block that ends a BGZF file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _id() -> Column:
    return amplicon_id("reference_header", "primer_name", "strand", "is_circular_wrap", "case_number")


def fasta_text(products: DataFrame) -> DataFrame:
    """`value`: each product's FASTA record, without the last line end."""
    head = F.concat(F.lit(">"), _id(), F.lit("\tpos="), F.col("original_start"), F.lit("-"), F.col("original_end"), F.lit("\tstrand="), F.col("strand"), F.lit("\tlen="), F.col("full_length"))
    return products.select(F.concat(head, F.lit("\n"), wrapped("sequence")).alias("value"))


def tsv_columns(products: DataFrame) -> DataFrame:
    """The 19 columns as strings; nothing is quoted."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = [_id(), text("reference_header"), text("source_file"), text("primer_name"), F.length("sequence").cast("string"), text("full_length")]
    for s in ("fwd", "rev"):
        values += [text(f"{s}.start"), text(f"{s}.end"), text(f"{s}.edit_distance"), F.coalesce(identity_text(f"{s}.identity"), F.lit("")), text(f"{s}.cigar")]
    values += [text("strand"), text("is_circular_wrap"), text("sequence")]
    return products.select(*[v.alias(n) for n, v in zip(TSV_COLUMNS, values)])


def tsv_text(products: DataFrame) -> DataFrame:
    """`value`: each product's row of the TSV."""
    return tsv_columns(products).select(F.concat_ws("\t", *TSV_COLUMNS).alias("value"))


def check_writable(path: str) -> None:
    """Raises if the file's folder is missing or the file can't be written. An existing file is left as it is."""
    folder = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(folder):
        raise OutputDirMissing(folder)
    there = os.path.exists(path)
    try:
        open(path, "ab").close()
    except OSError as e:
        raise OutputNotWritable(f"{path}: {e}") from e
    if not there:
        os.remove(path)


def _bgzf(block: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    head = BGZF_HEAD + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(block), len(block))


class _Sink:
    """A file that is made when the first line comes; BGZF if its name ends in .gz.

    It is written under another name and renamed when complete. Without a line there is no file, and one of an older run goes.
    """

    def __init__(self, path: str):
        self.path, self.file, self.held = path, None, b""
        self.temp = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}-{uuid.uuid4().hex}")

    def line(self, text: str) -> None:
        if self.file is None:
            self.file = open(self.temp, "wb")
        self.held += text.encode() + b"\n"
        zipped = self.path.lower().endswith(".gz")
        while len(self.held) >= BGZF_BLOCK:
            block, self.held = self.held[:BGZF_BLOCK], self.held[BGZF_BLOCK:]
            self.file.write(_bgzf(block) if zipped else block)

    def close(self) -> bool:
        if self.file is None:
            if os.path.exists(self.path):
                os.remove(self.path)
            return False
        zipped = self.path.lower().endswith(".gz")
        if self.held:
            self.file.write(_bgzf(self.held) if zipped else self.held)
        if zipped:
            self.file.write(BGZF_END)
        self.file.close()
        os.replace(self.temp, self.path)
        return True

    def drop(self) -> None:
        if self.file is not None:
            self.file.close()
            os.remove(self.temp)


def _write(rows: Iterable, path: str | None, head: str | None, out: TextIO | None = None) -> bool:
    if path is None:
        for r in rows:
            print(r["value"], file=out or sys.stdout)
        return True
    sink = _Sink(path)
    try:
        for r in rows:
            if head:
                sink.line(head)
                head = None
            sink.line(r["value"])
    except BaseException:
        sink.drop()
        raise
    return sink.close()


def write_fasta(products: DataFrame, path: str | None, order: tuple[str, ...], out: TextIO | None = None) -> bool:
    """One file in the run's order, streamed through the driver partition by partition; stdout if path is None. No product, no file."""
    return _write(fasta_text(products.orderBy(*order)).toLocalIterator(), path, None, out)


def write_tsv(products: DataFrame, path: str, order: tuple[str, ...]) -> bool:
    return _write(tsv_text(products.orderBy(*order)).toLocalIterator(), path, "\t".join(TSV_COLUMNS))


def write_folder(products: DataFrame, path: str, kind: str = "fasta", compression: str = "none") -> None:
    """A folder of text files, written by the executors: for results too large for one file."""
    (fasta_text if kind == "fasta" else tsv_text)(products).write.option("compression", compression).text(path)
