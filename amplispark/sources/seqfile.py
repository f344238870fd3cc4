"""FASTA and GenBank files, plain or gzipped, as a data source: spark.read.format("seqfile")."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from amplispark.sources.files import DEFAULT_LIMIT, chunks, detect_format, expand_inputs, is_gzipped, lines, size_of
from amplispark.sources.formats import LONGEST_LINE, fasta, genbank_records

SCHEMA = "rec_id bigint, source_file string, header string, sequence string"
#: Bytes of small files that share a task, and of the pieces that a large plain FASTA file is read in.
TASK_BYTES = 64 << 20
#: The least bytes of a piece, where the files are too small to give each core four of TASK_BYTES.
LEAST_BYTES = 1 << 20
#: Bytes of sequences, and records, that are handed to Spark in one batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 10_000
TASK_FILES = 1_000
#: rec_id is file number * FILE_STEP + where the record begins in the file, so it gives files' and records' order.
FILE_STEP = 1 << 42


@dataclass
class Piece(InputPartition):
    """Files with their numbers and the byte range of each."""

    files: list


def _ranged(path: str, start: int, end: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """Lines of a plain FASTA file, with their places, of the records that begin in [start, end)."""
    at = start
    if start:  # the line that began before belongs to the piece before
        at -= 1
    feed = lines_with_ends(chunks(path, limit, at))
    if start:
        at += len(next(feed, b""))
    live = start == 0
    for raw in feed:
        if raw.startswith(b">"):
            if at >= end:
                return
            live = True
        if live:
            yield at, raw.rstrip(b"\r\n")
        at += len(raw)


def lines_with_ends(parts: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        for line in whole:
            yield line + b"\n"
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["rec_id", "source_file", "header", "sequence"])


class SeqFileReader(DataSourceReader):
    def __init__(self, options: dict):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths = expand_inputs(paths)
        self.limit = int(options.get("maxdecompressedbytes", DEFAULT_LIMIT))
        self.full = str(options.get("fullheader", "false")).lower() == "true"
        self.piece = int(options.get("taskbytes", 0))
        self.cores = int(options.get("cores", 1))

    def partitions(self) -> list[Piece]:
        out, held, size = [], [], 0
        sizes = [size_of(p) for p in self.paths]
        piece = self.piece or min(TASK_BYTES, max(LEAST_BYTES, sum(sizes) // (4 * self.cores)))
        for i, (p, n) in enumerate(zip(self.paths, sizes)):
            if n > piece and not is_gzipped(p) and detect_format(p) == "fasta":
                out += [Piece([(i, p, a, min(a + piece, n))]) for a in range(0, n, piece)]
                continue
            if held and (size + n > piece or len(held) >= TASK_FILES):
                out.append(Piece(held))
                held, size = [], 0
            held.append((i, p, 0, -1))
            size += n
        return out + [Piece(held)] * bool(held)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._records(partition):
            rows.append(row)
            size += len(row[3])
            if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, partition: Piece) -> Iterator[tuple]:
        for i, path, start, end in partition.files:
            if end < 0:
                feed = lines(chunks(path, self.limit), LONGEST_LINE if detect_format(path) == "genbank" else None, path)
                records = fasta(feed, self.full) if detect_format(path) == "fasta" else genbank_records(feed, path)
                for n, (head, seq) in enumerate(records):
                    yield i * FILE_STEP + n, path, head, seq
                continue
            places: list[int] = []

            def noted() -> Iterator[bytes]:
                for at, line in _ranged(path, start, end, self.limit):
                    if line.startswith(b">"):
                        places.append(at)
                    yield line

            for n, (head, seq) in enumerate(fasta(noted(), self.full)):
                yield i * FILE_STEP + places[n], path, head, seq


class SeqFile(DataSource):
    """Options: path or paths (a JSON list; patterns allowed), maxDecompressedBytes (0: no limit), fullHeader, cores (to cut the files for), taskBytes (instead)."""

    @classmethod
    def name(cls) -> str:
        return "seqfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeqFileReader:
        return SeqFileReader(dict(self.options))


def read_records(spark: SparkSession, inputs: str | list[str], max_decompressed_bytes: int = DEFAULT_LIMIT, full_header: bool = False, task_bytes: int = 0) -> DataFrame:
    """The records of the files: rec_id, source_file, header, sequence. Large plain FASTA files are read in pieces, small files together.

    Pieces have task_bytes; if that is 0, TASK_BYTES, or less where that would leave cores idle.
    """
    spark.dataSource.register(SeqFile)
    wanted = [inputs] if isinstance(inputs, str) else list(inputs)
    reader = spark.read.format("seqfile").option("paths", json.dumps(wanted))
    return reader.option("maxDecompressedBytes", str(max_decompressed_bytes)).option("fullHeader", str(full_header).lower()).option("taskBytes", str(task_bytes)).option("cores", str(spark.sparkContext.defaultParallelism)).load()
