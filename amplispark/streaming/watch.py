"""Products of FASTA files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from amplispark.config import PcrConfig
from amplispark.functions.dna import FASTA_EXTENSIONS, ascii_upper
from amplispark.operators.products import pair_products
from amplispark.sources.primers import PrimerPair

#: The plain FASTA files of a folder, in either case.
PLAIN_FASTA = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in FASTA_EXTENSIONS) + "}"


def arriving_records(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of records of the plain FASTA files in a folder: rec_id, source_file, header, sequence.

    Spark's text source divides files at line starts with >, so no Python is needed. rec_id is a hash of file and
    record, as a stream has no order of files. What stands before a file's first > is dropped.
    """
    text = spark.readStream.format("text").option("lineSep", "\n>").option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", PLAIN_FASTA).load(folder)
    parts = text.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"), F.col("_metadata.file_block_start").alias("at"))
    clean = F.regexp_replace("raw", "\r", "")
    body = F.regexp_replace(clean, "^>", "")
    head = F.regexp_extract(body, r"^[^\S\n]*(\S*)", 1)
    seq = ascii_upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", ""))
    return parts.where(F.trim("raw") != "").select(F.xxhash64("source_file", "raw").alias("rec_id"), "source_file", head.alias("header"), seq.alias("sequence"))


def watch(spark: SparkSession, folder: str, primers: Sequence[PrimerPair], out: str, checkpoint: str, config: PcrConfig = PcrConfig(), once: bool = True) -> StreamingQuery:
    """Writes the products (not numbered) of arriving files to parquet under `out`, each file once. With `once` it ends with what is there."""
    found = pair_products(arriving_records(spark, folder), primers, config)
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
