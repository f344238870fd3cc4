"""A whole run: files and primers in, products, FASTA, TSV and summary out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from amplispark.config import PcrConfig
from amplispark.operators.finalize import RunSummary, finalize, summarize
from amplispark.operators.products import SMALL_INPUT, pair_products, pool_products
from amplispark.runtime import checkpointed
from amplispark.shipping import ship
from amplispark.sources.files import DEFAULT_LIMIT, expand_inputs, size_of
from amplispark.sources.primers import parse_pool_primers, parse_primers
from amplispark.sources.seqfile import read_records
from amplispark.sources.writers import check_writable, write_fasta, write_folder, write_tsv


@dataclass
class PcrJob:
    """Lazy until `run`; `products` is the plan."""

    spark: SparkSession
    inputs: str | list[str]
    primers: str
    config: PcrConfig = field(default_factory=PcrConfig)
    pool: bool = False
    pool_self_match: bool = False
    remove_duplicates: bool = False
    max_decompressed_bytes: int = DEFAULT_LIMIT

    def records(self) -> DataFrame:
        return read_records(self.spark, self.inputs, self.max_decompressed_bytes)

    def products(self, recs: DataFrame | None = None) -> DataFrame:
        recs = self.records() if recs is None else recs
        small = sum(map(size_of, expand_inputs(self.inputs))) < SMALL_INPUT * self.spark.sparkContext.defaultParallelism
        if self.pool:
            found = pool_products(recs, parse_pool_primers(self.primers), self.config, self.pool_self_match, spread=small)
        else:
            found = pair_products(recs, parse_primers(self.primers), self.config, spread=small)
        return finalize(found, self.remove_duplicates, self.pool)

    def run(self, fasta: str | None = None, tsv: str | None = None, stdout: bool = True, folders: bool = False) -> RunSummary:
        """Writes the outputs and gives the summary. Output paths are tried before anything is read.

        With `folders` the outputs are folders of files that the executors write, unordered: for results too large for one file.
        """
        for path in filter(None, () if folders else (fasta, tsv)):
            check_writable(path)
        n_primers = len((parse_pool_primers if self.pool else parse_primers)(self.primers))
        ship(self.spark)
        seen = Observation()
        products = checkpointed(self.products(self.records().observe(seen, F.count(F.lit(1)).alias("n"))))  # found once, then written, counted and listed
        order = ("rec_id", F.col("strand").asc(), "case_number") if self.pool else ("rec_id", "case_number")
        if folders:
            for path, kind in ((fasta, "fasta"), (tsv, "tsv")):
                if path:
                    write_folder(products, path, kind, "gzip" if path.lower().endswith(".gz") else "none")
        elif fasta or stdout:
            write_fasta(products, fasta, order)
        if tsv and not folders:
            write_tsv(products, tsv, order)
        summary = summarize(products, seen.get["n"], n_primers)
        summary.log()
        return summary
