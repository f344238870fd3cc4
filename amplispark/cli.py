"""Command line of a run."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from amplispark.config import MatchConfig, PcrConfig
from amplispark.job import PcrJob
from amplispark.sources.files import DEFAULT_LIMIT


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("amplispark", description="In-silico PCR on Spark.")
    p.add_argument("-i", "--input", action="append", required=True, help="files or patterns, commas between")
    p.add_argument("-p", "--primers", required=True, help="CSV file, or name:forward:reverse;... (with --pool name:sequence;...)")
    p.add_argument("--circular", action="store_true")
    p.add_argument("--max-decompression-size", type=int, default=DEFAULT_LIMIT, help="bytes, 0 for no limit")
    p.add_argument("-k", "--max-errors", type=int, default=2, help="edits allowed in a primer's match")
    p.add_argument("--min-identity", type=float, default=0.0)
    p.add_argument("--search-rc", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=0, help="local cores, 0 for all; of no account on a cluster")
    p.add_argument("--pool", action="store_true")
    p.add_argument("--pool-self-match", action="store_true")
    p.add_argument("--min-len", type=int, default=50)
    p.add_argument("--max-len", type=int, default=5000)
    p.add_argument("--trim-primers", action="store_true")
    p.add_argument("--max-n-fraction", type=float, default=0.1)
    p.add_argument("-o", "--output", help="FASTA file, BGZF if it ends in .gz; standard output if absent")
    p.add_argument("--tsv")
    p.add_argument("--folders", action="store_true", help="outputs are folders written by the executors, in no order")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--remove-duplicates", action="store_true")
    return p


#: The level of -vvv, below DEBUG.
TRACE = 5


def effective_threads(wanted: int) -> int:
    return wanted if wanted > 0 else os.cpu_count() or 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.addLevelName(TRACE, "TRACE")
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG, TRACE][min(args.verbose, 3)])
    if args.min_identity > 0:
        print(f"only matches with an identity of at least {args.min_identity} count", file=sys.stderr)
    try:
        match = MatchConfig(args.max_errors, args.min_identity, args.search_rc)
        config = PcrConfig(match, args.min_len, args.max_len, args.circular, args.trim_primers, args.max_n_fraction)
        spark = spark or SparkSession.builder.master(f"local[{effective_threads(args.threads)}]").config("spark.ui.showConsoleProgress", str(not (args.quiet or args.verbose)).lower()).getOrCreate()
        job = PcrJob(spark, args.input, args.primers, config, args.pool, args.pool_self_match, args.remove_duplicates, args.max_decompression_size)
        summary = job.run(args.output, args.tsv, args.output is None, args.folders)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print("\n".join(summary.lines()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
