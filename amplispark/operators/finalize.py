"""From found products to the numbered result: order, duplicates, case numbers, counts."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from amplispark.functions.dna import canonical
from amplispark.runtime import checkpointed

LOG = logging.getLogger("amplispark")
#: Primer names that a summary lists; in pool mode there may be as many as there are pairs of primers.
LISTED_PRIMERS = 10_000

#: The order of a run's products: in pool mode all of strand + come before all of -, in pair mode primer by primer.
PAIR_ORDER = ("rec_id", "primer_idx", "strand_no", "fwd_end", "fwd_start", "rev_idx", "rev_end", "rev_start")
POOL_ORDER = ("rec_id", "strand_no", "primer_idx", "fwd_end", "fwd_start", "rev_idx", "rev_end", "rev_start")
#: Leading columns of the order within which products are numbered before the numbers are added up.
STEPS = 3


def _ordered(products: DataFrame, pool: bool) -> tuple[DataFrame, list[str]]:
    df = products.withColumns({"strand_no": F.when(F.col("strand") == "+", 0).otherwise(1), "fwd_start": F.col("fwd.start"), "fwd_end": F.col("fwd.end"), "rev_start": F.col("rev.start"), "rev_end": F.col("rev.end")})
    return df, list(POOL_ORDER if pool else PAIR_ORDER)


def dedup(products: DataFrame, pool: bool = False) -> DataFrame:
    """Of the products of one reference with equal canonical sequence the first. A null header is one reference.

    An aggregate with partial results per task, so that a hot reference or sequence isn't gathered.
    """
    columns = products.columns
    df, order = _ordered(products, pool)
    first = F.min(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])).alias("_first")
    kept = df.groupBy("reference_header", canonical("sequence").alias("_canonical")).agg(first)
    return kept.select(*[F.col(f"_first._{c}").alias(c) for c in columns])


def number(products: DataFrame, pool: bool = False) -> DataFrame:
    """case_number: 1, 2, ... in each reference, in the run's order.

    Products are numbered within record, primer and strand; the numbers before come from a window over counts, of
    which there is one for each such group. So a reference with most of the products is no single task.
    """
    df, order = _ordered(products, pool)
    steps = order[:STEPS]
    own = F.row_number().over(Window.partitionBy("reference_header", *steps).orderBy(*order[STEPS:]))
    counts = df.groupBy("reference_header", *steps).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("reference_header").orderBy(*steps).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("reference_header").alias("_h"), *[F.col(s).alias(f"_{s}") for s in steps], F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("reference_header").eqNullSafe(F.col("_h"))
    for s in steps:
        same &= F.col(s) == F.col(f"_{s}")
    out = df.withColumn("_own", own).join(counts, same)
    return out.select(*products.columns, (F.col("_own") + F.col("_before")).cast("bigint").alias("case_number"))


def number_per_call(products: DataFrame, pool: bool = False) -> DataFrame:
    """case_number as a single call gives it: 1, 2, ... in each record and primer pair, or record in pool mode."""
    df, order = _ordered(products, pool)
    scope = ["rec_id"] if pool else ["rec_id", "primer_idx"]
    return df.withColumn("case_number", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).cast("bigint")).select(*products.columns, "case_number")


def finalize(products: DataFrame, remove_duplicates: bool = False, pool: bool = False) -> DataFrame:
    """Numbered products, without duplicates if so wished. They are kept in the shared folder first, so that the search runs once though
    numbers need counts before."""
    found = checkpointed(products)
    return number(dedup(found, pool) if remove_duplicates else found, pool)


def flattened(products: DataFrame) -> DataFrame:
    """The two matches as plain columns, named as in the products table."""
    sides = [F.col(f"{s}.{a}").alias(f"{s}_{b}") for s in ("fwd", "rev") for a, b in (("start", "start"), ("end", "end"), ("edit_distance", "mismatches"), ("identity", "identity"), ("cigar", "cigar"))]
    return products.select(*[c for c in products.columns if c not in ("fwd", "rev")], *sides)


def count_by(products: DataFrame, column: str) -> DataFrame:
    """Products per primer_name or reference_header, most first, equal counts by name."""
    return products.groupBy(column).agg(F.count(F.lit(1)).alias("n_products")).orderBy(F.desc("n_products"), F.asc(column))


@dataclass(frozen=True)
class RunSummary:
    """Totals of a run. The lists hold (name, count), most first; of primers the first LISTED_PRIMERS of n_primers."""

    total_sequences: int
    total_primers: int
    total_products: int
    products_per_primer: list[tuple[str, int]]
    n_primers: int
    n_references: int
    products_per_reference: list[tuple[str, int]]

    def lines(self, listed: int = 10) -> list[str]:
        """The summary as text. References are listed if there are no more than `listed`."""
        out = ["PCR summary", f"  Sequences:    {self.total_sequences}", f"  Primer pairs: {self.total_primers}", f"  Products:     {self.total_products}"]
        if self.products_per_primer:
            out += ["  Products per primer:", *(f"    {n}: {c}" for n, c in self.products_per_primer)]
        if self.n_primers > len(self.products_per_primer):
            out.append(f"    and {self.n_primers - len(self.products_per_primer)} more")
        if 0 < self.n_references <= listed:
            out += ["  Products per reference:", *(f"    {n}: {c}" for n, c in self.products_per_reference)]
        elif self.n_references:
            out.append(f"  References with products: {self.n_references}")
        return out


    def log(self, listed: int = 10) -> None:
        """The same lines to the log, as information."""
        for line in self.lines(listed):
            LOG.info(line)


def summarize(products: DataFrame, total_sequences: int, total_primers: int, listed: int = 10) -> RunSummary:
    """Counts by primer, the first LISTED_PRIMERS, and, if few, by reference."""
    by_primer = count_by(products, "primer_name")
    per_primer = [(r[0], r[1]) for r in by_primer.limit(LISTED_PRIMERS).collect()]
    totals = by_primer.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_products"), F.lit(0))).first()
    per_reference = count_by(products, "reference_header")
    some = [(r[0], r[1]) for r in per_reference.limit(listed + 1).collect()]
    n = len(some) if len(some) <= listed else per_reference.count()
    return RunSummary(total_sequences, total_primers, totals[1], per_primer, totals[0], n, some[:listed])
