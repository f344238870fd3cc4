"""Check of running numbers per key when a few keys hold most rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Of the rows, one in SAMPLE_EVERY (by hash of the id) is looked at to find heavy keys.
SAMPLE_EVERY = 16
#: Rows that one task orders: a share for TASKS_A_CORE tasks a core, within these bounds.
TASKS_A_CORE, LEAST_ROWS, MOST_ROWS = 3, 1_000, 4_000_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def rows_a_task(n_rows: int, cores: int) -> int:
    return min(MOST_ROWS, max(LEAST_ROWS, n_rows // (TASKS_A_CORE * cores)))


def heavy_keys(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The heavy keys, those with more rows than one task is to order, with the splits of their time ranges: keys, _splits, _busy, _low, _step.

    There are at most rows / rows_a_task of them, with as many splits in all, so it may be broadcast: some 20 bytes for each
    MOST_ROWS rows of a large table, TASKS_A_CORE rows a core of a small one. _busy: split values that occur more
    than once; such a moment holds several ranges' worth of rows and is cut by `tie` in steps of _step from _low on.
    """
    sample = rows.where(F.pmod(F.xxhash64(tie), F.lit(SAMPLE_EVERY)) == 0)
    n_rows = SAMPLE_EVERY * sample.count()
    target = rows_a_task(n_rows, rows.sparkSession.sparkContext.defaultParallelism)
    ranges = max(2, -(-n_rows // target))
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    per_key = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(F.col("_t"), points, F.lit(max(2000, 50 * ranges))).alias("_every"), F.min(tie).alias("_low"), F.max(tie).alias("_high"))
    own = F.ceil(F.col("_n") * SAMPLE_EVERY / target)
    heavy = per_key.withColumn("_own", own).where((F.col("_own") > 1) & (F.col("_n") >= 8))
    step = F.greatest(F.lit(1), F.floor(ranges / F.col("_own")))  # of all the splits, as many as the key needs
    splits = F.filter(F.coalesce("_every", F.array().cast("array<bigint>")), lambda x, i: F.pmod(i + 1, step) == 0)
    heavy = heavy.withColumn("_splits", splits)
    return heavy.select(
        *keys,
        "_splits",
        F.array_distinct(F.filter("_splits", lambda x, i: (i > 0) & (x == F.element_at("_splits", F.when(i > 0, i).otherwise(1))))).alias("_busy"),
        "_low",
        F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("_high") - F.col("_low")) / F.col("_own"))).alias("_step"),
    )


def misnumbered(products: DataFrame, keys: tuple[str, ...] = ("reference_header", "primer_name"), order: str = "found_at", tie: str = "product_id", number: str = "case_number") -> DataFrame:
    """Ids of the rows whose number isn't greater than that of the row just before in their key's order.

    Rows with a null key belong to no key. A null time comes before all times; equal times go by id. A null number
    is neither too small nor a measure for the next row. Repeated rows (same id) are ordered by number. An empty
    table gives no rows. Other columns are ignored.

    Heavy keys, those of which a sample shows more rows than one task is to order, are cut into time ranges through a broadcast join; the ranges are numbered
    separately and the last row of each is handed to the next. All other keys go through an ordinary shuffle.
    """
    names = list(keys)
    known = reduce(and_, [F.col(k).isNotNull() for k in names])
    rows = products.where(known).select(*names, F.col(tie).alias("_id"), F.col(order).alias("_at"), F.col(number).alias("_no"))
    rows = rows.withColumn("_t", _micros(F.col("_at")))
    heavy = heavy_keys(rows, names, "_at", "_id")
    within = [F.col("_at").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("_no").asc_nulls_first()]

    light = rows.join(F.broadcast(heavy.select(*names)), names, "left_anti")
    light = light.withColumn("_before", F.lag("_no").over(Window.partitionBy(*names).orderBy(*within)))

    cut = rows.join(F.broadcast(heavy), names)
    busy = F.col("_t").isNull() | F.array_contains("_busy", F.coalesce("_t", F.lit(0)))
    cut = cut.select(
        *names, "_id", "_at", "_no",
        F.when(F.col("_t").isNull(), -1).otherwise(F.size(F.filter("_splits", lambda s: s < F.col("_t")))).alias("_r1"),
        F.when(busy, 1).otherwise(0).alias("_r2"),
        F.when(busy, F.floor((F.col("_id") - F.col("_low")) / F.col("_step"))).otherwise(0).alias("_r3"),
    )
    part = ["_r1", "_r2", "_r3"]
    tails = cut.groupBy(*names, *part).agg(F.max(F.struct(F.struct("_at", "_id", "_no"))).alias("_last"))
    tails = tails.select(*names, *part, F.lag("_last").over(Window.partitionBy(*names).orderBy(*part)).getItem("col1").getItem("_no").alias("_handed"))
    inner = Window.partitionBy(*names, *part).orderBy(*within)
    ranked = cut.select(*names, *part, "_id", "_no", F.lag("_no").over(inner).alias("_lag"), F.row_number().over(inner).alias("_rank"))
    first = ranked.where("_rank = 1").join(tails, [*names, *part]).select("_id", "_no", F.col("_handed").alias("_before"))
    rest = ranked.where("_rank > 1").select("_id", "_no", F.col("_lag").alias("_before"))

    every = light.select("_id", "_no", "_before").unionByName(rest).unionByName(first)
    return every.where(F.col("_no") <= F.col("_before")).select(F.col("_id").alias(tie))


def key_summary(products: DataFrame, keys: tuple[str, ...] = ("reference_header", "primer_name")) -> DataFrame:
    """Rows, first and last product, and longest product of each pair of keys; null keys form keys of their own.

    Partial aggregates are made before the shuffle, so a hot key sends one row per task.
    """
    return products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_products"),
        F.min("product_id").alias("first_product"),
        F.max("product_id").alias("last_product"),
        F.max("full_length").alias("longest"),
    )
