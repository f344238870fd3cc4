"""What every operator needs of the session: the shared folder, table access, batch slicing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent a machine-local folder is used, which is allowed for a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    if not (here := spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="amplispark-"))
        here = spark.sparkContext.getCheckpointDir()
    return here.rstrip("/")


def named_dir(spark: SparkSession, name: str) -> str:
    """The URI of a folder of that name under the shared folder."""
    base = shared_dir(spark)
    base = base if "://" in base else f"{base[:5]}//{base[5:]}" if base.startswith("file:") else f"file://{base}"
    return f"{base}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the shared folder so that the loss of an executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of at most `rows` rows and about `most` bytes of the string column.

    A single longer value makes a slice of its own.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = int(np.searchsorted(size, before + most, side="right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column's values one after another, and the n + 1 offsets; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    col = pa.concat_arrays([col]) if col.offset == 0 else pa.concat_arrays([col, pa.array([], pa.large_string())])
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
