"""Many tiny FASTA files into few well-sized ones, each current record exactly once."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.runtime import checkpointed, named_dir, slices

TARGET_BYTES = 8_000_000
#: What a file weighs beside its bytes, so that empty files are spread too.
FILE_WEIGHT = 64
#: Output groups that one heap fills at most. It bounds a scheduling task: about 32 x 8 MB of small files.
GROUPS_A_SHARD = 32
#: Output groups that a task writes one after another, where there are enough for all cores.
GROUPS_A_TASK = 32
RECORDS = pa.schema([("source_file", pa.string()), ("record_idx", pa.int64()), ("header", pa.string()), ("description", pa.string()), ("sequence", pa.string())])
MANIFEST = "grp bigint, path string, n_files bigint, n_records bigint, n_bytes bigint"


def fasta_records(content: str | None) -> Iterator[tuple[str, str, str]]:
    """(first word, whole header line, letters) of each record. Text before the first `>` line is no record."""
    if not content:
        return
    head: str | None = None
    letters: list[str] = []
    for line in content.removeprefix("﻿").split("\n"):
        line = line.removesuffix("\r")
        if line.startswith(">"):
            if head is not None:
                yield (head.split() or [""])[0], head, "".join(letters)
            head, letters = line[1:], []
        elif head is not None:
            letters.append(line.strip())
    if head is not None:
        yield (head.split() or [""])[0], head, "".join(letters)


def latest(deliveries: DataFrame) -> DataFrame:
    """source_file, content, n_bytes and n_heads of the last delivery of each source_file (landed_at, then file_id).

    n_heads is the number of lines that begin with >, counted here and so independent of what reads the records later.
    A null source_file counts as one file. The maximum is taken before the shuffle, so that of a file delivered
    very often each task sends one row.
    """
    heads = F.regexp_count("content", F.lit("(?md)^>")) + F.when(F.col("content").startswith("\ufeff>"), 1).otherwise(0)
    size = [F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("n_bytes"), F.coalesce(heads, F.lit(0)).cast("bigint").alias("n_heads")]
    rank = F.struct("landed_at", "file_id", *size, F.xxhash64("content").alias("tie"))
    last = deliveries.groupBy("source_file").agg(F.max_by("content", rank).alias("content"), F.max(rank).alias("last"))
    return last.select("source_file", "content", "last.n_bytes", "last.n_heads")


def _schedule(groups: int, shards: int):
    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        """Longest first, each file to the group with the least load."""
        s = int(shard["_shard"].iloc[0])
        heap = [(0, g) for g in range(s * groups // shards, (s + 1) * groups // shards)]
        heapq.heapify(heap)
        shard = shard.sort_values(["n_bytes", "source_file"], ascending=[False, True], kind="stable")
        to = []
        for size in shard["n_bytes"]:
            load, g = heap[0]
            heapq.heapreplace(heap, (load + int(size) + FILE_WEIGHT, g))
            to.append(g)
        return shard.assign(grp=to)[["source_file", "n_bytes", "n_heads", "grp"]]

    return fill


def schedule(sizes: DataFrame, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, int]:
    """grp for each source_file, and how many groups there are: total size / target.

    Files are spread over shards by hash and each shard fills its own groups, so no task or driver holds all sizes.
    """
    total = sizes.agg(F.coalesce(F.sum(F.col("n_bytes") + FILE_WEIGHT), F.lit(0))).first()[0]
    groups = max(1, -(-total // target_bytes))
    shards = -(-groups // GROUPS_A_SHARD)
    # a file goes to the shard of a group picked by hash, so that a shard's share of the files is its share of the groups
    picked = F.pmod(F.xxhash64("source_file"), F.lit(groups))
    shard = F.floor(((picked + 1) * shards - 1) / F.lit(groups)).cast("bigint")
    heads = F.col("n_heads") if "n_heads" in sizes.columns else F.lit(0).cast("bigint").alias("n_heads")
    plan = sizes.select("source_file", "n_bytes", heads, shard.alias("_shard")).groupBy("_shard").applyInPandas(_schedule(groups, shards), "source_file string, n_bytes bigint, n_heads bigint, grp bigint")
    return plan, groups


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now = sink = stream = None

        def close() -> pa.RecordBatch:
            sink.close()
            stream.close()
            final = f"{root}/part-{now['grp']:08d}-{now['key']}.parquet"
            store.move(now["temp"], final)  # readers never see a half-written file
            now["n_records"] = pq.ParquetFile(store.open_input_file(final)).metadata.num_rows  # what the file holds, not what was sent
            return pa.RecordBatch.from_pylist([{"grp": now["grp"], "path": final.rpartition("/")[2], "n_files": now["n_files"], "n_records": now["n_records"], "n_bytes": now["n_bytes"]}])

        pending: list[tuple] = []

        def flush() -> None:
            if pending:
                sink.write_table(pa.table([list(c) for c in zip(*pending)], schema=RECORDS))
                pending.clear()

        for batch in slices(batches, "content"):
            for g, name, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or now["grp"] != g:
                    if now is not None:
                        flush()
                        yield close()
                    key = uuid.uuid4().hex
                    now = {"grp": g, "key": key, "temp": f"{root}/.tmp-{key}", "n_files": 0, "n_bytes": 0}
                    stream = store.open_output_stream(now["temp"])
                    sink = pq.ParquetWriter(stream, RECORDS, compression="zstd")
                held = 0
                for i, (word, head, letters) in enumerate(fasta_records(content)):
                    pending.append((name, i, word, head, letters))
                    held += len(letters)
                    if len(pending) >= 20_000 or held > 4_000_000:
                        flush()
                        held = 0
                now["n_files"] += 1
                now["n_bytes"] += len((content or "").encode())
        if now is not None:
            flush()
            yield close()

    return write


def _current(out: str) -> dict | None:
    """What CURRENT says, None if nothing is published."""
    store, root = fs.FileSystem.from_uri(out)
    if store.get_file_info(f"{root}/CURRENT").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/CURRENT") as f:
        return json.loads(f.read())


def _write(current: DataFrame, plan: DataFrame, groups: int, folder: str) -> DataFrame:
    """Writes the groups and their manifest into a folder of the run's own."""
    spark = current.sparkSession
    placed = current.select("source_file", "content").join(plan, current["source_file"].eqNullSafe(plan["source_file"])).select("grp", plan["source_file"], "content")
    tasks = max(min(groups, 2 * spark.sparkContext.defaultParallelism), -(-groups // GROUPS_A_TASK))
    placed.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(_writer(folder), MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _verify(manifest: DataFrame, plan: DataFrame, sizes: DataFrame) -> None:
    """Raises unless each group holds the files, bytes and record heads that were counted before anything was written."""
    planned = plan.groupBy("grp").agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("bytes"), F.sum("n_heads").alias("heads"))
    same = F.lit(True)
    for a, b in (("files", "n_files"), ("bytes", "n_bytes"), ("heads", "n_records")):
        same &= F.col(a).eqNullSafe(F.col(b))
    if (n := planned.join(manifest, "grp", "full").where(~same).count()) or plan.count() != sizes.count():
        raise OSError(f"{n} groups were not written as planned")


def _publish(out: str, said: dict) -> None:
    """Makes a run the current one, by one rename."""
    store, root = fs.FileSystem.from_uri(out)
    with store.open_output_stream(f"{root}/.CURRENT-{said['run']}") as f:
        f.write(json.dumps(said).encode())
    store.move(f"{root}/.CURRENT-{said['run']}", f"{root}/CURRENT")


def consolidate(deliveries: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> dict:
    """Writes the records of the last delivery of each file under `out`, in parquet files of about target_bytes of FASTA.

    Each run has a folder of its own there. A group of files goes through one task, file by file; an attempt writes
    under a name of its own and renames it when complete, so a lost executor or a second attempt leaves at most an orphan,
    which no manifest names. The manifest is held against what was counted in the input (files, bytes and record
    heads of each group); the rename of CURRENT, which names the run, publishes it. Only then the data of the run
    before the last published one is removed, so what is being read stays. Whatever a run leaves that dies before,
    readers don't see it; sweep() removes it. Returns what CURRENT says.

    Nulls: a null or empty content is a file without records; a null landed_at is the earliest, a null
    source_file a file of its own. An empty table gives no data file and an empty manifest. Other columns are ignored.
    """
    store, root = fs.FileSystem.from_uri(out)
    store.create_dir(root)
    before = _current(out)
    current = latest(deliveries)
    plan, groups = schedule(sizes := checkpointed(current.select("source_file", "n_bytes", "n_heads")), target_bytes)
    plan = checkpointed(plan)
    run = f"run-{uuid.uuid4().hex}"
    store.create_dir(f"{root}/{run}")
    manifest = _write(current, plan, groups, f"{out}/{run}")
    _verify(manifest, plan, sizes)
    totals = manifest.agg(F.count(F.lit(1)).alias("groups"), *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in ("files", "records", "bytes")])
    said = totals.first().asDict() | {"run": run, "before": before and before["run"]}
    _publish(out, said)
    if before and before["before"]:
        _remove(out, before["before"])
    return said


def _remove(out: str, run: str) -> None:
    store, root = fs.FileSystem.from_uri(out)
    if store.get_file_info(f"{root}/{run}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/{run}")


def sweep(out: str) -> list[str]:
    """Removes the folders of all runs but the current one and the one before it; to be called while no run is going on."""
    store, root = fs.FileSystem.from_uri(out)
    said = _current(out) or {}
    runs = [f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("run-")]
    gone = sorted(set(runs) - {said.get("run"), said.get("before")})
    for run in gone:
        _remove(out, run)
    return gone


def read_consolidated(spark: SparkSession, out: str) -> DataFrame:
    """The published records: source_file, record_idx, header (first word), description, sequence.

    Only rows of files that the published manifest names are read, whatever else stands in the folder. The names stay
    in Spark: the manifest is joined to the rows' file name.
    """
    rows = spark.read.schema("source_file string, record_idx bigint, header string, description string, sequence string")
    rows = rows.parquet(f"{out}/{_current(out)['run']}")
    return rows.withColumn("_file", F.col("_metadata.file_name")).join(read_manifest(spark, out).select(F.col("path").alias("_file")), "_file", "left_semi").drop("_file")


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The published manifest: grp, path, n_files, n_records, n_bytes."""
    return spark.read.schema(MANIFEST).parquet(f"{out}/{_current(out)['run']}/_manifest")


def consolidated(deliveries: DataFrame) -> tuple[str, dict]:
    """Consolidates into a folder of the shared one that belongs to this application and input; the folder and what its CURRENT says.

    The same input again goes to the same folder, where the data of older runs is removed, so copies don't pile up.
    """
    spark = deliveries.sparkSession
    out = named_dir(spark, f"consolidated-{spark.sparkContext.applicationId}-{deliveries.semanticHash() & 0xFFFFFFFF:08x}")
    return out, consolidate(deliveries, out)
