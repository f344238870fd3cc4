"""Oversized sequences cut at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplispark.runtime import slices

LIMIT, LEAST, OVERLAP, GAP = 2000, 1000, 100, 10


def farthest(starts: np.ndarray, bounds: np.ndarray, length: int, limit: int, least: int, overlap: int) -> np.ndarray:
    """For each start the index of the boundary at which the next cut at a boundary falls, or len(bounds).

    Cuts without a boundary in reach fall every limit - overlap letters; the windows between two boundaries are
    skipped at once.
    """
    end, step = len(bounds), limit - overlap
    found = np.full(len(starts), end, np.int64)
    here, todo = starts.astype(np.int64).copy(), np.arange(len(starts))
    while len(todo):
        todo = todo[length - here[todo] > limit]
        lo, hi = here[todo] + least, here[todo] + limit
        last = np.searchsorted(bounds, hi, side="right") - 1
        hit = (last >= 0) & (bounds[np.maximum(last, 0)] >= lo) if end else np.zeros(len(todo), bool)
        found[todo[hit]] = last[hit]
        todo, lo, hi = todo[~hit], lo[~hit], hi[~hit]
        nxt = np.searchsorted(bounds, lo)
        todo, hi, nxt = todo[nxt < end], hi[nxt < end], nxt[nxt < end]
        if len(todo):
            here[todo] += step * np.maximum(1, -(-(bounds[nxt] - hi) // step))
    return found


def cuts(length: int, bounds: np.ndarray, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> np.ndarray:
    """Start and end of each piece of a text of more than `limit` letters, as rows.

    Nodes are the origin and all boundaries. Each is joined to its farthest legal successor; the table of
    successors is squared again and again, and with each squaring the known part of the way from the origin
    doubles.
    """
    step = limit - overlap
    starts = np.concatenate([[0], bounds - overlap])
    jump = np.append(farthest(starts, bounds, length, limit, least, overlap) + 1, len(starts))  # the last node is the end
    way = np.zeros(1, np.int64)
    while way[-1] < len(starts):
        way = np.concatenate([way, jump[way]])
        jump = jump[jump]
    way = way[way < len(starts)]
    begin = starts[way]
    stop = np.append(bounds[way[1:] - 1], length)
    plain = np.maximum(0, -(-(stop - begin - limit) // step))  # cuts without boundary on the way
    first = np.repeat(np.cumsum(plain + 1) - plain - 1, plain + 1)
    a = np.repeat(begin, plain + 1) + step * (np.arange(len(first)) - first)
    return np.column_stack([a, np.minimum(a + limit, np.repeat(stop, plain + 1))])


def split_oversized(rows: DataFrame, id_col: str, seq_col: str, kind: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, gap: int = GAP, with_text: bool = False) -> DataFrame:
    """All pieces of each sequence longer than `limit`: rec_kind, rec_id, piece_no, piece_start, piece_end.

    A boundary is a position after at least `gap` N or n and before another letter. While more than `limit` letters
    remain from start s, a piece ends at the greatest boundary from s + least to s + limit, else at s + limit, and
    the next starts `overlap` before that end. Null, empty and short sequences have no pieces; repeated rows come
    out once each; other columns are ignored. With `with_text` the pieces themselves come too. Only a scan and a
    projection: nothing is shuffled. 0 <= overlap < least <= limit.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("0 <= overlap < least <= limit must hold")
    ends = re.compile(rf"[Nn]{{{gap}}}(?=[^Nn])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_seq"):
            ids, no, at, text = [], [], [], []
            for rec, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = cuts(len(seq), np.array([m.end() for m in ends.finditer(seq)], np.int64), limit, least, overlap)
                ids += [rec] * len(got)
                no += range(len(got))
                at.append(got)
                if with_text:
                    text += [seq[a:b] for a, b in got.tolist()]
            both = np.concatenate(at) if at else np.zeros((0, 2), np.int64)
            cols = [pa.array(ids, batch.schema.field(0).type), pa.array(no, pa.int64()), pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())]
            names = ["rec_id", "piece_no", "piece_start", "piece_end"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(text, pa.string())] * with_text, names=names + ["piece"] * with_text)

    schema = f"rec_id {rows.schema[id_col].dataType.simpleString()}, piece_no bigint, piece_start bigint, piece_end bigint" + ", piece string" * with_text
    long = rows.where(F.length(seq_col) > limit).select(F.col(id_col).alias("_id"), F.col(seq_col).alias("_seq"))
    return long.mapInArrow(run, schema).select(F.lit(kind).alias("rec_kind"), "*")
