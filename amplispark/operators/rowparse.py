"""Typed rows out of raw separated lines, with the reason for those that do not parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplispark.automaton import run
from amplispark.runtime import flat, slices

START, BARE, QUOTED, QUOTE, CLOSED, BAD = range(6)
OTHER, SEPARATOR, MARK, BLANK, CR, LF = range(6)
#: Next state by state and class of the byte: OTHER, SEPARATOR, MARK, BLANK, CR, LF.
STEP = np.array(
    [
        [BARE, START, QUOTED, START, BARE, BARE],  # START: before a field's first letter
        [BARE, START, BAD, BARE, BARE, BARE],  # BARE: in a field without quotes
        [QUOTED, QUOTED, QUOTE, QUOTED, QUOTED, QUOTED],  # QUOTED
        [BAD, START, QUOTED, CLOSED, CLOSED, BAD],  # QUOTE: the quoted field ends here, unless another mark follows
        [BAD, START, BAD, CLOSED, CLOSED, BAD],  # CLOSED: after a quoted field
        [BAD] * 6,
    ],
    np.uint8,
)
CLASS = np.zeros(256, np.uint8)
for _byte, _class in ((",", SEPARATOR), ('"', MARK), (" ", BLANK), ("\t", BLANK), ("\r", CR), ("\n", LF)):
    CLASS[ord(_byte)] = _class
LETTERS = re.compile("[ACGTRYSWKMBDHVNacgtryswkmbdhvn]*")
TRIM = " \t\r\n"


def _read(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As scan, and the positions where a row went BAD or a quoted field was opened."""
    kind = CLASS[data]
    before, final = run(kind, offsets, STEP, START)
    after = STEP[before, kind]
    marks = np.nonzero((before != BAD) & (after == BAD) | (before == START) & (after == QUOTED))[0]
    return final, np.nonzero((kind == SEPARATOR) & (before != QUOTED) & (before != BAD))[0], marks


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final state of each row, and the positions of all separators that divide fields."""
    return _read(data, offsets)[:2]


def _value(raw: str) -> str:
    inner = raw.strip(" \t\r")
    return (inner[1:-1].replace('""', '"') if inner.startswith('"') else raw).strip(TRIM)


def _letters(raw: bytes) -> int:
    return len(raw.decode())


def _fault(raw: str) -> int:
    """Position in a field of the first letter of its value that stands for no base."""
    at = len(raw) - len(raw.lstrip(TRIM))
    if raw.strip(" \t\r").startswith('"'):
        at += 1
        at += len(raw[at:]) - len(raw[at:].lstrip(TRIM))
    return LETTERS.match(raw, at).end()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_line"):
        ids, lines = batch.column(0), batch.column(1)
        data, offsets = flat(lines)
        final, at, marks = _read(data, offsets)
        last = np.searchsorted(marks, offsets[1:]) - 1
        lo, hi = np.searchsorted(at, offsets[:-1]), np.searchsorted(at, offsets[1:])
        raw = data.tobytes()
        out: list[tuple] = []
        for i in range(batch.num_rows):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if not raw[a:b].strip(b" \t\r\n"):
                out.append((None, None, None, "blank", None))
            elif final[i] in (QUOTED, BAD):
                out.append((None, None, None, "quoting", _letters(raw[a : marks[last[i]]])))
            elif hi[i] - lo[i] < 2:
                out.append((None, None, None, "columns", _letters(raw[a:b])))
            else:
                s = [int(x) for x in at[lo[i] : min(lo[i] + 3, hi[i])]]
                bounds = ((a, s[0]), (s[0] + 1, s[1]), (s[1] + 1, s[2] if len(s) > 2 else b))
                fields = [raw[x:y].decode() for x, y in bounds]
                values = [_value(f) for f in fields]
                empty = [k for k in range(3) if not values[k]]
                wrong = empty or [k for k in (1, 2) if not LETTERS.fullmatch(values[k])]
                if wrong:
                    k = wrong[0]
                    inside = 0 if empty else _fault(fields[k])
                    out.append((None, None, None, "empty" if empty else "letters", _letters(raw[a : bounds[k][0]]) + inside))
                else:
                    out.append((*values, None, None))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], names=["_id", "name", "forward", "reverse", "reason", "offset"])


def parse_primer_lines(lines: DataFrame, id_col: str = "line_id", line_col: str = "line", no_col: str = "line_no") -> DataFrame:
    """Each row of primer sheets as id, name, forward, reverse, reason, offset; the last two are null where the row loads.

    offset counts letters of the row from 0: for `quoting` the letter that broke the rules, or the quote sign that opened
    a field never closed; for `columns` the row's end; for `empty` the start of the first empty field; for `letters`
    the first letter that stands for no base.

    Each row is judged alone: first `quoting`, then `columns`, `empty`, `letters`. Values are trimmed of space, tab,
    CR and LF and otherwise kept as they are. Left out: header rows (no_col 1) and blank rows (null, empty or only
    white space). A null no_col is no header. Repeated rows come out once each. Other columns are ignored. Only a
    scan and a projection: nothing is shuffled.
    """
    body = lines.where(F.col(no_col).isNull() | (F.col(no_col) != 1)).where(F.col(line_col).isNotNull())
    kind = body.schema[id_col].dataType.simpleString()
    out = body.select(F.col(id_col).alias("_id"), F.col(line_col).alias("_line")).mapInArrow(_parse, f"_id {kind}, name string, forward string, reverse string, reason string, offset bigint")
    return out.where(F.coalesce("reason", F.lit("")) != "blank").withColumnRenamed("_id", id_col)
