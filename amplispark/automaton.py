"""Finite automata over many texts at once."""

from __future__ import annotations

import numpy as np

CHUNK = 64


def run(kind: np.ndarray, offsets: np.ndarray, step: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The state before each symbol, and each row's last state. Row i is kind[offsets[i]:offsets[i + 1]].

    Rows are cut into chunks. Each chunk is read from all states at once, which gives its transition function; the
    functions of a row's chunks are composed by a prefix scan; a second reading, from the states so found, gives
    the state before each symbol. A row of any length costs as many steps as a chunk is long, and the logarithm of
    its number of chunks.
    """
    n, states = len(offsets) - 1, len(step)
    if n <= 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    per_row = np.maximum(1, -(-np.diff(offsets) // CHUNK))
    row = np.repeat(np.arange(n), per_row)
    head = np.cumsum(per_row) - per_row
    nth = np.arange(len(row)) - head[row]
    begin = offsets[row] + nth * CHUNK
    size = np.clip(offsets[row + 1] - begin, 0, CHUNK)
    order = np.argsort(-size, kind="stable")
    longer = np.searchsorted(-size[order], -np.arange(CHUNK), side="left")  # chunks longer than j
    begin = begin[order]

    change = np.tile(np.arange(states, dtype=np.uint8), (len(row), 1))
    for j in range(CHUNK):
        k = longer[j]
        change[:k] = step[change[:k], kind[begin[:k] + j][:, None]]
    change[order] = change.copy()
    d = 1
    while d < per_row.max():
        at = np.nonzero(nth >= d)[0]
        change[at] = np.take_along_axis(change[at], change[at - d].astype(np.intp), axis=1)
        d *= 2
    enter = np.full(len(row), start, np.uint8)
    enter[1:] = np.where(nth[1:] > 0, change[:-1, start], start)
    enter = enter[order]
    before = np.empty(len(kind), np.uint8)
    for j in range(CHUNK):
        k = longer[j]
        before[begin[:k] + j] = enter[:k]
        enter[:k] = step[enter[:k], kind[begin[:k] + j]]
    return before, change[head + per_row - 1, start]
