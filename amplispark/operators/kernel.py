"""Approximate search of short patterns with ambiguity codes, over whole arrays of text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from amplispark.config import MatchConfig
from amplispark.functions.dna import rc_text

# The bases each code stands for, A = 1, C = 2, G = 4, T = 8.
CODES = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
BITS = np.zeros(256, np.uint8)
for _c, _b in CODES.items():
    BITS[ord(_c)] = BITS[ord(_c.lower())] = _b
#: Letters of text searched at once.
TILE = 1 << 22
#: Letters of a piece that are looked for in all text; letters below which a piece is too short to be worth it.
DENSE, SHORTEST = 3, 4


def to_bits(text: str) -> np.ndarray:
    return BITS[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def _mismatch(bits: np.ndarray, letter: int, subset: bool) -> np.ndarray:
    if subset:
        return (((bits & letter) != bits) | (bits == 0)).view(np.int8)
    return ((bits & letter) == 0).view(np.int8)


def end_costs(bits: np.ndarray, pattern: np.ndarray, k: int, subset: bool = False, cache: dict | None = None) -> np.ndarray:
    """For each position the least number of edits of the pattern against a substring ending there, k + 1 if more.

    One row of the edit matrix for each letter of the pattern, each a few passes over all text. An insertion run
    of more than k letters costs more than k, so k shifted minima stand for the recurrence along the row.
    """
    cache = {} if cache is None else cache
    n, top = len(bits), np.int8(k + 1)
    row = np.zeros(n, np.int8)
    for done, letter in enumerate(pattern.tolist()):
        if letter not in cache:
            cache[letter] = _mismatch(bits, letter, subset)
        wrong = cache[letter]
        new = np.empty(n, np.int8)
        np.add(row[:-1], wrong[1:], out=new[1:])
        new[0] = min(done, k + 1) + int(wrong[0])
        if k:
            np.minimum(new, row + np.int8(1), out=new)
            step = new
            for d in range(1, k + 1):
                step = new.copy() if d == 1 else step
                np.minimum(step[d:], new[:-d] + np.int8(d), out=step[d:])
            new = step
        np.minimum(new, top, out=new)
        row = new
    return row


def _places(fits: dict[int, np.ndarray], bits: np.ndarray, piece: list[int], subset: bool) -> np.ndarray:
    """Where the letters of a piece stand one after another: the first of them over all text, the others where those fit."""
    n = len(bits) - len(piece) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    for letter in piece:
        if letter not in fits:
            fits[letter] = _mismatch(bits, letter, subset) == 0
    alive = fits[piece[0]][:n]
    for j in range(1, min(DENSE, len(piece))):
        alive = alive & fits[piece[j]][j : j + n]
    at = np.flatnonzero(alive)
    for j in range(DENSE, len(piece)):
        at = at[fits[piece[j]][at + j]]
    return at


def ends_within(bits: np.ndarray, pattern: np.ndarray, k: int, subset: bool = False, fits: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The positions at which a match of at most k edits ends, ascending, and their costs.

    Of k + 1 pieces of the pattern one at least stands in a match without an edit. So the edit matrix is needed only near the
    places of the pieces, which are laid out side by side, apart by blanks.
    """
    fits = {} if fits is None else fits
    m = len(pattern)
    if m < SHORTEST * (k + 1):
        cost = end_costs(bits, pattern, k, subset)
        at = np.flatnonzero(cost <= k)
        return at, cost[at]
    cuts = np.linspace(0, m, k + 2).astype(np.int64).tolist()
    letters = pattern.tolist()
    if not k:
        at = _places(fits, bits, letters, subset) + m - 1
        return at, np.zeros(len(at), np.int8)
    last = np.concatenate([_places(fits, bits, letters[a:b], subset) + (m - a - 1 + k) for a, b in zip(cuts, cuts[1:])])
    if not len(last):
        return last, np.zeros(0, np.int8)
    last.sort()
    begin = np.maximum(last - 2 * k - m - k, 0)
    new = np.append(True, begin[1:] > last[:-1])
    begin, end = begin[new], np.minimum(last[np.append(new[1:], True)] + 1, len(bits))
    size = end - begin + k + 1
    where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    blank = where >= np.repeat(end, size)
    near = bits[np.minimum(where, len(bits) - 1)]
    near[blank] = 0
    cost = end_costs(near, pattern, k, subset)
    hit = np.flatnonzero((cost <= k) & ~blank)
    return where[hit], cost[hit]


def pick_ends(at: np.ndarray, cost: np.ndarray, report: str) -> np.ndarray:
    """Which of the ends (ascending positions within k, with their costs) are reported.

    A run of neighbouring ends of equal cost counts if the ends next to it on either side cost more or are none;
    one end stands for it.
    """
    if report == "all" or not len(at):
        return np.arange(len(at))
    joined = at[1:] == at[:-1] + 1
    new = np.append(True, ~(joined & (cost[1:] == cost[:-1])))
    first = np.nonzero(new)[0]
    last = np.append(first[1:] - 1, len(at) - 1)
    left = np.append(False, joined)[first] & (cost[np.maximum(first - 1, 0)] < cost[first])
    right = np.append(joined, False)[last] & (cost[np.minimum(last + 1, len(at) - 1)] < cost[last])
    return (last if report == "rightmost" else first)[~left & ~right]


def align(pattern: np.ndarray, window: np.ndarray, cost: int, subset: bool) -> tuple[int, str]:
    """As _aligned. A site recurs in many records and slices, so the last ALIGNED answers are kept."""
    return _aligned(pattern.tobytes(), window.tobytes(), cost, subset)


#: Alignments that a worker keeps, of some 200 bytes each.
ALIGNED = 1 << 16


@lru_cache(ALIGNED)
def _aligned(pattern: bytes, window: bytes, cost: int, subset: bool) -> tuple[int, str]:
    """Length of the matched substring at the window's end, and how it aligns.

    Of the substrings of this cost the one nearest to the pattern's length, then the shorter. The way back through
    the matrix prefers a pair of letters, then a pattern letter without text (I), then a text letter without
    pattern (D).
    """
    m, w = len(pattern), len(window)
    wrong = (lambda p, t: t == 0 or (p & t) != t) if subset else (lambda p, t: (p & t) == 0)
    if w >= m:
        pairs = [wrong(p, t) for p, t in zip(pattern, window[w - m :])]
        if sum(pairs) == cost:
            return m, _runs("X" if x else "=" for x in pairs)
    p, t = list(pattern), list(window)
    back = list(range(w + 1))  # cost of the pattern's suffix against each suffix of the window
    for i in range(1, m + 1):
        prev, back = back, [i] + [0] * w
        for j in range(1, w + 1):
            back[j] = min(prev[j - 1] + wrong(p[m - i], t[w - j]), prev[j] + 1, back[j - 1] + 1)
    size = min((j for j in range(1, w + 1) if back[j] == cost), key=lambda j: (abs(j - m), j))
    t = t[w - size :]
    table = [list(range(size + 1))]
    for i in range(1, m + 1):
        row = [i] + [0] * size
        for j in range(1, size + 1):
            row[j] = min(table[-1][j - 1] + wrong(p[i - 1], t[j - 1]), table[-1][j] + 1, row[j - 1] + 1)
        table.append(row)
    i, j, ops = m, size, []
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (x := wrong(p[i - 1], t[j - 1])):
            ops.append("X" if x else "=")
            i, j = i - 1, j - 1
        elif i and table[i][j] == table[i - 1][j] + 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return size, _runs(reversed(ops))


def _runs(ops) -> str:
    out: list[list] = []
    for o in ops:
        if out and out[-1][1] == o:
            out[-1][0] += 1
        else:
            out.append([1, o])
    return "".join(f"{n}{o}" for n, o in out)


@dataclass(frozen=True)
class Match:
    """A match on the + text: half-open, 0-based."""

    start: int
    end: int
    edit_distance: int
    strand: str
    cigar: str
    identity: float


class Texts:
    """Several texts laid out in one array, apart by so many blanks that no match of up to k edits spans two."""

    def __init__(self, texts: Sequence[np.ndarray], k: int):
        self.gap = k + 1
        size = np.array([len(t) for t in texts], np.int64)
        self.size = size
        self.begin = self.gap + np.cumsum(size + self.gap) - size - self.gap
        self.bits = np.zeros(int(size.sum()) + self.gap * (len(texts) + 1), np.uint8)
        for b, t in zip(self.begin.tolist(), texts):
            self.bits[b : b + len(t)] = t
        self.cache: dict[int, np.ndarray] = {}

    def find(self, pattern: np.ndarray, config: MatchConfig) -> list[tuple[int, Match]]:
        """Matches as (index of the text, match with strand +), by text, end and start."""
        m, k, subset = len(pattern), config.max_errors, config.text_ambiguity == "subset"
        if not m or not len(self.size):
            return []
        ats, costs = [], []
        for lo in range(0, len(self.bits), TILE):
            a = max(0, lo - m - k)
            tile = self.bits[a : lo + TILE]
            near, cost = ends_within(tile, pattern, k, subset, self.cache if len(self.bits) <= TILE else None)
            own = near >= lo - a
            ats.append(near[own] + a)
            costs.append(cost[own])
        at, cost = np.concatenate(ats), np.concatenate(costs)
        text = np.searchsorted(self.begin, at, side="right") - 1
        inside = (text >= 0) & (at < self.begin[text] + self.size[text])
        at, cost, text = at[inside], cost[inside], text[inside]
        out = []
        for i in pick_ends(at, cost, config.report).tolist():
            end, t, d = int(at[i]) + 1, int(text[i]), int(cost[i])
            if max(m - d, 0) / m < config.min_identity:
                continue
            b = int(self.begin[t])
            size, cigar = align(pattern, self.bits[max(b, end - m - k) : end], d, subset) if d else (m, f"{m}=")
            out.append((t, Match(end - b - size, end - b, d, "+", cigar, max(m - d, 0) / m)))
        return out


def find_matches(primer: str, text: str, config: MatchConfig = MatchConfig()) -> list[Match]:
    """Matches of a primer in a text, by end and start; with search_rc those of its reverse complement too, as strand -."""
    if not primer or not text:
        return []
    laid = Texts([to_bits(text)], config.max_errors)
    found = [m for _, m in laid.find(to_bits(primer), config)]
    if config.search_rc:
        found += [Match(m.start, m.end, m.edit_distance, "-", m.cigar, m.identity) for _, m in laid.find(to_bits(rc_text(primer)), config)]
    return found


def find_forward_matches(primer: str, text: str, config: MatchConfig = MatchConfig()) -> list[Match]:
    """Matches of a forward primer."""
    return find_matches(primer, text, config)


def find_reverse_matches(primer: str, text: str, config: MatchConfig = MatchConfig()) -> list[Match]:
    """Matches of a reverse primer as given; where it is to be looked for on the + text, give its reverse complement."""
    return find_matches(primer, text, config)
