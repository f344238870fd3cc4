"""Byte-pair encoding of whole corpora with a public vocabulary."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplispark.runtime import slices

#: Folder of the public vocabularies, and the file used; both can be given instead.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: how this vocabulary divides text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, and letters in them, that a worker keeps with their ids; beyond, all are dropped.
KEPT_PIECES, KEPT_LETTERS = 400_000, 8_000_000
#: Cells of one table of pieces that are merged side by side.
CELLS = 1 << 20
NONE = np.iinfo(np.int64).max


def _letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: visible ones for themselves, the rest from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder. Merges are chosen by rank, the leftmost first among equals."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.of_byte = np.array([vocab[c] for c in _letters()], np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = dict(zip(key.tolist(), range(len(pairs))))
        self.split = regex.compile(PATTERN)
        self.kept: dict[str, tuple[int, ...]] = {}
        self.letters = 0

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging each pair, NONE where there is no such merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge_table(self, ids: np.ndarray, length: np.ndarray) -> list[tuple[int, ...]]:
        """Encodes the rows of `ids` (padded to a power of two) side by side.

        Each row has a segment tree over its positions that holds rank * width + position of the pair that begins
        there; the root is the leftmost least. A merge changes three leaves: the merged one, the one that went
        and the one before, each with a logarithmic update of its ancestors.
        """
        n, width = ids.shape
        levels = width.bit_length() - 1
        rows, place = np.arange(n), np.arange(width)
        # one more position than the width: the end, which merges with nothing
        after = np.minimum(np.tile(place + 1, (n, 1)), length[:, None])
        after = np.where(after >= length[:, None], width, after)
        before = np.tile(place - 1, (n, 1))
        ids = np.concatenate([ids, np.full((n, 1), (1 << 20) - 1)], axis=1)
        tree = np.full((n, 2 * width), NONE, np.int64)
        r = self.ranks_of(ids[:, :-1], ids[:, 1:])
        r[place[None, :] >= length[:, None] - 1] = NONE
        tree[:, width:] = np.where(r == NONE, NONE, r * width + place)
        for level in range(levels - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        live = rows[tree[:, 1] != NONE]
        while len(live):
            rank, at = np.divmod(tree[live, 1], width)
            gone = after[live, at]
            nxt, prv = after[live, gone], before[live, at]
            ids[live, at] = self.made[rank]
            after[live, at] = nxt
            inner = nxt < width
            before[live[inner], nxt[inner]] = at[inner]
            here = self.ranks_of(ids[live, at], ids[live, nxt])
            tree[live, width + gone] = NONE
            tree[live, width + at] = np.where((here == NONE) | ~inner, NONE, here * width + at)
            has = prv >= 0
            pr, pa_ = live[has], prv[has]
            left = self.ranks_of(ids[pr, pa_], ids[pr, at[has]])
            tree[pr, width + pa_] = np.where(left == NONE, NONE, left * width + pa_)
            row = np.concatenate([live, live, pr])
            node = np.concatenate([gone, at, pa_]) + width
            for _ in range(levels):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] != NONE]
        out = []
        alive = np.zeros((n, width), bool)
        # a position is alive if it is reached from the first by `after`
        at = np.zeros(n, np.int64)
        going = rows[length > 0]
        while len(going):
            alive[going, at[going]] = True
            at[going] = after[going, at[going]]
            going = going[at[going] < width]
        flat_ids = ids[:, :-1][alive]
        ends = np.cumsum(alive.sum(axis=1))
        listed = flat_ids.tolist()
        start = 0
        for end in ends.tolist():
            out.append(tuple(listed[start:end]))
            start = end
        return out

    def merge_one(self, ids: list[int]) -> tuple[int, ...]:
        """The same for one long piece, with the tree in a list."""
        n = len(ids)
        width = 1 << max(1, (n - 1).bit_length())
        none, ranks, made = 1 << 62, self.ranks, self.made
        after, before = [*range(1, n), width], [*range(-1, n - 1)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            nxt, prv = after[gone], before[at]
            ids[at] = int(made[rank])
            ids[gone] = -1
            after[at] = nxt
            put(gone, none)
            value = none
            if nxt < width:
                before[nxt] = at
                if (r := ranks.get(ids[at] << 20 | ids[nxt])) is not None:
                    value = r * width + at
            put(at, value)
            if prv >= 0:
                r = ranks.get(ids[prv] << 20 | ids[at])
                put(prv, none if r is None else r * width + prv)
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each piece; pieces of like length are merged together."""
        raw = [p.encode("utf-8") for p in pieces]
        out: list[tuple[int, ...]] = [()] * len(raw)
        classes: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            classes.setdefault(max(1, (len(b) - 1).bit_length()), []).append(i)
        for power, members in classes.items():
            width = 1 << power
            if len(members) < 12 and width >= 256:
                for i in members:
                    out[i] = self.merge_one(self.of_byte[np.frombuffer(raw[i], np.uint8)].tolist())
                continue
            step = max(1, CELLS // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                length = np.array([len(raw[i]) for i in part], np.int64)
                padded = b"".join(raw[i].ljust(width, b"\0") for i in part)
                ids = self.of_byte[np.frombuffer(padded, np.uint8)].reshape(len(part), width)
                for i, got in zip(part, self.merge_table(ids, length)):
                    out[i] = got
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; an empty or null text has none."""
        cut = [self.split.findall(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_PIECES or self.letters > KEPT_LETTERS:
            self.kept.clear()
            self.letters = 0
        new = list({p for c in cut for p in c} - self.kept.keys())
        self.letters += sum(map(len, new))
        self.kept.update(zip(new, self.encode_pieces(new)))
        kept = self.kept
        return [[i for p in c for i in kept[p]] for c in cut]


@lru_cache(2)
def encoder(path: str) -> Bpe:
    return Bpe(path)


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


def encode(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, carry: tuple[str, ...] = (), counts: bool = False) -> DataFrame:
    """id_col and ids (array of int) of each row, without special tokens; strings of special tokens are plain text.

    An empty or null text has an empty list. Repeated rows come out once each. Very long texts are encoded whole.
    `carry` names further columns to keep; others are ignored. With `counts`, n_tokens comes instead of ids.
    The file at `path` must be there on every executor. Only a scan and a projection: nothing is shuffled.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, "_text", rows=4096):
            ids = bpe.encode(batch.column(0).to_pylist())
            got = pa.array([len(i) for i in ids], pa.int32()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], got], names=[*batch.schema.names[1:], "_got"])

    rest = [id_col, *carry]
    rows = texts.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    kinds = ", ".join(f"_{i} {texts.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    got = rows.mapInArrow(run, f"{kinds}, _got {'int' if counts else 'array<int>'}")
    return got.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)], F.col("_got").alias("n_tokens" if counts else "ids"))
