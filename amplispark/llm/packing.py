"""Texts packed into containers of fixed capacity, with lexically near texts together."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amplispark.llm.bpe import encode
from amplispark.runtime import checkpointed, slices

CAPACITY = 2048
#: Bytes of text that one shard of the index holds on average.
SHARD_BYTES = 4_000_000
K1, B = 1.2, 0.75
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Longer runs of letters (scripts without spaces, sequences) are indexed by parts of so many letters.
PART = 12
#: The least hashes of a text's terms, by which near texts of one cluster come to the same shard.
ROUTE = 3
#: Clusters of texts, fitted on at most FITTED texts (by hash), over vectors of DIMENSIONS numbers; terms are counted in 1 << COUNTERS classes for their weights.
CLUSTERS, FITTED, DIMENSIONS, COUNTERS, ROUNDS = 256, 8_192, 256, 16, 8
#: Neighbours that are looked at in one go.
BEST = 128
#: Texts looked at for each bound between shards.
SAMPLE = 50


def _terms(text: str) -> list[str]:
    out = []
    for w in WORDS.findall(text.lower()):
        out += [w] if len(w) <= PART else [w[i : i + 4] for i in range(0, len(w), 4)]
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of _text its size, the 64-bit hashes of its terms, how often each stands in it, and the least hashes as _route."""
    known: dict[str, int] = {}
    for batch in batches:
        for part in slices([batch], "_text"):
            ids, times, routes = [], [], []
            for text in part.column("_text").to_pylist():
                own = _terms(text or "")
                for t in own:
                    if t not in known:
                        known[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                i, n = np.unique(np.array([known[t] for t in own], np.int64), return_counts=True)
                ids.append(i)
                times.append(n)
                routes.append(i[:ROUTE].astype(">i8").tobytes())
                if len(known) > 1_000_000:
                    known.clear()
            at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((ids, np.int64), (times, np.int32))]
            size = [64 + len(t.encode("utf-8", "surrogatepass")) if t else 64 for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("n_tokens"), pa.array(size, pa.int64()), pa.array(routes, pa.binary()), *lists], ["_id", "n_tokens", "_bytes", "_route", "_terms", "_times"])


class Index:
    """BM25 index of one shard: for each term the items that hold it and what it adds to their score.

    How many texts hold a term (`df` of the sorted `known`), the number of texts and their mean length are those of the whole corpus.
    """

    def __init__(self, terms: list[np.ndarray], times: list[np.ndarray], known: np.ndarray, df: np.ndarray, texts: int, mean: float):
        self.of = [np.searchsorted(known, t) for t in terms]
        length = np.array([t.sum() for t in times], float)
        term = np.concatenate([*self.of, np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        order = np.argsort(term, kind="stable")
        self.item, times = item[order], np.concatenate([*times, np.zeros(0, np.int64)])[order]
        here = np.bincount(term, minlength=len(known))
        self.at = np.concatenate([[0], np.cumsum(here)])
        idf = np.log1p((texts - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        self.adds = np.repeat(idf, here) * times * (K1 + 1) / (times + norm[self.item])
        self.n = len(terms)

    def scores(self, i: int) -> np.ndarray:
        """Score of every item for item i as query."""
        own = self.of[i]
        lo, size = self.at[own], self.at[own + 1] - self.at[own]
        if not len(own):
            return np.zeros(self.n)
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.item[at], self.adds[at], self.n)

    def keep(self, unused: np.ndarray) -> None:
        """Takes the other items out of the lists."""
        stay = unused[self.item]
        self.at = np.concatenate([[0], np.cumsum(stay)])[self.at]
        self.item, self.adds = self.item[stay], self.adds[stay]


def fill(sizes: np.ndarray, index: Index, capacity: int) -> list[list[int]]:
    """Items (1 <= size <= capacity) in containers.

    The largest unused item seeds a container; its unused neighbours by BM25 are added, best first, while they fit;
    what room then remains is filled with the largest items that fit.
    """
    order = np.argsort(-sizes, kind="stable")
    ascending = order[::-1]
    ranked = sizes[ascending]
    # up[k]: the last unused place at or before k, in order of size, found with path halving
    up = list(range(-1, len(sizes)))
    unused = np.ones(len(sizes), bool)
    place = np.empty(len(sizes), np.int64)
    place[ascending] = np.arange(len(sizes))

    def largest(k: int) -> int:
        k += 1
        while up[k] != k - 1 and k > 0:
            if k > 0 and up[k] + 1 != k:
                up[k] = up[up[k] + 1]
            k = up[k] + 1
        return k - 1

    def take(i: int, into: list[int]) -> int:
        unused[i] = False
        k = int(place[i]) + 1
        up[k] = k - 2
        into.append(i)
        return int(sizes[i])

    out = []
    left = listed = len(sizes)
    for seed in order.tolist():
        if not unused[seed]:
            continue
        if 2 * left < listed:
            index.keep(unused)
            listed = left
        box: list[int] = []
        room = capacity - take(seed, box)
        score = index.scores(seed)
        near = np.nonzero(unused & (score > 0) & (sizes <= room))[0]
        while len(near):  # best first, some at a time, until none of the rest fits
            if len(near) > BEST:
                least = np.partition(score[near], len(near) - BEST)[len(near) - BEST]
                now, near = near[score[near] >= least], near[score[near] < least]
            else:
                now, near = near, near[:0]
            for i in now[np.argsort(-score[now], kind="stable")].tolist():
                if sizes[i] <= room:
                    room -= take(i, box)
            near = near[sizes[near] <= room]
        while room > 0 and (k := largest(int(np.searchsorted(ranked, room, side="right")) - 1)) >= 0:
            room -= take(int(ascending[k]), box)
        left -= len(box)
        out.append(box)
    return out


def _words(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
    """The terms of a shard and how many of its texts hold each."""
    ids, n = np.unique(np.concatenate([*shard["_terms"], np.zeros(0, np.int64)]).astype(np.int64), return_counts=True)
    return pd.DataFrame({"_shard": key[0], "term": ids, "here": n})


def _pack(capacity: int, texts: int, mean: float):
    def run(key: tuple, shard: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(_tie=[t.tobytes() + n.tobytes() for t, n in zip(shard["_terms"], shard["_times"])])
        shard = shard.sort_values(["n_tokens", "_id", "_tie"], ascending=[False, True, True], kind="stable")
        words = words.sort_values("term")
        base = int(key[0]) << 32
        rows: list[tuple] = []
        items, boxes = [], 0
        for doc, n, terms, times in zip(shard["_id"].tolist(), shard["n_tokens"].tolist(), shard["_terms"], shard["_times"]):
            full = n // capacity if n > capacity else 0
            for p in range(full):
                rows.append((base + boxes, 0, doc, p, p * capacity, (p + 1) * capacity))
                boxes += 1
            if n - full * capacity or not n:
                items.append((doc, full, full * capacity, n, terms, times))
        solid = [x for x in items if x[3] > x[2]]
        index = Index([x[4] for x in solid], [x[5] for x in solid], words["term"].to_numpy(np.int64), words["df"].to_numpy(np.int64), texts, mean)
        for box in fill(np.array([x[3] - x[2] for x in solid], np.int64), index, capacity):
            for slot, i in enumerate(box):
                rows.append((base + boxes, slot, *solid[i][:4]))
            boxes += 1
        for slot, x in enumerate(x for x in items if x[3] == x[2]):
            rows.append((base + max(boxes - 1, 0), 1_000_000 + slot, *x[:4]))
        return pd.DataFrame(rows, columns=["container_id", "slot", "doc_id", "piece_no", "token_start", "token_end"])

    return run


def _mixed(terms: np.ndarray) -> np.ndarray:
    return terms.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and each one's row."""
    size = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(size)), size)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts hold a term of each class."""
    counts = np.zeros(1 << COUNTERS, np.int64)
    for batch in batches:
        counts += np.bincount((_mixed(batch.column(0).flatten().to_numpy()) >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["kind", "n"])


class Clusters:
    """Groups of texts with like terms: centroids in an order in which each is followed by its nearest."""

    def __init__(self, counts: np.ndarray, texts: int):
        self.weight = np.log1p((texts - counts + 0.5).clip(0.5) / (counts + 0.5)).astype(np.float32)
        self.centres = np.zeros((0, DIMENSIONS), np.float32)

    def vectors(self, terms, times) -> np.ndarray:
        """One vector of length 1 for each text: its terms' weights, added up with either sign by hash."""
        every, row = _flat(terms)
        often, _ = _flat(times)
        mixed = _mixed(every)
        value = self.weight[(mixed >> np.uint64(64 - COUNTERS)).astype(np.int64)] * (often / (often + K1)) * np.where(mixed & np.uint64(1 << 20), 1.0, -1.0)
        at = row * DIMENSIONS + ((mixed >> np.uint64(24)) % np.uint64(DIMENSIONS)).astype(np.int64)
        out = np.bincount(at, value, len(terms) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def fit(self, terms, times) -> None:
        points = self.vectors(terms, times)
        k = min(CLUSTERS, len(points))
        if not k:
            return
        centres = points[np.linspace(0, len(points) - 1, k).astype(np.int64)].copy()
        for _ in range(ROUNDS):
            of = np.argmax(points @ centres.T, axis=1)
            size = np.bincount(of, minlength=k)
            total = np.zeros_like(centres)
            np.add.at(total, of, points)
            centres = np.where(size[:, None] > 0, total, centres)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        near, left, chain = centres @ centres.T, set(range(1, k)), [0]
        while left:
            chain.append(max(left, key=lambda j: near[j, chain[-1]]))
            left.remove(chain[-1])
        self.centres = centres[chain]

    def of(self, terms, times) -> np.ndarray:
        if not len(self.centres):
            return np.zeros(len(terms), np.int64)
        return np.argmax(self.vectors(terms, times) @ self.centres.T, axis=1)


def placed(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """_id, n_tokens, _bytes, _route, _terms, _times and _shard of each text.

    Shards are ranges of routes: a text's cluster, the least hashes of its terms, which are the same in texts with many
    terms in common (min-hash), and a hash of the id, so that copies lie in neighbouring ranges. Clusters are fitted on a
    bounded sample; every text is put into one. The bounds between shards come from a sample of SAMPLE texts a shard and cut
    it into equal shares of bytes, so that no source, language or cluster makes a large shard.
    """
    sized = encode(texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", path, carry=("_text",), counts=True)
    kind = texts.schema[id_col].dataType.simpleString()
    sized = checkpointed(sized.select("_id", F.col("n_tokens").cast("bigint"), "_text").mapInArrow(_hashed, f"_id {kind}, n_tokens bigint, _bytes bigint, _route binary, _terms array<bigint>, _times array<int>"))
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    shards = max(1, -(-int(total) // SHARD_BYTES))
    if shards == 1:
        return sized.withColumn("_shard", F.lit(0).cast("bigint"))

    counts = np.zeros(1 << COUNTERS, np.int64)
    for r in sized.select("_terms").mapInArrow(_counted, "kind int, n bigint").groupBy("kind").agg(F.sum("n").alias("n")).collect():  # at most 1 << COUNTERS rows
        counts[r["kind"]] = r["n"]
    clusters = Clusters(counts, n)
    few = sized.where(F.size("_terms") > 0).select("_terms", "_times", F.xxhash64("_id", "_route").alias("h")).orderBy("h").limit(FITTED).toPandas()
    clusters.fit(few["_terms"].tolist(), few["_times"].tolist())

    @F.pandas_udf("binary")
    def cluster(terms: pd.Series, times: pd.Series) -> pd.Series:
        of = [clusters.of(terms[lo : lo + 5_000].tolist(), times[lo : lo + 5_000].tolist()) for lo in range(0, len(terms), 5_000)]
        return pd.Series([int(k).to_bytes(2, "big") for k in np.concatenate([*of, np.zeros(0, np.int64)])])

    every = max(1, n // (shards * SAMPLE))
    sized = sized.withColumn("_route", F.concat(cluster("_terms", "_times"), "_route", F.unhex(F.lpad(F.hex(F.xxhash64("_id")), 16, "0"))))
    seen = sorted((bytes(r[0]), r[1]) for r in sized.where(F.pmod(F.xxhash64(F.lit(1), "_id", "_times"), F.lit(every)) == 0).select("_route", "_bytes").toLocalIterator())
    upto = np.cumsum([b for _, b in seen])
    bounds = [seen[min(int(np.searchsorted(upto, upto[-1] * k / shards)), len(seen) - 1)][0] for k in range(1, shards)] if seen else []

    @F.pandas_udf("bigint")
    def shard(at: pd.Series) -> pd.Series:
        return at.map(lambda x: bisect_right(bounds, bytes(x))).astype("int64")

    return checkpointed(sized.withColumn("_shard", shard("_route")))  # once: what follows must see the same shards


def pack(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every text in a container of at most `capacity` tokens: container_id, slot, doc_id, piece_no, token_start, token_end.

    Only a text of more than `capacity` tokens is split: into full containers and a rest that is packed like the
    others. Empty and null texts have no tokens and stand in their shard's last container. Repeated rows are packed
    once each, an empty table gives no rows, other columns are ignored.

    Scores are those of the whole corpus, but a text's neighbours are looked for in its shard only. A shard holds about
    SHARD_BYTES of text whatever the size of the corpus, and leaves at most a few containers unfilled.
    """
    at = placed(texts, id_col, text_col, path)
    kind = texts.schema[id_col].dataType.simpleString()
    held = at.where(F.col("n_tokens") % capacity != 0)
    n, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("_times", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()
    words = held.select("_shard", "_terms").groupBy("_shard").applyInPandas(_words, "_shard bigint, term bigint, here bigint")
    words = words.withColumn("df", F.sum("here").over(Window.partitionBy("term")))
    out = at.select("_shard", "_id", "n_tokens", "_terms", "_times").groupBy("_shard").cogroup(words.select(F.col("_shard").alias("_of"), "term", "df").groupBy("_of"))
    out = out.applyInPandas(_pack(capacity, n, length / max(n, 1)), f"container_id bigint, slot bigint, doc_id {kind}, piece_no bigint, token_start bigint, token_end bigint")
    return out.withColumnRenamed("doc_id", id_col)
