"""Long exact spans that stand in more than one record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from amplispark.runtime import checkpointed, slices

SPAN, TOKEN = 80, 24
#: Bits (as a power of two) of the broadcast filter of shared signatures, 16 or more for each of them. Where that takes more
#: than 1 << MOST_BITS (32 MB), the windows are found by a join instead.
LEAST_BITS, MOST_BITS = 20, 28
#: Bits of a hash that give way to the token's position, in every text alike, and starts of windows found at once.
PLACE_BITS, CHUNK = 24, 1 << 22
#: Letters of contexts that are compared at once.
COMPARED = 1 << 22
#: A signature with more different contexts than this is verified span by span instead of in one task.
HOT_CONTEXTS = 20_000

LETTER = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    LETTER[_c] = _i
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _packed(letters: np.ndarray, length: int) -> np.ndarray:
    """The `length` (<= 32) letters from each position on as one number, two bits a letter."""
    n = len(letters) - length + 1
    powers, part, size = {}, (letters & 3).astype(np.uint64), 1
    while size <= length:
        powers[size] = part
        if 2 * size <= length:
            part = (part[: len(part) - size] << np.uint64(2 * size)) | part[size:]
        size *= 2
    out, done = np.zeros(n, np.uint64), 0
    for size in sorted(powers, reverse=True):
        if length & size:
            out = (out << np.uint64(2 * size)) | powers[size][done : done + n]
            done += size
    return out


def compact_windows(text: np.ndarray, span: int = SPAN, token: int = TOKEN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature, centre, first and last start of the compact windows of a text.

    Tokens are all substrings of `token` letters, each with a hash. In the Cartesian tree over the hashes (leftmost
    least token on top) every node is the least token of a range of positions, and stands for all spans in that
    range that hold it: they all have its hash as min-hash. Nodes whose range is shorter than `span` stand for no span
    and are left out; of the others, which are the least tokens of some window of a span's tokens, the range is
    kept as far as it concerns spans: their starts run from the first to the last given. So each span of only
    A, C, G, T belongs to exactly one compact window, and an equal span of another record to one with the same
    signature: one hash is enough for equal spans. On average a window stands for some (span - token) / 2 spans.
    Of a text longer than CHUNK a window may come in two parts.
    """
    parts = [_windows(text[lo : lo + CHUNK + span - 1], span, token) for lo in range(0, max(len(text) - span + 1, 1), CHUNK)]
    return tuple(np.concatenate([part[k] + (np.int64(n * CHUNK) if k else np.int64(0)) for n, part in enumerate(parts)]) for k in range(4))


def _windows(text: np.ndarray, span: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(text) < span:
        return empty
    letters = LETTER[text]
    bad = np.zeros(len(text) + 1, np.int32)
    np.cumsum(letters == 4, out=bad[1:])
    starts = np.nonzero(bad[span:] == bad[:-span])[0]
    if not len(starts):
        return empty
    value = _packed(letters, token)
    value *= MIX[0]
    value ^= value >> np.uint64(32)
    value *= MIX[1]
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (value & ~low) | np.arange(len(value), dtype=np.uint64)
    width, want = 1, span - token + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    centre = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (centre[1:] != centre[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.append(new[1:], True)]
    centre = centre[new]
    return value[centre].view(np.int64), centre, first, last


def _joined(values: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Texts with a separator between, one byte a code point, and where each begins."""
    raw = "|".join(values).encode("latin-1", "replace")
    begin = np.cumsum([0, *(len(v) + 1 for v in values)])[:-1]
    return np.frombuffer(raw, np.uint8), begin, raw


def _in_filter(bits: np.ndarray, sig: np.ndarray) -> np.ndarray:
    size = np.uint64(len(bits) * 8 - 1)
    u = sig.view(np.uint64)
    ok = np.ones(len(sig), bool)
    for place in (u & size, (u >> np.uint64(33)) & size):
        ok &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def _signatures(span: int, token: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_seq"):
            text, begin, _ = _joined(batch.column(1).to_pylist())
            sig, _, first, _ = compact_windows(text, span, token)
            rec = batch.column(0).to_numpy()[np.searchsorted(begin, first, side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(rec)], names=["sig", "rec"])

    return go


def _contexts(span: int, token: int, bits):
    """The windows worth a look with their letters: those whose signature is in the filter."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches, "_seq"):
            text, begin, raw = _joined(batch.column(1).to_pylist())
            sig, centre, first, last = compact_windows(text, span, token)
            keep = _in_filter(table, sig)
            yield _cut_out(batch.column(0).to_numpy(), begin, raw, sig[keep], centre[keep], first[keep], last[keep], span)

    return go


def _cut_out(recs: np.ndarray, begin: np.ndarray, raw: bytes, sig: np.ndarray, centre: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> pa.RecordBatch:
    row = np.searchsorted(begin, first, side="right") - 1
    ctx = [raw[a:b] for a, b in zip(first.tolist(), (last + span).tolist())]
    cols = [pa.array(sig), pa.array(recs[row]), pa.array(first - begin[row]), pa.array(centre - first), pa.array(ctx, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["sig", "rec", "at", "off", "ctx"])


def _places(span: int, token: int):
    """All windows, without letters."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_seq"):
            text, begin, _ = _joined(batch.column(1).to_pylist())
            sig, centre, first, last = compact_windows(text, span, token)
            row = np.searchsorted(begin, first, side="right") - 1
            cols = [pa.array(sig), batch.column(0).take(pa.array(row)), pa.array(first - begin[row]), pa.array(centre - first), pa.array(last - first)]
            yield pa.RecordBatch.from_arrays(cols, names=["sig", "rec", "at", "off", "more"])

    return go


def _by_join(rows: DataFrame, shared: DataFrame, span: int, token: int) -> DataFrame:
    """What _contexts gives, without a filter: windows and shared signatures are joined before letters are cut out of the records."""
    places = rows.mapInArrow(_places(span, token), "sig bigint, rec bigint, at bigint, off bigint, more bigint").join(shared, "sig", "left_semi")
    letters = F.encode(F.substring("_seq", (F.col("at") + 1).cast("int"), (F.col("more") + span).cast("int")), "utf-8")
    # rows of one rec may differ, so a place is good only where the letters give its signature
    cut = places.distinct().join(rows.distinct(), "rec").select("sig", "rec", "at", "off", letters.alias("ctx"))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ctx"):
            ctx, off, sig = batch.column("ctx").to_pylist(), batch.column("off").to_numpy(), batch.column("sig").to_numpy()
            text = np.frombuffer(b"|".join(ctx), np.uint8)
            got, centre, first, _ = compact_windows(text, span, token)
            begin = np.cumsum([0, *(len(c) + 1 for c in ctx)])[:-1]
            at = np.searchsorted(first, begin)
            at[at == len(first)] = 0
            whole = np.array([len(c) for c in ctx]) >= span
            ok = whole & (len(first) > 0)
            if ok.any():
                ok &= (first[at] == begin) & (got[at] == sig) & (centre[at] - begin == off)
            yield batch.filter(pa.array(ok))

    return cut.mapInArrow(right, "sig bigint, rec bigint, at bigint, off bigint, ctx binary")


#: Bytes of a piece of the filter.
PIECE = 1 << 16


def _filter(shared: DataFrame, size: int) -> bytes:
    """The filter of 1 << size bits, made in pieces side by side; the driver only puts the pieces together."""
    places = F.array(F.expr(f"sig & {(1 << size) - 1}"), F.expr(f"shiftrightunsigned(sig, 33) & {(1 << size) - 1}"))
    ones = shared.select(F.explode(places).alias("place")).select(F.expr(f"place div {8 * PIECE}").alias("piece"), F.expr(f"cast(place % {8 * PIECE} as int)").alias("bit"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(piece, kind="stable")
            edges = np.flatnonzero(np.append(True, piece[order][1:] != piece[order][:-1])) if len(order) else []
            for of in np.split(bit[order], edges[1:]) if len(order) else []:
                p = int(piece[order[edges[0]]])
                held.setdefault(p, np.zeros(PIECE, np.uint8))
                np.bitwise_or.at(held[p], of >> 3, (1 << (of & 7)).astype(np.uint8))
                edges = edges[1:]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["piece", "bits"])

    table = np.zeros(max(PIECE, 1 << (size - 3)), np.uint8)
    for r in ones.repartition("piece").mapInArrow(pieces, "piece bigint, bits binary").toLocalIterator():
        table[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["bits"], np.uint8)
    return table[: 1 << (size - 3)].tobytes()


def _fingerprints(ctx: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and two 64-bit fingerprints of every span of each context."""
    text = np.frombuffer(b"|".join(ctx), np.uint8)
    length = np.array([len(c) for c in ctx], np.int64)
    count = length - span + 1
    begin = np.cumsum(length + 1) - length - 1
    row = np.repeat(np.arange(len(ctx)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[row] + start
    prints = []
    for base, code in ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)):
        part = text.astype(np.uint64) * np.uint64(code)
        part ^= part >> np.uint64(29)
        total, done, size, power = None, 0, 1, base
        pieces = {}
        while size <= span:
            pieces[size] = (part, power)
            if 2 * size > span:
                break
            part = part[: len(part) - size] * np.uint64(power) + part[size:]
            power = power * power % (1 << 64)
            size *= 2
        for size in sorted(pieces, reverse=True):
            if span & size:
                piece, power = pieces[size]
                here = piece[at + done]
                total = here if total is None else total * np.uint64(power) + here
                done += size
        prints.append(total)
    return row, start, *prints


def _verify(span: int):
    """The shared spans of contexts that come ordered by signature, so many signatures at once as make COMPARED letters."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            for part in slices([batch], "ctx", most=COMPARED):
                held.append(part)
                size += part.column("ctx").nbytes
                if size > COMPARED:
                    t = pa.Table.from_batches(held).combine_chunks()
                    sig = t.column("sig").to_numpy()
                    cut = int(np.searchsorted(sig, sig[-1]))  # the last one may go on
                    if cut:
                        yield t.slice(0, cut)
                    held, size = t.slice(cut).to_batches(), t.slice(cut).column("ctx").nbytes
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(b for b in batches if b.num_rows):
            ctx = t.column("ctx").to_pylist()
            low, high, of = (t.column(c).to_numpy() for c in ("low", "high", "sig"))
            row, start, a, b = _fingerprints(ctx, span)
            order = np.lexsort((b, a))
            edge = np.ones(len(order), bool)
            edge[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            at = np.nonzero(edge)[0]
            own = row[order]
            both = np.minimum.reduceat(low[own], at) != np.maximum.reduceat(high[own], at)
            shared = np.zeros(len(order), bool)
            shared[order] = both[np.cumsum(edge) - 1]
            k = np.nonzero(shared)[0]
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]])
            s, e = k[new], k[np.append(new[1:], True)]
            cid = t.column("cid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(of[row[s]]), pa.array(cid[row[s]]), pa.array(start[s]), pa.array(start[e] + span)], names=["sig", "cid", "a", "b"])

    return go


def _exploded(span: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ctx", most=1_000_000):
            row, start, a, b = _fingerprints(batch.column("ctx").to_pylist(), span)
            pick = lambda name: pa.array(batch.column(name).to_numpy()[row])
            yield pa.RecordBatch.from_arrays([pick("sig"), pick("cid"), pa.array(start), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pick("low"), pick("high")], names=["sig", "cid", "a", "fa", "fb", "low", "high"])

    return go


def shared_spans(records: DataFrame, span: int = SPAN, token: int = TOKEN, hot: int = HOT_CONTEXTS) -> DataFrame:
    """The longest unbroken runs of shared positions of each record: rec, span_start, span_end.

    `records` has rec (bigint, the record's identity) and seq. A position is shared if it lies in a substring of
    `span` letters, only A, C, G, T, that also stands in a record with another rec; equal rows of one rec share
    nothing. Null and short sequences have no shared position, nor has a null rec. Other columns are ignored.

    1. Each record's compact windows give their signatures; a partial and a final aggregate keep those of more
       than one rec. 2. A filter of bounded size over them lets through, in a second scan, the windows worth a look, with
       their letters; if they are too many for it, windows are joined to them by signature, and then to the letters. 3. Equal contexts are collapsed, different ones with the same signature compared by 128-bit
       fingerprints of their spans. 4. What is found is joined back to the windows and merged for each record.
    No pairs are made. Copies collapse in the aggregates; a signature with very many different contexts is taken
    apart into its spans, which are aggregated like signatures.
    """
    spark = records.sparkSession
    rows = records.where(F.col("rec").isNotNull() & (F.length("seq") >= span)).select("rec", F.col("seq").alias("_seq"))
    signatures = rows.mapInArrow(_signatures(span, token), "sig bigint, rec bigint")
    spread = signatures.groupBy("sig").agg(F.min("rec").alias("low"), F.max("rec").alias("high")).where("low <> high").select("sig")
    spread = checkpointed(spread)
    size = max(LEAST_BITS, (16 * spread.count()).bit_length())
    if size <= MOST_BITS:
        shipped = spark.sparkContext.broadcast(_filter(spread, size))
        windows = rows.mapInArrow(_contexts(span, token, shipped), "sig bigint, rec bigint, at bigint, off bigint, ctx binary")
    else:
        windows = checkpointed(_by_join(rows, spread, span, token))
    windows = windows.withColumn("cid", F.xxhash64("off", "ctx"))
    distinct = windows.groupBy("sig", "cid").agg(F.first("ctx").alias("ctx"), F.min("rec").alias("low"), F.max("rec").alias("high"))
    distinct = checkpointed(distinct)
    crowded = distinct.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("sig")
    if crowded.isEmpty():
        found = distinct.repartition("sig").sortWithinPartitions("sig").mapInArrow(_verify(span), "sig bigint, cid bigint, a bigint, b bigint")
    else:
        calm = distinct.join(crowded, "sig", "left_anti")
        found = calm.repartition("sig").sortWithinPartitions("sig").mapInArrow(_verify(span), "sig bigint, cid bigint, a bigint, b bigint")
        parts = distinct.join(crowded, "sig", "left_semi").mapInArrow(_exploded(span), "sig bigint, cid bigint, a bigint, fa bigint, fb bigint, low bigint, high bigint")
        twice = parts.groupBy("fa", "fb").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("fa", "fb")
        found = found.unionByName(parts.join(twice, ["fa", "fb"]).select("sig", "cid", "a", (F.col("a") + span).alias("b")))
    spans = windows.select("sig", "cid", "rec", "at").join(found, ["sig", "cid"]).select("rec", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("b")).alias("e"))
    before = Window.partitionBy("rec").orderBy("s", "e")
    reach = F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(before))
    return runs.groupBy("rec", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select("rec", "span_start", "span_end")


def shared_between(tables: list[tuple[str, DataFrame, str, str]], span: int = SPAN) -> DataFrame:
    """shared_spans over several tables, each given as (kind, table, id column, sequence column): rec_kind, rec_id, span_start, span_end."""
    n = len(tables)
    rows = None
    for i, (_, df, id_col, seq_col) in enumerate(tables):
        part = df.select((F.col(id_col).cast("bigint") * n + i).alias("rec"), F.col(seq_col).alias("seq"))
        rows = part if rows is None else rows.unionByName(part)
    found = shared_spans(rows, span)
    kind = F.element_at(F.array(*[F.lit(t[0]) for t in tables]), (F.pmod("rec", F.lit(n)) + 1).cast("int"))
    return found.select(kind.alias("rec_kind"), F.expr(f"(rec - pmod(rec, {n})) div {n}").alias("rec_id"), "span_start", "span_end")
