import random
import re

import numpy as np
import pytest

from amplispark.llm import packing, similar, spans
from amplispark.llm.bpe import Bpe, encode, vocabulary
from amplispark.llm.packing import pack
from amplispark.llm.pieces import cuts, split_oversized
from amplispark.llm.sentences import sentences, split
from amplispark.llm.similar import similar_pairs
from amplispark.llm.spans import shared_spans


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choices(letters, k=n))


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], [rng.choice("ACGTN")], [s[i], rng.choice("ACGT")]])
    return "".join(s)


def family(rng, n):
    roots = [dna(rng, rng.randint(9, 400)) for _ in range(6)]
    out = []
    for _ in range(n):
        r = rng.choice(roots)
        out.append(rng.choice([r, mutate(rng, r, rng.randint(1, 8)), r[len(r) // 2 :] + r[: len(r) // 2], dna(rng, 50), r[:100].lower(), "ACGTACG", "A" * 60]))
    return out


@pytest.mark.parametrize("few, held", [(1 << 12, 1 << 19), (1, 1 << 19), (1, 10)])
def test_similar_pairs_against_brute_force(spark, monkeypatch, few, held):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "HELD", held)
    monkeypatch.setattr(similar, "COPIES", 3)
    rng = random.Random(5)
    long = dna(rng, 3000)
    seqs = family(rng, 160) + [long, mutate(rng, long, 60), "protein sequences " * 3, "some protein sequences " * 3] + ["Ω中文字符串测试用例" * 2, "Ω中文字符串测试用例" * 2 + "x", None, "", "AC"]
    rows = [(i, rng.choice(["k1", "k1", "k2", None]), s, "clash") for i, s in enumerate(seqs)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "pid bigint, k string, s string, key string")
    want = set()
    sets = {i: {s[j : j + 8] for j in range(len(s) - 7)} for i, k, s, _ in rows if s and len(s) >= 8 and k is not None}
    keys = {i: k for i, k, _, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and keys[a] == keys[b] and 3 * len(sets[a] & sets[b]) >= len(sets[a]) + len(sets[b]):
                want.add((a, b))
    got = [tuple(r) for r in similar_pairs(df, "pid", "k", "s").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100
    assert similar_pairs(df.limit(0), "pid", "k", "s").count() == 0


def parts_of(texts):
    row, small, row_o, odd = similar.shingles(texts)
    few, many = (np.bincount(r, minlength=len(texts)) for r in (row, row_o))
    owner, rank, place, _ = similar._merged(few, many, small, odd)
    return few + many, owner, rank, place


@pytest.mark.parametrize("deep", [1 << 18, 0])
def test_similar_sets_of_all_sizes(monkeypatch, deep):
    monkeypatch.setattr(similar, "DEEP", deep)
    rng = random.Random(15)
    for letters, t in (("ACGT", 0.5), ("ACGTn", 0.5), ("abcdefgh ", 0.8), ("AC", 0.3)):
        texts = []
        for size in (8, 9, 10, 12, 20, 40, 70, 150, 300, 700, 2500):
            base = dna(rng, size, letters)
            texts += [base, *(mutate(rng, base, rng.randint(1, 1 + size // 12)) for _ in range(4)), base[: size * 2 // 3], base[size // 2 :] + base[: size // 2]]
        texts = [x for x in texts if len(x) >= 8]
        sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in texts]
        want = {(j, i) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}
        got = {(min(a, b), max(a, b)) for u, v in similar.similar_sets(*parts_of(texts), t) for a, b in zip(u.tolist(), v.tolist())}
        assert want <= got and len(got) < 2 * len(want)


@pytest.mark.parametrize("deep", [1 << 18, 0])
def test_similar_sets_in_files(monkeypatch, deep):
    """As test_similar_sets_of_all_sizes, with fewer sets in memory than there are, of whole texts and of the parts in which they travel."""
    for name, value in (("DEEP", deep), ("HELD", 10), ("STEP", 7)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(19)
    for letters, t in (("ACGT", 0.5), ("ACGTn", 0.5), ("AC", 0.3)):
        texts = []
        for size in (9, 12, 20, 40, 70, 150, 300, 700):
            base = dna(rng, size, letters)
            texts += [base, *(mutate(rng, base, rng.randint(1, 1 + size // 12)) for _ in range(4)), base[: size * 2 // 3], base[size // 2 :] + base[: size // 2]]
        texts = [x for x in texts if len(x) >= 8]
        sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in texts]
        want = {(j, i) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}
        row, small, row_o, odd = similar.shingles(texts)
        every = np.bincount(row, minlength=len(texts)) + np.bincount(row_o, minlength=len(texts))
        packer = similar.zstandard.ZstdCompressor()
        got = {0: set(), 3: set()}
        for shift in got:
            for part in range(1 << shift):
                filed = similar._Sets()
                for lo in range(0, len(texts), 20):
                    a, b = ((r >= lo) & (r < lo + 20) & (p >> (16 - shift) == part) for r, p in ((row, small.astype(int)), (row_o, (odd >> np.uint64(48)).astype(int))))
                    n = min(20, len(texts) - lo)
                    if a.any() or b.any():
                        counts = [(np.bincount(r[k] - lo, minlength=n), x[k]) for r, x, k in ((row, small, a), (row_o, odd, b))]
                        filed.add(similar._blob(np.arange(lo, lo + n), every[lo : lo + n], *counts, packer))
                filed.map()
                for u, v in similar._similar_filed(filed, part, t, shift, None):
                    got[shift] |= {(min(a, b), max(a, b)) for a, b in zip(filed.ids[u].tolist(), filed.ids[v].tolist())}
                filed.close()
        assert want <= got[0] and len(got[0]) < 2 * len(want) and len(want) > 40
        assert {p for p in want if min(every[list(p)]) >= 32} <= got[3]


def test_keys_of_all_kinds_in_one_task(spark, monkeypatch):
    for name, value in (("FEW", 8), ("HELD", 50), ("STEP", 30)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(20)
    rows = [(i, k, s) for i, (k, s) in enumerate((k, s) for k, n in (("a", 4), ("b", 30), ("c", 150), ("d", 40), ("e", 120), ("f", 5)) for s in family(rng, n))]
    sets = {i: (k, {s[j : j + 8] for j in range(len(s) - 7)}) for i, k, s in rows if len(s) >= 8}
    want = {(a, b) for a, (k, x) in sets.items() for b, (l, y) in sets.items() if a < b and k == l and 3 * len(x & y) >= len(x) + len(y)}
    df = spark.createDataFrame(rows, "pid bigint, k string, s string")
    got = [tuple(r) for r in similar_pairs(df, "pid", "k", "s").collect()]
    assert set(got) == want and len(got) == len(want)


def test_sets_of_a_hot_key_travel_once(spark, monkeypatch):
    """As many bytes are shuffled for a key of many times the sets that a task may hold as for one that it may hold."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        spark.range(100, numPartitions=4).count()  # what the tasks before have told is now known
        sc.listenerBus().waitUntilEmpty()
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    rng = np.random.default_rng(21)
    rows = [(i, "k", "".join(x)) for i, x in enumerate(np.array(list("ACGT"))[rng.integers(0, 4, (2000, 260))])]
    df = spark.createDataFrame(rows, "pid bigint, k string, s string")
    monkeypatch.setattr(similar, "FEW", 1)
    took = []
    for held in (1 << 19, 500):
        monkeypatch.setattr(similar, "HELD", held)
        before = shuffled()
        assert similar_pairs(df, "pid", "k", "s").count() == 0
        took.append(shuffled() - before)
    assert took[0] > 2000 * 200 and took[1] < 1.2 * took[0]


def test_sets_that_are_similar_in_part_by_a_single_token():
    """One wider part is similar by a token alone, the other has a similar half but isn't similar itself; together the sets just are."""
    one = [(7, 0)] + [(100 + i, 2 << 14) for i in range(15)] + [(200 + i, 3 << 14) for i in range(16)]
    two = [(7, 0)] + [(100 + i, 2 << 14) for i in (*range(10), *range(30, 35))] + [(200 + i, 3 << 14) for i in (*range(11), *range(30, 37))]
    a, b = ({x for x, _ in s} for s in (one, two))
    assert 3 * len(a & b) == len(a) + len(b)
    order, place = (np.array([x[k] for x in one + two]) for k in (0, 1))
    owner = np.repeat([0, 1], [len(one), len(two)])
    assert any(len(u) for u, _ in similar.similar_sets(np.bincount(owner), owner, order.astype(np.uint32), place.astype(np.uint16)))


def test_answers_of_near_sets_are_derived():
    rng = random.Random(16)
    base = dna(rng, 1000)
    seen = {}
    pairs = [p for p in similar.similar_sets(*parts_of([base, *(mutate(rng, base, 1) for _ in range(100))]), seen=seen)]
    assert seen["computed"] < seen["parts"] / 3
    assert len({(min(a, b), max(a, b)) for u, v in pairs for a, b in zip(u.tolist(), v.tolist())}) == 101 * 100 // 2


def test_visits_of_one_key_grow_slowly():
    rng = np.random.default_rng(17)
    computed = []
    for n in (2000, 4000):
        texts = ["".join(x) for x in np.array(list("ACGT"))[rng.integers(0, 4, (n, 260))]]
        seen = {}
        assert sum(len(u) for u, _ in similar.similar_sets(*parts_of(texts), seen=seen)) == 0
        computed.append(seen["visits"])
    assert computed[1] < 6 * computed[0] and computed[1] < 4000 * 4000 / 2 * 0.1


def test_signatures_are_the_same_in_texts_of_any_length(monkeypatch):
    rng = random.Random(18)
    shared = dna(rng, 200)
    of = []
    for before in (0, 100, 70_000):
        text = np.frombuffer((dna(rng, before) + shared + dna(rng, before)).encode(), np.uint8)
        sig, centre, first, last = spans.compact_windows(text)
        inside = (first <= before + 120) & (last >= before)
        of.append([(s, c - before, max(a, before) - before, min(b, before + 120) - before) for s, c, a, b in zip(sig[inside], centre[inside], first[inside], last[inside])])
    assert of[0] == of[1] == of[2]
    text = np.frombuffer(dna(rng, 3000).encode(), np.uint8)
    want = {s: (x, c) for x, c, a, b in zip(*spans.compact_windows(text)) for s in range(a, b + 1)}
    monkeypatch.setattr(spans, "CHUNK", 500)
    assert {s: (x, c) for x, c, a, b in zip(*spans.compact_windows(text)) for s in range(a, b + 1)} == want and len(want) == 2921


@pytest.mark.parametrize("hot, bits, compared", [(20_000, 28, 1 << 22), (0, 28, 1 << 22), (20_000, 1, 300)])
def test_shared_spans_against_brute_force(spark, monkeypatch, hot, bits, compared):
    monkeypatch.setattr(spans, "MOST_BITS", bits)
    monkeypatch.setattr(spans, "COMPARED", compared)
    rng = random.Random(6)
    roots = [dna(rng, 500) for _ in range(4)]
    seqs = [None, "", "ACGT", "A" * 200, "A" * 90, roots[0], roots[0], roots[0][:79], roots[1][:300] + "N" + roots[1][301:], "é" + roots[1], (roots[2][:90] * 2)]
    seqs += [dna(rng, 60) + r[a : a + rng.randint(70, 200)] + dna(rng, 40) for r in roots for a in rng.choices(range(300), k=5)]
    rows = [(i, s, 0) for i, s in enumerate(seqs)] + [(5, roots[0], 0), (None, roots[0], 0)]
    df = spark.createDataFrame(rows, "rec bigint, seq string, sig bigint")
    at = {}
    for i, s in enumerate(seqs):
        for m in re.finditer("[ACGT]{80,}", s or ""):
            for j in range(m.start(), m.end() - 79):
                at.setdefault(s[j : j + 80], set()).add(i)
    want = set()
    for i, s in enumerate(seqs):
        on = np.zeros(len(s or "") + 2, int)
        for j in range(len(s or "") - 79):
            if len(at.get(s[j : j + 80], ())) > 1:
                on[j + 1 : j + 81] = 1
        edge = np.diff(on)
        want |= set(zip([i] * len(edge), np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))
    got = [tuple(r) for r in shared_spans(df, hot=hot).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10
    assert shared_spans(df.limit(0)).count() == 0


def test_compact_windows_hold_each_span_once():
    rng = random.Random(7)
    text = np.frombuffer((dna(rng, 700) + "N" + dna(rng, 79) + "N" + "A" * 100).encode(), np.uint8)
    _, centre, first, last = spans.compact_windows(text)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == [*range(621), *range(781, 802)]
    assert all(a + 56 >= c >= b for a, b, c in zip(first, last, centre))


def plain_cuts(s, limit=2000, least=1000, overlap=100):
    ends = [m.end() for m in re.finditer(r"[Nn]{10}(?=[^Nn])", s)]
    out, a = [], 0
    while len(s) - a > limit:
        e = max((b for b in ends if a + least <= b <= a + limit), default=a + limit)
        out.append((a, e))
        a = e - overlap
    return out + [(a, len(s))]


def test_pieces_against_plain_loop(spark):
    rng = random.Random(8)
    seqs = [None, "", "A" * 2000, "A" * 2001, "N" * 5000, "A" * 90_000]
    for _ in range(60):
        parts = [dna(rng, rng.choice([5, 300, 1500, 9000])) + rng.choice("Nn") * rng.choice([3, 10, 40]) for _ in range(rng.randint(1, 12))]
        seqs.append("".join(parts) + "A" * rng.choice([0, 1, 3000]))
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(seqs)], "i bigint, s string, rec_id string")
    got = {}
    for r in split_oversized(df, "i", "s", "seq", with_text=True).collect():
        got.setdefault(r["rec_id"], {})[r["piece_no"]] = (r["piece_start"], r["piece_end"])
        assert r["piece"] == seqs[r["rec_id"]][r["piece_start"] : r["piece_end"]]
    want = {i: dict(enumerate(plain_cuts(s))) for i, s in enumerate(seqs) if s and len(s) > 2000}
    assert got == want
    assert split_oversized(df.limit(0), "i", "s", "seq").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "i", "s", "seq", least=50)
    assert len(cuts(10_000_000, np.zeros(0, np.int64))) == 5264


TEXTS = [None, "", " ", "\n\n", "Hello world's <|endoftext|> don't", "ACGT" * 3000, "a" * 3000, "ภาษาไทย 中文 👩‍🔬⁠\x1c", "x\r\n\r\n  y", "Der 2. Lauf", "Der 2. Lauf"]


def test_encoding_against_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choices("abé 中\n1.,' ก", k=rng.randint(1, 80))) for _ in range(300)]
    lib = Tokenizer.from_file(vocabulary())
    lib.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in encode(df, counts=True).collect()} == {i: len(v) for i, v in got.items()}
    assert encode(df.limit(0)).count() == 0


def test_both_merges_agree():
    bpe = Bpe(vocabulary())
    rng = random.Random(10)
    pieces = ["".join(rng.choices("acgtACGTth e中", k=rng.randint(1, 300))) for _ in range(200)]
    assert bpe.encode_pieces(pieces) == [bpe.merge_one(bpe.of_byte[np.frombuffer(p.encode(), np.uint8)].tolist()) if len(p.encode()) > 1 else bpe.encode_pieces([p])[0] for p in pieces]


def test_packing(spark):
    rng = random.Random(11)
    words = ["gel", "lane", "primer", "band", "plasmid", "цикл", "样品"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, "again", 0)], "doc_id bigint, text string, slot bigint")
    sizes = {}
    for r in encode(df, counts=True).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_tokens"]
    rows = pack(df, capacity=256).collect()
    boxes, own = {}, {}
    for r in rows:
        boxes[r["container_id"]] = boxes.get(r["container_id"], 0) + r["token_end"] - r["token_start"]
        own[r["doc_id"]] = own.get(r["doc_id"], 0) + r["token_end"] - r["token_start"]
    assert own == sizes and max(boxes.values()) <= 256
    assert len(boxes) <= 1.03 * sum(sizes.values()) / 256
    whole = {r["doc_id"] for r in rows if r["piece_no"] == 0 and r["token_end"] - r["token_start"] == sizes[r["doc_id"]]}
    assert all(d in whole for d, n in sizes.items() if n <= 256 and d != 3)
    assert pack(df.limit(0)).count() == 0


def test_packing_over_shards(spark, monkeypatch):
    rng = random.Random(12)
    topics = [["".join(rng.choices("abcdefgh", k=7)) for _ in range(30)] for _ in range(8)]
    texts = [" ".join(rng.choices(topics[i % 8], k=60)) for i in range(400)]
    texts += texts[:40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(packing, "SHARD_BYTES", 20_000)
    given = []
    monkeypatch.setattr(packing, "_pack", lambda *a, run=packing._pack: given.append(a) or run(*a))
    rows = pack(df, capacity=1024).collect()
    assert len({r["container_id"] >> 32 for r in rows}) >= 8
    # the statistics are those of the corpus, whatever the shards
    assert given == [(1024, len(texts), sum(len(packing._terms(t)) for t in texts) / len(texts))]
    at = {r["doc_id"]: r["container_id"] for r in rows if r["piece_no"] == 0}
    shard = {d: c >> 32 for d, c in at.items()}
    assert sorted(at) == list(range(len(texts)))
    # two texts of a topic (copies among them) meet in a shard far more often than by chance
    near = [(i, j) for i in range(440) for j in range(i) if i % 8 == j % 8]
    far = [(i, j) for i in range(440) for j in range(i) if i % 8 != j % 8]
    met = [sum(shard[i] == shard[j] for i, j in pairs) / len(pairs) for pairs in (near, far)]
    assert met[0] > 3 * met[1]
    assert sum(shard[i] == shard[400 + i] for i in range(40)) >= 30


def test_index_of_a_shard_scores_as_that_of_the_corpus():
    ids = [np.array([1, 5, 9]), np.array([5, 9]), np.array([2, 9]), np.array([1, 2])]
    times = [np.array([2, 1, 1]), np.array([1, 3]), np.array([1, 1]), np.array([4, 1])]
    known, df, mean = np.array([1, 2, 5, 9]), np.array([2, 2, 2, 3]), sum(t.sum() for t in times) / 4
    whole = packing.Index(ids, times, known, df, 4, mean).scores(0)
    part = packing.Index(ids[:2], times[:2], known[[0, 2, 3]], df[[0, 2, 3]], 4, mean).scores(0)
    assert np.allclose(part, whole[:2]) and whole[3] > 0


CASES = {
    "en": ["It fell to 8.18… but stayed.", "Dr. A. Nobel saw 3.5 µl (see Fig. 4).", "“Is it circular?” asked the reviewer.", "The U.S. kit, e.g. for gels, etc. was fine...", "Really?!", "(It was not.)", "qPCR gave 4.", "Then \"Run it!\" was said."],
    "de": ["Am 3. Mai lief z. B. Nr. 4 gut.", "Der 2. Lauf ergab 5, vgl. Abb. 4.", "„Das Gel ist leer“, sagte sie."],
    "ru": ["«Где продукт?» — спросила группа.", "Длина 29 п. н. в среднем, т. е. мало.", "См. рис. 5."],
    "el": ["Γιατί λείπει το αρχείο a.fasta;", "Φάνηκε μία ζώνη· τίποτε άλλο."],
    "hi": ["“जेल खाली है।” सहायक ने कहा।", "डॉ. Meba ने देखा।"],
}


def test_sentences_of_cased_and_spaced_scripts():
    for parts in CASES.values():
        for gap in (" ", "\n", "\n \n", "\r\n\r\n"):
            text = gap.join(parts)
            assert [text[a:b] for a, b in split([text])[0]] == parts


def test_sentences_of_texts_unlike_the_samples():
    for parts in (
        ["Capt. Lee and Lt. Roy met Gov. Hale.", "They left."], ["Approx. 5 min later it stopped.", "Fine."], ["Zob. rys. 3.", "Koniec."], ["Zie bijv. Piet en dhr. Jansen.", "Klaar."],
        ["It weighs 5 g.", "The rest is gone."], ["J. Smith came.", "A. B. Cole left."], ["Es fiel auf 3 °C.", "Dann stieg es."], ["El Lic. Ruiz y la Dra. Paz salieron.", "Nadie más."],
    ):
        text = " ".join(parts)
        assert [text[a:b] for a, b in split([text])[0]] == parts


def test_sentences_without_spaces_and_units():
    zh = ["“凝胶是空的。”操作员说。", "他们问：“长度够吗？”", "真的吗？！", "共9.5管。"]
    ja = ["「長さは？」と聞かれた。", "原点をまたぐ…が一致する。"]
    for parts in (zh, ja):
        text = "".join(parts)
        assert [text[a:b] for a, b in split([text])[0]] == parts
    text = "ก่อน Lisvi ถูก หลัง\n\n# Note. One\n\n- a. B is.\n- b! C\n\n>x y. Z\nACGT\n\nq_1\t9.1\t8.2\n\n1. One. Two\n2. Three"
    assert [text[a:b] for a, b in split([text])[0]] == ["ก่อน Lisvi ถูก", "หลัง", "# Note. One", "- a. B is.", "- b! C", ">x y. Z\nACGT", "q_1\t9.1\t8.2", "1. One. Two", "2. Three"]


def test_sentences_of_a_table(spark):
    long = "One went. " * 5000
    df = spark.createDataFrame([(0, None, 1), (1, "", 1), (2, " \n", 1), (3, "Ab ok. Cd ok.", 1), (3, "Ab ok. Cd ok.", 1), (4, long, 1)], "doc_id bigint, text string, sent_start bigint")
    rows = sentences(df, with_text=True).collect()
    assert sorted((r["doc_id"], r["sentence"]) for r in rows if r["doc_id"] < 4) == [(3, "Ab ok.")] * 2 + [(3, "Cd ok.")] * 2
    assert sum(r["doc_id"] == 4 for r in rows) == 5000
    assert sentences(df.limit(0)).count() == 0
