import random

import pytest

from amplispark.config import MatchConfig, PcrConfig
from amplispark.functions.dna import rc_text
from amplispark.operators import kernel
from amplispark.operators.kernel import CODES, find_forward_matches, find_matches, find_reverse_matches


def c(k, **more):
    return MatchConfig(k, **more)


def plain_ends(primer, text, k):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(primer, 1):
        new = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + ((CODES[p] & CODES.get(t, 0)) == 0), row[j] + 1, new[j - 1] + 1)
        row = new
    row = [99] + [x if x <= k else 99 for x in row[1:]]
    out, j = [], 1
    while j <= len(text):
        e = j
        while e < len(text) and row[e + 1] == row[j]:
            e += 1
        if row[j] <= k and row[j - 1] > row[j] and (e == len(text) or row[e + 1] > row[j]):
            out.append((e, row[j]))
        j = e + 1
    return out


def test_ends_by_pieces_are_those_of_the_whole_matrix(monkeypatch):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(rng.choice(["ACGT", "ACGTNRY-", "AC"]), k=rng.randint(0, 400)))
        pattern = "".join(rng.choices(rng.choice(["ACGT", "ACGTRYN", "A"]), k=rng.randint(1, 26)))
        if rng.random() < 0.7 and len(text) > 40:
            at = rng.randrange(len(text) - 30)
            pattern = text[at : at + rng.randint(8, 24)].replace("-", "A")
        k, subset = rng.randint(0, 3), rng.random() < 0.3
        bits, letters = kernel.to_bits(text), kernel.to_bits(pattern)
        at, cost = kernel.ends_within(bits, letters, k, subset)
        whole = kernel.end_costs(bits, letters, k, subset) if text else bits
        assert at.tolist() == [i for i, x in enumerate(whole.tolist()) if x <= k] and cost.tolist() == [x for x in whole.tolist() if x <= k]
    text, config = "ACGTTGCAAC" * 40, c(2)
    want = find_matches("TTGCAACACGTTG", text, config)
    monkeypatch.setattr(kernel, "TILE", 37)
    assert find_matches("TTGCAACACGTTG", text, config) == want and len(want) > 30


def test_known_matches():
    (m,) = find_matches("ACGT", "AAAACGTAAA", c(0))
    assert (m.start, m.end, m.edit_distance, m.cigar, m.identity) == (3, 7, 0, "4=", 1.0)
    assert len(find_matches("ACGT", "AAAACTTAAA", c(1, min_identity=0.5))) == 1
    assert find_matches("ACGTACGT", "AAAACTTACTTAAA", c(2, min_identity=0.75))
    assert len(find_matches("AAAA", "A" * 12, c(0))) == 1
    assert find_matches("", "ACGT") == [] and find_matches("ACGT", "") == []
    assert find_matches("NNNN", "XXXX", c(0)) == []
    assert find_forward_matches("ACGT", "AAAACGTAAA", c(0)) == find_reverse_matches("ACGT", "AAAACGTAAA", c(0)) == find_matches("ACGT", "AAAACGTAAA", c(0))


def test_ends_against_plain_recurrence():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choices("ACGTRYN", k=rng.randint(3, 12)))
        t = "".join(rng.choices("ACGTN", k=rng.randint(1, 60)))
        k = rng.randint(0, 2)
        assert [(m.end, m.edit_distance) for m in find_matches(p, t, c(k))] == plain_ends(p, t, k)


def test_alignment_costs_its_edits():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choices("ACGT", k=10))
        t = "".join(rng.choices("ACGT", k=50))
        for m in find_matches(p, t, c(3)):
            runs = [(int(n), o) for n, o in __import__("re").findall(r"(\d+)([=XID])", m.cigar)]
            assert sum(n for n, o in runs if o != "=") == m.edit_distance
            assert sum(n for n, o in runs if o != "I") == m.end - m.start
            assert sum(n for n, o in runs if o != "D") == len(p)


def test_reverse_strand_and_options():
    both = find_matches("AACCG", "TTAACCGTTCGGTTAA", c(0, search_rc=True))
    assert [(m.strand, m.start) for m in both] == [("+", 2), ("-", 9)]
    assert rc_text("RYSWKM") == "KMWSRY" and rc_text("ATCG") == "CGAT" and rc_text("AX") == "NT"
    assert find_matches("ACGT", "ANGT", c(0)) and not find_matches("ACGT", "ANGT", c(0, text_ambiguity="subset"))
    assert len(find_matches("AAAA", "A" * 8, c(0, report="all"))) == 5


def test_settings_are_checked():
    with pytest.raises(ValueError):
        PcrConfig(min_len=10, max_len=5)
    with pytest.raises(ValueError):
        PcrConfig(max_n_fraction=1.5)
    with pytest.raises(ValueError):
        MatchConfig(min_identity=1.1)
