import pytest

from amplispark.config import MatchConfig, PcrConfig
from amplispark.functions.dna import rc_text
from amplispark.operators.finalize import count_by, finalize, summarize
from amplispark.operators.products import matches, pair_products, pool_products
from amplispark.sources.primers import Primer, PrimerPair
from amplispark.sources.writers import fasta_text, tsv_text

F16, R16 = "AGAGTTTGATCATGGCTCAG", "TACGGTTACCTTGTTACGACTT"
FILL = "GCGCGCTA"


def fill(n):
    return (FILL * (n // 8 + 1))[:n]


def recs(spark, *seqs):
    rows = [(i, s[0] if isinstance(s, tuple) else f"ref{i} x", "f.fa", s[1] if isinstance(s, tuple) else s) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "rec_id bigint, header string, source_file string, sequence string")


def run(spark, primers, *seqs, **config):
    match = MatchConfig(config.pop("k", 0), search_rc=config.pop("rc", False))
    return pair_products(recs(spark, *seqs), [PrimerPair("p", *primers)], PcrConfig(match, **config))


def spans(df):
    return sorted((r["original_start"], r["original_end"], r["full_length"], r["strand"], r["is_circular_wrap"]) for r in df.collect())


def amplicon(before, inner, after):
    return fill(before) + F16 + fill(inner) + rc_text(R16) + fill(after)


def test_one_and_two_copies(spark):
    assert spans(run(spark, (F16, R16), amplicon(100, 1423, 115))) == [(100, 1565, 1465, "+", False)]
    two = amplicon(100, 1423, 1500) + F16 + fill(1423) + rc_text(R16) + fill(10)
    assert [s[:2] for s in spans(run(spark, (F16, R16), two, max_len=2000))] == [(100, 1565), (3065, 4530)]


def test_trimmed_and_bounds(spark):
    (r,) = run(spark, (F16, R16), amplicon(100, 1423, 115), trim_primers=True).collect()
    assert (len(r["sequence"]), r["full_length"]) == (1423, 1465)
    seq = "AAAACGTAAAATGCATTTT"
    assert {r["full_length"] for r in run(spark, ("ACGT", "TGCA"), seq, min_len=12, max_len=12).collect()} == {12}
    assert run(spark, ("ACGT", "TGCA"), "AAAACGTTGCATTTT", min_len=1, trim_primers=True).count() == 0
    assert run(spark, ("ACGT", "TGCA"), "AAAACGTTGCATTTT", min_len=1).count() > 0
    assert run(spark, ("ACGT", "ACGT"), "ACGTNNNNACGT", min_len=4, max_n_fraction=0.33).count() == 0


def test_reverse_strand_and_circular(spark):
    seq = "A" * 200 + "GGAATTCCGGAA"[:12] + "A" * 108 + rc_text("CCTTAAGGCCTT") + "A" * 100
    back = [r for r in run(spark, ("CCTTAAGGCCTT", rc_text("GGAATTCCGGAA")), rc_text(seq), rc=True, min_len=10).collect()]
    for r in back:
        if r["strand"] == "-":
            whole = rc_text(seq)
            assert rc_text(whole[r["original_start"] : r["original_end"]]) == r["sequence"]
    ring = list("A" * 500)
    ring[30:44] = rc_text("AATTCCGGAATTCC")
    ring[450:464] = "GCTAGCTAGCTAAC"
    wraps = [r for r in run(spark, ("GCTAGCTAGCTAAC", "AATTCCGGAATTCC"), "".join(ring), circular=True, min_len=10, max_len=200).collect() if r["is_circular_wrap"]]
    assert wraps and wraps[0]["full_length"] == 94 and wraps[0]["sequence"].startswith("GCTAGCTAGCTAAC")
    assert run(spark, ("ACGT", "ACGT"), "ACGTACGT", circular=True, min_len=1, max_len=1000).count() > 0


def test_pool(spark):
    config = PcrConfig(MatchConfig(0), 8, 200)
    pool = [Primer("p1", "AAAA"), Primer("p2", "CCCC")]
    names = {r["primer_name"] for r in pool_products(recs(spark, "AAAAGTAGTGGGG"), pool, config).collect()}
    assert names == {"p1+p2"}
    one = [Primer("p1", "AAAA")]
    assert pool_products(recs(spark, "AAAAGTAGTTTTT"), one, config).count() == 0
    assert {r["primer_name"] for r in pool_products(recs(spark, "AAAAGTAGTTTTT"), one, config, True).collect()} == {"p1+p1"}
    both = pool_products(recs(spark, "AAAAGTAGTGGGGNNNNCCCCGTAGTTTTT"), pool, PcrConfig(MatchConfig(0), 8, 300))
    assert {"p1+p2", "p2+p1"} <= {r["primer_name"] for r in both.collect()}


def test_edge_rows(spark):
    df = recs(spark, ("h", None), ("h", ""), (None, amplicon(10, 50, 10)), ("x", amplicon(10, 50, 10)), ("x", amplicon(10, 50, 10)))
    found = pair_products(df, [PrimerPair("p", F16, R16), PrimerPair(None, F16, R16), PrimerPair("q", "", R16)], PcrConfig(MatchConfig(0)))
    assert found.count() == 6
    assert pair_products(df.limit(0), [PrimerPair("p", F16, R16)]).count() == 0
    assert matches(df, [Primer("p", F16)], MatchConfig(0)).count() == 3


def test_dedup_numbers_and_text(spark):
    df = recs(spark, ("r1 d", amplicon(10, 50, 10)), ("r1 d", amplicon(30, 50, 10)), ("r2", amplicon(10, 50, 10)))
    found = run(spark, (F16, R16), *[("r1 d", amplicon(10, 50, 10)), ("r1 d", amplicon(30, 50, 10)), ("r2", amplicon(10, 50, 10))])
    assert sorted((r["reference_header"], r["rec_id"], r["case_number"]) for r in finalize(found).collect()) == [("r1 d", 0, 1), ("r1 d", 1, 2), ("r2", 2, 1)]
    kept = finalize(found, remove_duplicates=True)
    assert sorted((r["reference_header"], r["rec_id"], r["case_number"]) for r in kept.collect()) == [("r1 d", 0, 1), ("r2", 2, 1)]
    text = sorted(r["value"] for r in fasta_text(kept).collect())
    assert text[0].startswith(">r1:p:1\tpos=10-102\tstrand=+\tlen=92\n" + F16)
    assert [len(x) for x in text[0].split("\n")[1:]] == [80, 12]
    row = sorted(r["value"] for r in tsv_text(kept).collect())[0].split("\t")
    assert len(row) == 19 and row[:6] == ["r1:p:1", "r1 d", "f.fa", "p", "92", "92"] and row[9:11] == ["1.0000", "20="]
    s = summarize(finalize(found), df.count(), 1)
    assert s.products_per_reference == [("r1 d", 2), ("r2", 1)] and s.total_products == 3
    assert [r["n_products"] for r in count_by(found, "primer_name").collect()] == [3]


@pytest.mark.parametrize("pool", [False, True])
def test_numbers_follow_a_total_order(spark, pool):
    seq = fill(20) + F16 + fill(60) + rc_text(R16) + fill(20)
    df = recs(spark, *[("same", seq)] * 4)
    if pool:
        found = pool_products(df, [Primer("a", F16), Primer("b", R16)], PcrConfig(MatchConfig(0, search_rc=True)))
    else:
        found = pair_products(df, [PrimerPair("a", F16, R16), PrimerPair("b", R16, F16)], PcrConfig(MatchConfig(0, search_rc=True)))
    got = [(r["rec_id"], r["strand"], r["primer_name"]) for r in finalize(found, pool=pool).orderBy("case_number").collect()]
    assert len(got) == 8 and [g[0] for g in got] == sorted(g[0] for g in got)


def test_numbering_does_not_search_again(spark):
    found = run(spark, (F16, R16), amplicon(10, 50, 10), amplicon(30, 50, 10))
    for distinct in (False, True):
        out = finalize(found, distinct)
        assert out.count() == 2
        assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_searches_with_edits_against_sql(spark):
    """Matches, pairs and pools with edits, both strands, circular records and numbers on the smallest tables."""
    import duckdb

    from amplispark.plans import pcr

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("sequences", "primers", "pool_primers"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("match_approx", "match_rc_strand", "pair_approx", "pair_circular", "pool_rc_strand", "pcr_numbered"):
        query, sql = pcr.QUERIES[name]
        df = query(spark, sf)
        names = ", ".join(f'"{c}"' for c in df.columns)
        got = sorted(tuple(map(str, r)) for r in df.collect())
        assert got and got == sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {names} FROM ({sql})").fetchall()), name


def test_long_records_in_tiles_give_the_same(spark, monkeypatch):
    from amplispark.operators import products
    from amplispark.plans import pcr

    sf = "/root/testdata/sf0.001"
    for name in ("match_rc_strand", "pair_approx", "pair_rc_strand", "pair_circular", "pool_circular", "pool_rc_strand", "pair_n_filter"):
        query = pcr.QUERIES[name][0]
        monkeypatch.setattr(products, "TILE_LETTERS", 1 << 22)
        want = sorted(map(repr, query(spark, sf).collect()))
        for tile, halo in ((700, 300), (150, 400)):
            monkeypatch.setattr(products, "TILE_LETTERS", tile)
            monkeypatch.setattr(products, "HALO", halo)
            assert sorted(map(repr, query(spark, sf).collect())) == want, (name, tile)
    df = recs(spark, fill(50_000))
    assert products._tiled(df, ("+", "-"), 100).count() == 2 * -(-50_000 // 150)


def test_primers_in_runs_give_the_same(spark):
    from amplispark.operators.products import pair_products_of, pool_products_of
    from amplispark.sources.primers import pairs_of, pool_of

    sf = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{sf}/sequences.parquet")
    df = recs(spark, *[(r["header"], r["sequence"]) for r in t.collect() if r["sequence"]])
    pairs, pool = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("primers", "pool_primers"))
    config = PcrConfig(MatchConfig(1), 50, 2000)
    want = sorted(map(repr, pair_products(df, pairs_of(pairs), config).collect()))
    assert want and sorted(map(repr, pair_products_of(df, pairs, config, most=20).collect())) == want
    for same in (False, True):
        want = sorted(map(repr, pool_products(df, pool_of(pool), config, same).collect()))
        assert want and sorted(map(repr, pool_products_of(df, pool, config, same, most=15).collect())) == want
    assert pair_products_of(df, pairs.limit(0), config).count() == 0 and pool_products_of(df, pool.limit(0), config).count() == 0


def test_length_bounds_against_sql(spark):
    """The query pair_len_filter with bounds of its own on both sides, which those of pair_linear are not."""
    import duckdb

    from amplispark.plans import pcr

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("sequences", "primers", "pool_primers"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bounds = {}
    for low, high in ((50, 2000), (150, 2000), (50, 400), (150, 400)):
        query, sql = pcr._pair(min_len=low, max_len=high)
        df = query(spark, sf)
        got = sorted(tuple(map(str, r)) for r in df.collect())
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert got == sorted(tuple(map(str, r)) for r in want)
        bounds[low, high] = len(got)
    assert bounds[150, 400] < min(bounds[150, 2000], bounds[50, 400]) and max(bounds[150, 2000], bounds[50, 400]) < bounds[50, 2000]
