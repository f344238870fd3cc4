import gzip

import pytest

from amplispark import cli
from amplispark.errors import CsvFormat, DecompressionLimitExceeded, LineTooLong, OutputDirMissing
from amplispark.functions import dna
from amplispark.functions.dna import rc_text
from amplispark.operators.finalize import RunSummary
from amplispark.operators.udtf import register as register_udtf
from amplispark.sources.files import chunks, detect_format, expand_inputs, is_bgzf, lines
from amplispark.sources.formats import fasta, genbank, parser_name
from amplispark.sources.primers import PrimerPair, parse_pool_primers, parse_primers, validate_iupac_sequence
from amplispark.sources.seqfile import read_records
from amplispark.sources.writers import check_writable

GB = """preamble
LOCUS       AB1          12 bp    DNA     circular
DEFINITION  first line
            second line
ACCESSION   AB000001 X
FEATURES             Location
     gene            1..2
ORIGIN
        1 acgtac gtacgt
//
LOCUS       NOSEQ
ORIGIN
//
LOCUS       AB2          4 bp    DNA     linear
ORIGIN
        1 acgt
"""


def test_formats():
    names = {"a.fa": "fasta", "a.FASTA.GZ": "fasta", "x.frn": "fasta", "b.gbff.gz": "genbank", "c.txt": None, "fa": None, ".fa": None}
    assert {n: detect_format(n) for n in names} == names
    text = b"junk\n>a one\r\nAC\r\ngt\r\n>b\n>c\nN"
    assert list(fasta(lines([text]))) == [("a", "ACGT"), ("b", ""), ("c", "N")]
    assert next(fasta(lines([text]), full_header=True))[0] == "a one"
    assert list(fasta(lines([b"ACGT\nACGT\n"]))) == []
    r = list(genbank(lines([GB.encode()])))
    assert [(x.name, x.accession, x.definition, x.is_circular, x.seq, x.complete) for x in r] == [("AB1", "AB000001", "first line second line", True, "acgtacgtacgt", True), ("NOSEQ", None, None, False, "", True), ("AB2", None, None, False, "acgt", False)]
    with pytest.raises(LineTooLong):
        list(lines([b"x" * 20], 10))


def test_primers(tmp_path):
    assert parse_primers("a:acgtacgtac:ACGTACGTAC; ;b:AC:GT") == [PrimerPair("a", "ACGTACGTAC", "ACGTACGTAC"), PrimerPair("b", "AC", "GT")]
    assert [p.name for p in parse_pool_primers("x:ACGT;y:RYN")] == ["x", "y"]
    for bad in ("a:b", "", "a::AC", "a:ACU:AC"):
        with pytest.raises(CsvFormat):
            parse_primers(bad)
    (tmp_path / "p.csv").write_text("name,forward,reverse,more\n 16S , acg ,TTT,x\n")
    assert parse_primers(str(tmp_path / "p.csv")) == [PrimerPair("16S", "ACG", "TTT")]
    (tmp_path / "bad.csv").write_text("name,forward\nx,ACG\n")
    with pytest.raises(CsvFormat, match="columns"):
        parse_primers(str(tmp_path / "bad.csv"))
    with pytest.raises(CsvFormat, match="'U' at position 3"):
        validate_iupac_sequence("acu", "n", "forward")


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 x\nACGT\n>r2\nGG\nTT\n")
    with gzip.open(tmp_path / "b.fa.gz", "wb") as f:
        f.write(b">z\nAC\n")
    (tmp_path / "c.gb").write_text(GB)
    (tmp_path / "d.txt").write_text("x")
    paths = expand_inputs([f"{tmp_path}/*", f"{tmp_path}/a.fasta,"])
    assert [p.rpartition("/")[2] for p in paths] == ["a.fasta", "b.fa.gz", "c.gb"]
    got = [(r["header"], r["sequence"]) for r in read_records(spark, f"{tmp_path}/*").orderBy("rec_id").collect()]
    assert got == [("r1", "ACGT"), ("r2", "GGTT"), ("z", "AC"), ("AB1", "ACGTACGTACGT"), ("AB2", "ACGT")]
    with pytest.raises(FileNotFoundError):
        expand_inputs(str(tmp_path / "none.fa"))
    with pytest.raises(DecompressionLimitExceeded):
        list(chunks(str(tmp_path / "b.fa.gz"), 5))
    assert b"".join(chunks(str(tmp_path / "b.fa.gz"), 6)) == b">z\nAC\n"
    assert not is_bgzf(str(tmp_path / "b.fa.gz"))


def test_files_by_uri(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 x\nAC\n>r2\nGG\n")
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">r3\nTT\n"))
    (tmp_path / "c.txt").write_text("no")
    rows = read_records(spark, f"file://{tmp_path}/*.fa*").orderBy("rec_id").collect()
    assert [(r["header"], r["sequence"]) for r in rows] == [("r1", "AC"), ("r2", "GG"), ("r3", "TT")]
    assert expand_inputs(f"file://{tmp_path}/a.fa") == [f"file://{tmp_path}/a.fa"]
    with pytest.raises(FileNotFoundError):
        expand_inputs(f"file://{tmp_path}/none.fa")


def test_large_file_in_pieces(spark, tmp_path):
    want = [(f"s{i}", "ACGT" * (i % 7)) for i in range(200)]
    (tmp_path / "a.fa").write_text("".join(f">{h} d\n" + "".join(s[j : j + 5] + "\n" for j in range(0, len(s), 5)) for h, s in want))
    for piece in (17, 100, 1000):
        df = read_records(spark, str(tmp_path / "a.fa"), task_bytes=piece)
        assert [(r["header"], r["sequence"]) for r in df.orderBy("rec_id").collect()] == want


def test_cli_round_trip(spark, tmp_path, capsys):
    fwd, rev = "AGAGTTTGATCATGGCTCAG", "TACGGTTACCTTGTTACGACTT"
    (tmp_path / "a.fa").write_text(">ref one\n" + "GCGCGCTA" * 10 + fwd + "GCGCGCTA" * 20 + rc_text(rev) + "GC" * 9 + "\n")
    out, tsv = tmp_path / "o.fa.gz", tmp_path / "o.tsv"
    assert cli.main(["-i", str(tmp_path / "a.fa"), "-p", f"p:{fwd}:{rev}", "-o", str(out), "--tsv", str(tsv)], spark) == 0
    assert is_bgzf(str(out)) and gzip.open(out, "rt").readline() == ">ref:p:1\tpos=80-282\tstrand=+\tlen=202\n"
    assert [x.split("\t")[0] for x in tsv.read_text().splitlines()] == ["amplicon_id", "ref:p:1"]
    assert "Products:     1" in capsys.readouterr().err
    assert cli.main(["-i", str(tmp_path / "a.fa"), "-p", "p:CCCCCCCCCC:GGGGGGGGGG", "-k", "0", "-o", str(tmp_path / "n.fa")], spark) == 0
    assert not (tmp_path / "n.fa").exists()
    (tmp_path / "n.fa").write_text(">of an older run\n")
    assert cli.main(["-i", str(tmp_path / "a.fa"), "-p", "p:CCCCCCCCCC:GGGGGGGGGG", "-k", "0", "-o", str(tmp_path / "n.fa")], spark) == 0
    assert not (tmp_path / "n.fa").exists() and not list(tmp_path.glob(".*"))
    assert cli.main(["-i", str(tmp_path / "a.fa"), "-p", f"p:{fwd}:{rev}", "-o", str(tmp_path / "many"), "--folders"], spark) == 0
    assert "".join(f.read_text() for f in (tmp_path / "many").glob("part-*")).startswith(">ref:p:1\t")
    assert cli.main(["-i", str(tmp_path / "a.fa"), "-p", "p:A", "-o", str(out)], spark) == 1
    with pytest.raises(OutputDirMissing):
        check_writable(str(tmp_path / "no" / "x.fa"))


def test_definition_goes_on_in_indented_lines():
    text = b"LOCUS       X 4 bp\nDEFINITION  An outbreak and the\n            SOURCE of the outbreak,\n            ORGANISM unknown.\nACCESSION   A1\nORIGIN\n        1 acgt\n//\n"
    (record,) = genbank(text.splitlines())
    assert record.definition == "An outbreak and the SOURCE of the outbreak, ORGANISM unknown." and record.accession == "A1" and record.seq == "acgt"
    assert parser_name() == "lines"


def test_summary_is_logged(caplog):
    summary = RunSummary(3, 2, 5, [("p", 4), ("q", 1)], 7, 1, [("r", 5)])
    with caplog.at_level("INFO", "amplispark"):
        summary.log()
    assert [r.message for r in caplog.records] == summary.lines() and "    and 5 more" in summary.lines()


def test_sql_functions(spark):
    dna.register(spark)
    register_udtf(spark)
    r = spark.sql("SELECT dna_rc('AACGX') a, dna_canonical('TTTT') b, n_fraction('ANNA') c, seq_identity(2, 8) d, circular_extend('ACGT', 3) e, dna_upper('acß') f").first()
    assert tuple(r) == ("NCGTT", "AAAA", 0.5, 0.75, "ACGTAC", "ACß")
    assert spark.sql("SELECT start, `end` FROM primer_matches('AAAACGTAAA', 'ACGT', 0, false)").collect() == [(3, 7)]
    assert spark.sql("SELECT product FROM pcr_products('AAAACGTAAAATGCATTTT', 'ACGT', 'TGCA', 0, 12, 12, false, false)").first()[0] == "ACGTAAAATGCA"
    assert spark.sql("SELECT count(*) FROM pool_products('AAAAGTAGTGGGG', 'AAAA;CCCC', 0, 8, 200, false, false)").first()[0] == 1


def test_stream(spark, tmp_path):
    from amplispark.config import MatchConfig, PcrConfig
    from amplispark.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">r1 x\nAAAACGTAA\nAATGCATTTT\n>r2\nGGGG\n>r3\naaaacgtaaaatgcatttt\n")
    watch(spark, str(tmp_path / "in"), [PrimerPair("p", "ACGT", "TGCA")], str(tmp_path / "out"), str(tmp_path / "cp"), PcrConfig(MatchConfig(0), 12, 12)).awaitTermination(60)
    assert {r["reference_header"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"r1", "r3"}


def test_stream_takes_each_fasta_extension(spark, tmp_path):
    from amplispark.functions.dna import FASTA_EXTENSIONS
    from amplispark.streaming.watch import arriving_records

    names = [f"x{i}.{e}" for i, e in enumerate(FASTA_EXTENSIONS)] + ["y.FASTA", "y.Ffn", "a.b.fas"]
    for name in [*names, "z.txt", "z.fa.gz", "z.fma", "zfa"]:
        (tmp_path / name).write_text(f">{name}\nACGT\n")
    stream = arriving_records(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(r["header"] for r in spark.table("arrived").collect()) == sorted(names)
