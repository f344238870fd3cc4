import csv
import heapq
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from amplispark.automaton import CHUNK
from amplispark.operators import consolidate as con
from amplispark.operators.numbering import key_summary, misnumbered
from amplispark.operators.rowparse import BAD, QUOTED, parse_primer_lines, scan

T0 = datetime(2020, 1, 1)


def inbox(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, source_file string, content string, landed_at timestamp_ntz, grp string")


def test_consolidate(spark, tmp_path):
    big = "".join(f">b{i} d\nACGT\n" for i in range(500))
    rows = [
        (1, "a.fa", ">x 1\nAC\nGT\n>y\n", T0), (2, "a.fa", "﻿>x2 q\r\nAC\r\n\r\n>\tz t\r\nG", T0 + timedelta(1)), (3, "b.fa", ">old\nA", T0),
        (4, "b.fa", None, T0), (5, "c.fa", "", T0), (6, "d.fa", "no record\n >no\n>d\n", None), (6, "d.fa", "no record\n >no\n>d\n", None), (7, None, ">n\nA", T0), (8, "big.fa", big, T0),
    ]
    df = inbox(spark, rows)
    said = con.consolidate(df, out := f"file://{tmp_path}/c", target_bytes=1000)
    got = sorted((r["source_file"] or "", r["record_idx"], r["header"], r["sequence"]) for r in con.read_consolidated(spark, out).collect())
    want = sorted([("a.fa", 0, "x2", "AC"), ("a.fa", 1, "z", "G"), ("d.fa", 0, "d", ""), ("", 0, "n", "A"), *(("big.fa", i, f"b{i}", "ACGT") for i in range(500))])
    assert got == want and said["files"] == 6 and said["records"] == len(want)
    assert said["bytes"] == sum(len((c or "").encode()) for c in (rows[1][2], None, "", rows[5][2], ">n\nA", big))
    said = con.consolidate(df.limit(0), out := f"file://{tmp_path}/e")
    assert said["files"] == 0 and con.read_manifest(spark, out).count() == 0 and con.read_consolidated(spark, out).count() == 0


def heads(spark, out):
    return sorted(r["header"] for r in con.read_consolidated(spark, out).collect())


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    df = inbox(spark, [(1, "a.fa", ">x\nAC\n>y\nG", T0), (2, "b.fa", ">z\nT", T0)])
    con.consolidate(df, out := f"file://{tmp_path}/c")
    (part,) = (tmp_path / "c").glob("run-*/part-*.parquet")
    (part.parent / "part-00000000-late.parquet").write_bytes(part.read_bytes())  # a second attempt, renamed late
    assert heads(spark, out) == ["x", "y", "z"]


@pytest.mark.parametrize("step", ["_write", "_verify", "_publish", "_remove"])
def test_run_that_dies_at_any_step(spark, tmp_path, monkeypatch, step):
    out = f"file://{tmp_path}/c"
    for i in range(2):
        con.consolidate(inbox(spark, [(1, "a.fa", f">old{i}\nAC", T0)]), out)
    fresh = inbox(spark, [(1, "a.fa", ">new\nAC", T0)])
    for after in (False, True):
        with monkeypatch.context() as m:
            whole = getattr(con, step)

            def dies(*args):
                if after:
                    whole(*args)
                raise RuntimeError("lost")

            m.setattr(con, step, dies)
            with pytest.raises(RuntimeError):
                con.consolidate(fresh, out)
        published = step == "_remove" or (step == "_publish" and after)
        assert heads(spark, out) == ["new" if published else "old1"]
    con.consolidate(fresh, out)
    assert heads(spark, out) == ["new"]
    con.sweep(out)
    assert heads(spark, out) == ["new"] and len(list((tmp_path / "c").glob("run-*"))) == 2


def test_run_that_lost_records_is_not_published(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/c"
    con.consolidate(inbox(spark, [(1, "a.fa", ">old\nAC", T0)]), out)
    schema = con._verify
    wrong = lambda manifest, plan, sizes: schema(manifest.withColumn("n_records", manifest["n_records"] - 1), plan, sizes)
    monkeypatch.setattr(con, "_verify", wrong)
    with pytest.raises(OSError):
        con.consolidate(inbox(spark, [(1, "a.fa", ">new\nAC", T0)]), out)
    assert heads(spark, out) == ["old"]


def test_reader_of_the_run_before_is_not_disturbed(spark, tmp_path):
    out = f"file://{tmp_path}/c"
    con.consolidate(inbox(spark, [(1, "a.fa", ">old\nAC", T0)]), out)
    reader = con.read_consolidated(spark, out)
    con.consolidate(inbox(spark, [(1, "a.fa", ">new\nAC", T0)]), out)
    assert [r["header"] for r in reader.collect()] == ["old"] and heads(spark, out) == ["new"]


def test_schedule_is_longest_first(spark):
    sizes = [700, 600, 500, 400, 300, 200, 100, 0]
    df = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(sizes)], "source_file string, n_bytes bigint")
    plan, groups = con.schedule(df, 1200)
    loads = [0] * groups
    heapq.heapify(loads)
    for s in sizes:
        heapq.heapreplace(loads, loads[0] + s + con.FILE_WEIGHT)
    got = [0] * groups
    for r in plan.collect():
        got[r["grp"]] += r["n_bytes"] + con.FILE_WEIGHT
    assert groups == 3 and sorted(got) == sorted(loads)


def test_schedule_of_several_shards_is_balanced(spark):
    for groups, files in ((33, 6600), (70, 14000)):
        df = spark.range(files).selectExpr("concat('f', id) AS source_file", "900 + id % 73 AS n_bytes")
        total = df.selectExpr(f"sum(n_bytes + {con.FILE_WEIGHT})").first()[0]
        plan, n = con.schedule(df, -(-total // groups))
        loads = [r["load"] for r in plan.groupBy("grp").agg({"n_bytes": "sum"}).toDF("grp", "load").collect()]
        assert n == groups == len(loads) and plan.count() == files
        assert max(loads) <= 1.25 * sum(loads) / groups


def lines_frame(spark, rows):
    return spark.createDataFrame([(i, no, x, "clash") for i, (no, x) in enumerate(rows)], "line_id bigint, line_no bigint, line string, name string")


def test_reasons(spark):
    cases = {
        "a,ACG,TTT": None, ' "a,b" ,"AC""G",T': "letters", '"a,b",ACG,TTT,more': None, "a,ACG": "columns", "a,,TTT": "empty", 'a," ",TTT': "empty",
        '"a,ACG,TTT': "quoting", 'a"b,ACG,TTT': "quoting", '"a"b,ACG,TTT': "quoting", '"a" \t\r,ACG,TTT': None, "a,ACX,TTT": "letters", "a,acg,ryn": None,
        '"a\nb",ACG,TTT': None, ",,": "empty", "": "blank", " \t ": "blank", 'a,"ACG",TTT"': "quoting", "é,ACG,TTT": None, "a, ACG ,\tTTT\r\n": None, '"a"\n,ACG,TTT': "quoting",
    }
    df = lines_frame(spark, [(2, x) for x in cases] + [(1, "name,forward,reverse"), (3, None), (None, "a,b"), (2, "a,ACG,TTT")])
    got = {r["line_id"]: r["reason"] for r in parse_primer_lines(df).collect()}
    want = {i: w for i, w in enumerate(cases.values()) if w != "blank"} | {len(cases) + 2: "columns", len(cases) + 3: None}
    assert got == want
    loaded = {r["line_id"]: (r["name"], r["forward"], r["reverse"]) for r in parse_primer_lines(df).where("reason is null").collect()}
    assert loaded[2] == ("a,b", "ACG", "TTT") and loaded[12] == ("a\nb", "ACG", "TTT")
    assert parse_primer_lines(df.limit(0)).count() == 0


def test_offsets_of_reasons(spark):
    cases = {
        "a,ACG": 5, "é,": 2, "a,,TTT": 2, 'é," ",TTT': 2, ",,": 0, "a,ACG, ": 6, "a,ACX,TTT": 4, 'é," A""G",T': 5, "a,ACG,\tTT\u00e9": 9, 'a, " XA" ,T': 5, "a,A C,T": 3,
        '"é",ACG,"TTT': 8, 'a"b,ACG,TTT': 1, '"é"b,ACG,TTT': 3, '"a""b,ACG,TTT': 0, 'a,ACG,"T" x"': 10, '"a"\n,ACG,TTT': 3, "x" * 300 + ',ACG,"' + "y" * 300: 305, "a,ACG,TTT": None,
    }
    df = lines_frame(spark, [(2, x) for x in cases])
    assert {r["line_id"]: r["offset"] for r in parse_primer_lines(df).collect()} == dict(enumerate(cases.values()))


def test_scan_of_long_rows_against_csv():
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        fields = ["".join(rng.choices('ab,"\n', k=rng.choice([0, 3, CHUNK, 5 * CHUNK]))) for _ in range(rng.randint(1, 5))]
        rows.append((fields, ",".join('"' + f.replace('"', '""') + '"' for f in fields)))
    data = "".join(r for _, r in rows).encode()
    offsets = np.cumsum([0, *(len(r) for _, r in rows)])
    final, at = scan(np.frombuffer(data, np.uint8), offsets)
    for i, (fields, text) in enumerate(rows):
        assert final[i] not in (QUOTED, BAD)
        assert ((at >= offsets[i]) & (at < offsets[i + 1])).sum() == len(fields) - 1
        assert next(csv.reader([text])) == fields if "\n" not in text else True


def products(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "product_id bigint, reference_header string, primer_name string, found_at timestamp_ntz, case_number bigint, full_length bigint, _id string")


def test_misnumbered(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        hot = rng.random()
        header = "hot" if hot < 0.5 else "busy" if hot < 0.8 else None if hot < 0.83 else f"r{rng.randint(0, 40)}"
        at = None if rng.random() < 0.02 else T0 if header == "busy" and rng.random() < 0.7 else T0 + timedelta(seconds=rng.randint(0, 500))
        rows.append((i, header, None if rng.random() < 0.02 else "p" if header in ("hot", "busy") else rng.choice("pq"), at, None if rng.random() < 0.02 else rng.randint(1, 1000)))
    want, last = set(), {}
    for pid, h, p, at, no in sorted(rows, key=lambda r: (r[3] is not None, r[3] or T0, r[0])):
        if h is None or p is None:
            continue
        before = last.get((h, p))
        if before is not None and no is not None and no <= before:
            want.add(pid)
        last[h, p] = no
    df = products(spark, rows)
    assert {r["product_id"] for r in misnumbered(df).collect()} == want
    assert misnumbered(df.limit(0)).count() == 0
    assert key_summary(df).count() == len({(r[1], r[2]) for r in rows})


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"p2_found", "p4_found", "p5_found", "pair_linear"} <= set(e.queries())
