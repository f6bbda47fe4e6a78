"""Parsers and writers on synthetic text."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from latticeq.sources import records


def atom(n, name, res, chain, num, x, alt=" "):
    return f"ATOM  {n:5d} {name:<4s}{alt}{res:>3s} {chain}{num:>5s}   {x:8.3f}{x + 1:8.3f}{x + 2:8.3f}  1.00{7.5:6.2f}"


BODY = [
    atom(1, " N", "MSE", "A", "1 ", 1), atom(2, " CA", "MSE", "A", "1 ", 2, "A"), atom(3, " CA", "MSE", "A", "1 ", 9, "B"), atom(4, " C", "MSE", "A", "1 ", 3), atom(5, " OXT", "MSE", "A", "1 ", 4),
    atom(6, " N", "GLY", "A", "1A", 5), atom(7, " CA", "GLY", "A", "1A", 6), atom(8, " C", "GLY", "A", "1A", 7), atom(9, " O", "GLY", "A", "1A", 8), atom(10, " N", "ALA", "B", "2 ", 5), "TER", "TER",
]


def entry(name, lines=BODY):
    return "\n".join([f"HEADER    {name}", *lines, "END", ""])


def test_entries(spark, tmp_path):
    (tmp_path / "in.pdb").write_text(entry("x_target") + entry("s1") + entry("s2") + "FILEEND\n")
    entries = records.read_entries(spark, f"file://{tmp_path}/in.pdb").cache()
    assert sorted(r.name for r in entries.collect()) == ["s1", "s2", "x_target"]
    target, rest = records.split_target(entries)
    assert target.count() == 1 and rest.count() == 2
    atoms = records.parse_atoms(entries.filter("name = 's1'"))
    assert atoms.count() == 10 and {r.resnum for r in atoms.collect()} == {"1", "1A", "2"}
    clean = records.clean_backbone(atoms)
    assert clean.count() == 8 and clean.filter("atom = 'O' AND resnum = '1'").first().x == 4.0 and clean.filter("atom = 'CA' AND resnum = '1'").first().x == 2.0
    res = records.residues(clean).orderBy("pos").collect()
    assert [(r.letter, r.resnum, r.ca.x, r.bfac) for r in res] == [("M", "1", 2.0, 7.5), ("G", "1A", 6.0, 7.5)]
    assert records.chain_sequences(records.residues(clean)).first().sequence == "MG"
    threaded = records.thread_sequence(records.residues(clean), spark.createDataFrame([("s1", "A", "KR")], "name string, chain string, sequence string"))
    assert [r.letter for r in threaded.orderBy("pos").collect()] == ["K", "R"]
    lines = entries.filter("name = 's1'").select("name", F.posexplode(F.split("body", "\n")).alias("n", "text"))
    assert records.collapse_ter(lines, "name", "n").filter("text = 'TER'").count() == 1


def test_write_first_wins_and_renames(spark, tmp_path):
    df = spark.createDataFrame([("a", "HEADER    a\nfirst", 0), ("a", "HEADER    a\nsecond", 1), ("b", "HEADER    b\nthird", 2)], "name string, body string, o int")
    records.write_entries(df, f"file://{tmp_path}/out", ["o"])
    got = {r.name: r.body for r in records.read_entries(spark, f"file://{tmp_path}/out").collect()}
    assert got == {"a": "HEADER    a\nfirst", "b": "HEADER    b\nthird"}
    copy = records.copy_entries(df.filter("o > 0"), spark.createDataFrame([("b",)], "name string"), {"b": "z"}).first()
    assert tuple(copy) == ("z", "HEADER    z\nthird")


def test_energy_tables(spark, tmp_path):
    (tmp_path / "e.etab").write_text("A,1 ALA -1.5\nA,1 B,2 ALA GLY 0.25\n\n")
    own, pair = records.read_energy_table(spark, f"file://{tmp_path}/e.etab")
    assert tuple(own.first()) == ("A,1", "ALA", -1.5) and tuple(pair.first()) == ("A,1", "B,2", "ALA", "GLY", 0.25)
    records.write_energy_table(own, pair, f"file://{tmp_path}/again")
    assert records.read_energy_table(spark, f"file://{tmp_path}/again")[1].collect() == pair.collect()


def test_reads(spark, tmp_path):
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1/1\nACGT\n+\nIIII\n@r2/1\nAC\n+\n@!\n")
    reads = records.read_fastq(spark, f"file://{tmp_path}/r.fastq.gz")
    assert {r.id: (r.seq, r.qual) for r in reads.collect()} == {"r1": ("ACGT", [40] * 4), "r2": ("AC", [31, 0])}
    assert [r.id for r in records.good_reads(reads).collect()] == ["r1"]
    (tmp_path / "d.fa").write_text(">a, 1, 2, 3, 4, 5, 6, 7\nMK\nL\n>T=0.1, s, 1, 2, 3\nGG\n")
    assert sorted((r.kind, r.sequence) for r in records.read_fasta(spark, f"file://{tmp_path}/d.fa").collect()) == [("design", "GG"), ("native", "MKL")]


def test_json_and_logs(spark, tmp_path):
    one = {"t1": {"f1": {"topologyPosition": 0, "nterm_trim": 0, "cterm_trim": 1, "aaSeq": "AA", "isSeed": True}}, "t2": {}}
    two = {"t1": {"f2": {"topologyPosition": 3, "nterm_trim": 0, "cterm_trim": 0, "aaSeq": "G", "isSeed": False}}}
    for name, value in (("one", one), ("two", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    rows = records.read_topologies(spark, [f"file://{tmp_path}/{n}.json" for n in ("one", "two")]).collect()
    assert [(r.topology, r.fragment, r.topologyPosition) for r in rows] == [("t1", "f2", 3)]
    (tmp_path / "h.json").write_text(json.dumps({"contType": "SS", "AA3": "ALA", "countsArray": [[1, 2], [3, 4]]}))
    assert {(r.i, r.j, r.n) for r in records.read_densities(spark, f"file://{tmp_path}/h.json").collect()} == {(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)}
    (tmp_path / "radii").write_text("RESIDUE ATOM ALA 2\nATOM  CA 1.87 1\nATOM  O 1.40 0\nRESIDUE ATOM GLY 1\nATOM  CA 1.86 1\n")
    assert sorted(map(tuple, records.read_radii(spark, f"file://{tmp_path}/radii").collect())) == [("ALA", "CA", 1.87), ("ALA", "O", 1.4), ("GLY", "CA", 1.86)]
    (tmp_path / "x.log").write_text("start\nrecovery: 0.41\n")
    row = records.read_result_logs(spark, f"file://{tmp_path}/x.log", {"recovery": r"recovery: (\S+)", "energy": r"energy: (\S+)"}).first()
    assert (row.recovery, row.energy) == ("0.41", None)
    (tmp_path / "t.dat").write_text("sequence A B\nfocus 1\n\nrmsds 0.1 0.2\n")
    got = {(r.record, r.key): r["values"] for r in records.read_term_records(spark, f"file://{tmp_path}/t.dat").collect()}
    assert got == {(0, "sequence"): ["A", "B"], (0, "focus"): ["1"], (1, "rmsds"): ["0.1", "0.2"]}
