"""Databases, combined files, features, constrained annealing and clustering by samples."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeq.functions import features
from latticeq.functions.geometry import vec
from latticeq.operators import grouped
from latticeq.sources import databases, records


def test_structures(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, pos int")
    databases.write_structures(df, f"file://{tmp_path}/one")
    databases.write_structures(df.withColumn("name", F.lit("b")), f"file://{tmp_path}/one", append=True)
    databases.write_structures(df.withColumn("vdw", F.lit(1)), f"file://{tmp_path}/two")
    assert databases.read_structures(spark, [f"file://{tmp_path}/one", f"file://{tmp_path}/two"]).count() == 3
    with pytest.raises(ValueError, match="vdw"):
        databases.read_structures(spark, [f"file://{tmp_path}/one"], contacts=True)


def test_seeds(spark, tmp_path):
    names = [f"s{i:03d}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    path = f"file://{tmp_path}/seeds"
    databases.append_entries(df.filter("name < 's030'"), path, ["name"])
    databases.append_entries(df.filter("name >= 's030'"), path, ["name"])
    there = spark.read.parquet(path)
    assert [r.name for r in there.orderBy("index").collect()] == names and [r["index"] for r in there.orderBy("index").collect()] == list(range(50))
    assert sorted(r.name for r in databases.entries_from(there, 45).collect()) == names[45:]
    new = databases.renamed(there, spark.createDataFrame([("s001", "z")], "name string, new_name string"))
    assert {r.name for r in new.collect()} == set(names) - {"s001"} | {"z"}


def test_segments(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.2), (1, 1, 0.0)], "src long, dst long, rmsd double")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    databases.write_segments(nodes, edges, f"file://{tmp_path}/g")
    nodes, edges = databases.read_segments(spark, f"file://{tmp_path}/g")
    assert {(r.id, r.neighbour) for r in databases.neighbours(edges, nodes, "id").collect()} == {(1, 2), (1, 1), (2, 3)}
    assert {(r.id, r.neighbour) for r in databases.neighbours(edges, nodes, "id", forward=False).collect()} == {(1, 1), (2, 1)}


def test_similarity_files(spark):
    similar = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0)], "a int, b int, jaccard double")
    names = F.array(F.lit("x"), F.lit("y"))
    dense = json.loads(databases.similarity_json(similar, names, sparse=False).first().value)
    assert dense == {"binder_names": ["x", "y"], "similarity": [[1.0, 0.5], [0.5, 1.0]]}
    sparse = json.loads(databases.similarity_json(similar.filter("a < b"), names).first().value)
    assert sparse == {"binder_names": ["x", "y"], "similarity": [[[0, 1], 0.5]]}


def test_files_combined_and_targets(spark, tmp_path):
    line = lambda chain: f"ATOM      1  CA  GLY {chain}   1       1.000   1.000   1.000"
    (tmp_path / "in").mkdir()
    for name in ("b", "a"):
        (tmp_path / "in" / f"{name}.pdb").write_text("\n".join([line("A"), line("B"), "END", ""]))
    records.combine_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", ["A"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "".join(f"HEADER    {n}\n{line('A')}\nEND\n" for n in "ab")
    rows = records.read_entries(spark, f"file://{tmp_path}/out")
    other = spark.createDataFrame([("t", "body")], "name string, body string")
    target, rest = records.split_target(rows, fallback=other)
    assert [r.name for r in target.collect()] == ["t"] and rest.count() == 2
    target, _ = records.split_target(rows.unionByName(other.withColumn("name", F.lit("x_target"))), fallback=other)
    assert [r.name for r in target.collect()] == ["x_target"]
    row = spark.range(1).select(records.first_chain_mean(F.array(*(F.lit(float(x)) for x in (1, 2, 9))), F.lit(2)).alias("m")).first()
    assert row.m == 1.5


def test_relations(spark, tmp_path):
    (tmp_path / "s.csv").write_text("fragName,cenResIdx,chainID,resNum,numMatches\nf,A,12,10,3\n")
    row = records.read_table(spark, f"file://{tmp_path}/s.csv", "fragments").first()
    assert tuple(row) == ("f", "A", 12, 10, 3)


def test_rotations(spark):
    rng = np.random.default_rng(4)
    for _ in range(5):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        x, y, z, w = q
        r = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
        flat = F.array(*(F.lit(float(v)) for row in r for v in row))
        got = np.array(spark.range(1).select(features.quaternion(flat).alias("q")).first().q)
        assert np.allclose(got, q * np.sign(w), atol=1e-9)
    row = spark.range(1).select(features.position_encoding(F.lit(3.0), 4).alias("p"), features.dihedral_features(F.lit(math.pi), F.lit(None).cast("double")).alias("d"), features.transposed(F.array(*(F.lit(i) for i in range(6))), 2, 3).alias("t"), features.diagonal(F.array(*(F.lit(i) for i in range(9))), 3).alias("g")).first()
    assert np.allclose(row.p, [math.cos(3), math.cos(0.03), math.sin(3), math.sin(0.03)]) and np.allclose(row.d, [-1, 1, 0, 0]) and row.t == [0, 3, 1, 4, 2, 5] and row.g == [0, 4, 8]
    frame = F.struct(vec(*(F.lit(0.0),) * 3).alias("o"), *(vec(*(F.lit(float(i == j)) for j in range(3))).alias(a) for i, a in enumerate("xyz")))
    row = spark.range(1).select(features.direction(frame, vec(F.lit(0.0), F.lit(5.0), F.lit(0.0))).alias("a"), features.direction(frame, vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("b")).first()
    assert tuple(row.a) == (0, 1, 0) and tuple(row.b) == (0, 0, 0)


def test_constrained_annealing(spark):
    rng = np.random.default_rng(6)
    rows = [(1, i, None, a, None, float(rng.normal())) for i in range(5) for a in range(3)] + [(1, i, j, a, b, float(rng.normal())) for i in range(5) for j in range(i + 1, 5) for a in range(3) for b in range(3)]
    table = spark.createDataFrame(rows, "sid long, pos_i long, pos_j long, aa_i long, aa_j long, e double")
    fixed = spark.createDataFrame([(1, 0, 2), (1, 3, 1)], "sid long, pos long, aa long")
    out = grouped.anneal(table, "sid", cycles=6, steps=3000, hot=2.0, cold=0.02, fixed=fixed).collect()
    assert len(out) == 6 and all(r.best_seq[0] == 2 and r.best_seq[3] == 1 and r.init_seq[0] == 2 for r in out)

    def total(s):
        return sum(e for _, i, j, a, b, e in rows if s[i] == a and (j is None or s[j] == b))

    best = min(((total((2, a, b, 1, c)), [2, a, b, 1, c]) for a in range(3) for b in range(3) for c in range(3)))
    assert any(r.best_seq == best[1] and abs(r.best_seq_e - best[0]) < 1e-9 for r in out)
    # all cycles find it: with stop = 2 the second is the last
    stopped = grouped.anneal(table, "sid", cycles=6, steps=3000, hot=2.0, cold=0.02, fixed=fixed, stop=2).orderBy("cycle").collect()
    seen, lowest, want = 0, None, 6
    for r in sorted(out, key=lambda r: r.cycle):
        if lowest is None or r.best_seq_e < lowest[0]:
            lowest = (r.best_seq_e, r.best_seq)
        seen = sum(x.best_seq == lowest[1] for x in out if x.cycle <= r.cycle)
        if seen >= 2:
            want = r.cycle + 1
            break
    assert [r.cycle for r in stopped] == list(range(want))
    weighed = grouped.anneal(table, "sid", cycles=1, steps=10, weight=2.0, fixed=fixed).first()
    assert abs(weighed.best_seq_e - (total(weighed.best_seq) - 2.0 * weighed.best_complexity)) < 1e-9
    top = grouped.lowest_sequences(grouped.anneal(table, "sid", cycles=6, steps=50), "sid", 3).orderBy("rank").collect()
    assert [r.rank for r in top] == list(range(1, len(top) + 1)) and all(a.best_seq_e <= b.best_seq_e for a, b in zip(top, top[1:]))


def test_clusters_by_samples(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 3)) * 20
    rows = [(0, i, (centres[i % 4] + rng.normal(size=3) * 0.1).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    got = {r.id: r.cluster for r in grouped.greedy_clusters(df, "g", "id", "v", 2.0, superpose=False, sample=20).collect()}
    assert all(len({got[i] for i in range(k, 200, 4)}) == 1 for k in range(4)) and len(set(got.values())) == 4
