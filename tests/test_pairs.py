"""Joins of all pairs: that they stay whole and exact however the work is cut, and shuffle no pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from latticeq.functions import geometry as g
from latticeq.operators import chains, counting, grouped, interface


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_windows_by_blocks_and_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # many ties: few different values; chain 5 is long, chain 7 has values that are no numbers
    rows = [(c, p, [float(x) for x in rng.integers(0, 4, 3)]) for c, n in ((1, 6), (2, 5), (5, 40), (7, 4), (9, 1)) for p in range(n)]
    rows += [(7, 10, [math.nan, 1.0, 1.0]), (8, 0, [math.nan, 0.0, 0.0]), (8, 1, [math.inf, 0.0, 0.0]), (10, 0, [1e25, 2e25, 0.5])]
    df = spark.createDataFrame(rows, "chain long, pos long, w array<double>")
    order = lambda far, i, j: (math.isnan(far), 0.0 if math.isnan(far) else far, i, j)

    def far(x, y):
        return math.sqrt(sum((p - q) * (p - q) for p, q in zip(x, y)) / 3)

    want = {}
    for a, i, x in rows:
        for b, j, y in rows:
            if a != b and a in (1, 5, 7, 8):
                want[a, b] = min(want.get((a, b), (True, 0.0, 99, 99)), order(far(x, y), i, j))
    for block, piece in ((8192, 1024), (7, 16)):
        monkeypatch.setattr(chains, "BLOCK", block)
        monkeypatch.setattr(chains, "PIECE", piece)
        out = chains.best_window(df.filter("chain IN (1, 5, 7, 8)"), df, "chain", "pos", "w", 3)
        got = {(r.a, r.b): order(r.rmsd, r.i, r.j) for r in out.collect()}
        assert got == want
    monkeypatch.setattr(chains, "PIECE", 1024)
    assert "hashpartitioning(a" not in plan(chains.best_window(df, df, "chain", "pos", "w", 3))


def test_similar_sets_as_bitmaps_and_by_members(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for members in (20, 150):
        sets = {k: set(rng.integers(0, members, int(rng.integers(1, 40))).tolist()) for k in range(60)} | {60: set()}
        df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s or {None}], "k long, m long")
        query = F.col("k") % 10 == 0
        want = {(a, b): round(len(s & t) / max(1, len(s | t)), 6) if max(len(s), len(t)) >= 10 else 0.0 for a, s in sets.items() for b, t in sets.items()}
        pairs = {(a, b): (len(sets[a] & sets[b]), want[a, b]) for a, b in want if sets[a] & sets[b]}
        for most in (1024, 3):
            monkeypatch.setattr(counting, "BITMAP_MEMBERS", most)
            some, every = counting.set_similarity(df, "k", "m", 10, query, 6), counting.set_similarity(df, "k", "m", 10, None, 6)
            assert {(r.a, r.b): (r.shared, r.jaccard) for r in some.collect()} == {k: v for k, v in pairs.items() if k[0] % 10 == 0 and k[0] != k[1]}
            assert {(r.a, r.b): (r.shared, r.jaccard) for r in every.collect()} == {k: v for k, v in pairs.items() if k[0] < k[1]}
            matrix = counting.set_matrix(df, "k", "m", 10, query, 6).collect()
            assert {(r.a, r.b): r.jaccard for r in matrix} == {(a, b): 1.0 if a == b else x for (a, b), x in want.items() if a % 10 == 0}
            assert len(matrix) == 7 * 61
            assert ("hashpartitioning(a" in plan(some)) == (most == 3)


def test_bonds_by_blocks_and_their_sums(spark, monkeypatch):
    rng = np.random.default_rng(2)
    point = lambda at: tuple(map(float, at + rng.normal(size=3)))
    rows = [(i, i % 3 > 0, *(point(np.array([0.5 * (i % 5), 0.0, 9.0 * (i > 50)])) for _ in range(5))) for i in range(70)]
    rows[4] = (*rows[4][:6], None)  # no hydrogen
    df = spark.createDataFrame(rows, "id long, binder boolean, " + ", ".join(f"{a} struct<x:double,y:double,z:double>" for a in ("n", "ca", "c", "o", "h")))
    e = g.hbond_energy(*(F.col(f"x.{a}") for a in ("n", "h", "c", "o")), F.col("y.ca"), F.col("y.c"), F.col("y.o"))
    met = df.alias("x").crossJoin(df.alias("y")).filter((F.col("x.id") != F.col("y.id")) & (F.col("x.binder") | F.col("y.binder")) & F.col("x.h").isNotNull() & (g.distance(F.col("x.ca"), F.col("y.ca")) <= 3))
    want = {(r.d, r.a): r.e for r in met.select(F.col("x.id").alias("d"), F.col("y.id").alias("a"), e.alias("e")).collect() if r.e < g.HBOND_CUT}
    for block, shares in ((512, 8), (4, 3)):
        monkeypatch.setattr(interface, "BLOCK", block)
        monkeypatch.setattr(interface, "SHARES", shares)
        rows = interface.hydrogen_bonds(df, 3.0).collect()
        got = {(r.donor, r.acceptor): r.energy for r in rows}
        assert len(want) > 20 and len(rows) == len(want) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        sums = interface.hydrogen_bond_sums(df, 3.0).collect()
        assert sum(r.n for r in sums) == len(want) and abs(sum(r.energy for r in sums) - sum(want.values())) < 1e-9
        assert {r.donor for r in sums} - {None} == {d for d, _ in want} and {r.acceptor for r in sums} - {None} == {a for _, a in want}


def test_overlaps_are_asked_only_of_like_sizes(spark):
    rng = np.random.default_rng(4)
    v = {i: (rng.normal(size=(5, 3)) * (1 + i % 4)).ravel() for i in range(40)}
    v[1][-9:] = v[0][:9] + 5  # shifted: superposes
    v[2][-9:] = v[0][:9] * 1.05
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id long, v array<double>")
    far = {(a, b): grouped.superposed_rmsd(v[a][:9].reshape(-1, 3), v[b][-9:].reshape(-1, 3)) for a in v for b in v}
    out = grouped.overlap_edges(df, "id", "v", 3, 0.5)
    got = {(r.src, r.dst): r.rmsd for r in out.collect()}
    want = {k: x for k, x in far.items() if x <= 0.5}
    assert (0, 1) in want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "BroadcastNestedLoopJoin" in plan(out) and "abs(" in plan(out)
    out = grouped.overlap_edges(df, "id", "v", 2, 0.5)
    far = {(a, b): grouped.superposed_rmsd(v[a][:6].reshape(-1, 3), v[b][-6:].reshape(-1, 3)) for a in v for b in v}
    got = {(r.src, r.dst): r.rmsd for r in out.collect()}
    want = {k: x for k, x in far.items() if x <= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert "Python" not in plan(out)
