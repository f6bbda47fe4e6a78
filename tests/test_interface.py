"""Operators between targets and binders against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeq.functions import geometry as g
from latticeq.operators import energy, interface


def point(v):
    return g.vec(*(F.lit(float(x)) for x in v))


def angle(a, b):
    return math.acos(max(-1.0, min(1.0, a @ b / np.linalg.norm(a) / np.linalg.norm(b))))


def plain_energy(n, h, dc, do, ca, c, o):
    r = np.linalg.norm(n - o)
    well = 3 * 2.8 * 3**8 / r**8 - 4 * 2.8 * 3**6 / r**6
    if well > -0.25:
        return 0.0
    t, k, v = angle(h - n, o - h), np.cross(c - ca, o - c), h - o
    out = abs(math.pi / 2 - angle(v, k))
    within = angle(v - k * (v @ k) / (k @ k), do - dc)
    first = math.cos(t) ** 2 if t < math.pi / 2 else 0.0
    wide = math.radians(110)
    if within < math.pi / 2:
        second = (0.9 + 0.1 * math.sin(2 * within)) * math.cos(out)
    elif within < wide:
        second = 0.9 / math.cos(wide) ** 6 * (math.cos(wide) ** 2 - math.cos(within) ** 2) ** 3 * math.cos(out)
    else:
        second = 0.0
    return well * first * second


def test_hydrogen_bond_energy(spark):
    rng = np.random.default_rng(3)
    cases = [rng.normal(size=(7, 3)) * 1.5 for _ in range(200)]
    schema = ", ".join(f"p{i} struct<x:double,y:double,z:double>" for i in range(7))
    df = spark.createDataFrame([tuple(tuple(map(float, p)) for p in c) for c in cases], schema)
    got = [r.e for r in df.select(g.hbond_energy(*(F.col(f"p{i}") for i in range(7))).alias("e")).collect()]
    want = [plain_energy(*c) for c in cases]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9) and sum(w < -0.25 for w in want) > 5


def test_hydrogen_and_waters(spark):
    n, ca, before, c, o = (np.array(v, float) for v in ((0, 0, 0), (1.4, 0, 0), (-0.7, 1.1, 0), (2, 1.3, 0), (1.5, 2.4, 0)))
    row = spark.range(1).select(g.amide_hydrogen(point(n), point(ca), point(before)).alias("h"), g.carbonyl_waters(point(ca), point(c), point(o)).alias("w")).first()
    u = -((ca - n) / np.linalg.norm(ca - n) + (before - n) / np.linalg.norm(before - n))
    h = n + u / np.linalg.norm(u)
    assert np.allclose(row.h, h)
    z, y = np.cross(c - ca, o - c), (o - c) / np.linalg.norm(o - c)
    x = np.cross(y, z / np.linalg.norm(z))
    for turn, w in zip((30, 120), row.w):
        assert np.allclose(w, o + 2.8 * (math.cos(math.radians(turn)) * x + math.sin(math.radians(turn)) * y))
    assert np.allclose(spark.range(1).select(g.water_position(point(h), point(n)).alias("w")).first().w, n + 3 * (h - n))


def test_bonds_and_exposed_groups(spark):
    rng = np.random.default_rng(8)
    atoms = {i: rng.normal(size=(4, 3)) * 1.4 + np.array([0.7 * (i % 8), 0.7 * (i // 8), 30 * (i == 40)]) for i in range(64)}
    rows = [(i, 0, i >= 8, i == 8, i == 63, *(tuple(map(float, p)) for p in a)) for i, a in atoms.items()]
    df = spark.createDataFrame(rows, "id long, chain int, binder boolean, first boolean, last boolean, " + ", ".join(f"{a} struct<x:double,y:double,z:double>" for a in ("n", "ca", "c", "o")))
    backbones = interface.backbones(df, "chain", "id")
    hydrogen = {}
    for i in range(1, 64):
        (n, ca, _, _), before = atoms[i], atoms[i - 1][2]
        if np.linalg.norm(before - n) < 2:
            u = -((ca - n) / np.linalg.norm(ca - n) + (before - n) / np.linalg.norm(before - n))
            hydrogen[i] = n + u / np.linalg.norm(u)
    near = lambda i, j: np.linalg.norm(atoms[i][1] - atoms[j][1]) <= 3
    bonds = {}
    for i in hydrogen:
        for j in atoms:
            if i != j and (i >= 8 or j >= 8) and near(i, j):
                e = plain_energy(atoms[i][0], hydrogen[i], atoms[i][2], atoms[i][3], *atoms[j][1:])
                if e < -0.25:
                    bonds[i, j] = e
    found = interface.hydrogen_bonds(backbones, 3.0)
    got = {(r.donor, r.acceptor): r.energy for r in found.collect()}
    assert bonds and got.keys() == bonds.keys() and all(abs(got[k] - bonds[k]) < 1e-9 for k in got)

    def overlaps(w, i):
        return any(near(i, j) and i != j and any(np.linalg.norm(w - p) < d for p, d in zip(atoms[j], (2.9, 3.1, 3.1, 2.9))) for j in atoms)

    exposed = set()
    for i in range(8, 64):
        n, ca, c, o = atoms[i]
        if i != 8 and i in hydrogen and not any(d == i for d, _ in bonds) and not overlaps(n + 3 * (hydrogen[i] - n), i):
            exposed.add((i, "NH"))
        z, y = np.cross(c - ca, o - c), (o - c) / np.linalg.norm(o - c)
        x = np.cross(y, z / np.linalg.norm(z))
        waters = [o + 2.8 * (math.cos(math.radians(t)) * x + math.sin(math.radians(t)) * y) for t in (30, 120)]
        if i != 63 and not any(a == i for _, a in bonds) and not all(overlaps(w, i) for w in waters):
            exposed.add((i, "CO"))
    groups = interface.exposed_groups(backbones, found, 3.0)
    assert exposed and {(r.id, r.kind) for r in groups.collect()} == exposed
    total = interface.hbond_totals(found, groups).first()
    kinds = [k for _, k in exposed]
    assert (total.n_hbonds, total.n_exposed_nh, total.n_exposed_co) == (len(bonds), kinds.count("NH"), kinds.count("CO"))
    assert abs(total.energy - (sum(bonds.values()) - 2.8 * kinds.count("NH") - 4.0 * kinds.count("CO"))) < 1e-9


def test_window_identity(spark):
    cases = [("ABCDEFG", 3, "XBCDEFG", 3, 2), ("ABC", 0, "ABC", 0, 5), ("ABCD", 3, "XYZD", 3, 9), ("AAAA", 0, "AAAA", 3, 2), ("ABCDEF", 2, "BCDEF", 1, 3)]
    for s, i, t, j, w in cases:
        row = spark.range(1).select(interface.window_identity(F.lit(s), F.lit(i), F.lit(t), F.lit(j), w).alias("r")).first().r
        lo, hi = -min(w, i, j), min(w, len(s) - 1 - i, len(t) - 1 - j)
        assert tuple(row) == (hi - lo + 1, sum(s[i + k] == t[j + k] for k in range(lo, hi + 1)))


def test_bridge_search_by_superposition(spark):
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    base = rng.normal(size=(6, 3))
    ends = {1: base, 2: base @ turn + 5, 3: base * [1, 1, -1], 4: rng.normal(size=(6, 3))}
    rows = [(i, *(float(np.linalg.norm(e[k] - e[k + 3])) for k in range(3)), e.reshape(-1).tolist()) for i, e in ends.items()]
    df = spark.createDataFrame(rows, "id long, d1 double, d2 double, d3 double, ends array<double>")
    near = {r.r_id for r in interface.bridge_search(df.filter("id = 1"), df, 1e-6).collect()}
    assert near == {1, 2, 3}  # a mirror image has the same distances
    assert {r.r_id for r in interface.bridge_search(df.filter("id = 1"), df, 1e-6, rmsd=1e-6).collect()} == {1, 2}
    assert interface.bridge_search(df, df, 1.0, longest=0.0).count() == 0


def test_chains_and_radii(spark):
    rows = spark.createDataFrame([("m", c, p) for c in "XYZ" for p in range(2)], "name string, chain string, pos long")
    target, binder = interface.split_complex(rows, "Z_X", "Y")
    got = {(r.chain, r.pos, r.resnum) for r in interface.appended(binder, target).collect()}
    assert got == {("A", 0, 1), ("A", 1, 2), ("B", 0, 3), ("B", 1, 4), ("C", 0, 5), ("C", 1, 6)}
    atoms = spark.createDataFrame([("ALA", "CA"), ("ALA", "QQ")], "resname string, atom string")
    radii = spark.createDataFrame([("ALA", "CA", 1.87)], "resname string, atom string, radius double")
    assert {r.atom: r.radius for r in interface.with_radius(atoms, radii).collect()} == {"CA": 1.87, "QQ": 0.0}
    with pytest.raises(Exception, match="no radius"):
        interface.with_radius(atoms, radii, strict=True).collect()
    full = spark.range(1).select(interface.filled(F.create_map(F.lit("a"), F.lit("1")), {"a": "0", "b": "2"}).alias("m")).first().m
    assert full == {"a": "1", "b": "2"}


def test_atoms_between(spark):
    pairs = spark.createDataFrame([(1, (0.0, 0.0, 0.0), (10.0, 0.0, 0.0))], "pair long, p struct<x:double,y:double,z:double>, q struct<x:double,y:double,z:double>")
    atoms = spark.createDataFrame([(5.0, 3.0, 0.0), (5.0, 5.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 4.0, 0.0), (9.0, 0.0, -3.9)], "x double, y double, z double")
    assert interface.atoms_between(pairs, atoms, 4.0, 10.0).first().n == 3


def test_likelihoods(spark):
    rng = np.random.default_rng(5)
    n, k, seq = 4, 3, [0, 2, 1, 1]
    own = rng.normal(size=(n, k))
    pair = {(i, j): rng.normal(size=(k, k)) for i in range(n) for j in range(i + 1, n) if (i, j) != (0, 3)}
    o = spark.createDataFrame([(i, a, float(own[i, a])) for i in range(n) for a in range(k)], "pos long, aa long, e double")
    p = spark.createDataFrame([(i, j, a, b, float(m[a, b])) for (i, j), m in pair.items() for a in range(k) for b in range(k)], "pos_i long, pos_j long, aa_i long, aa_j long, e double")
    s = spark.createDataFrame(list(enumerate(seq)), "pos long, aa long")

    def total(x):
        return sum(own[i, a] for i, a in enumerate(x)) + sum(m[x[i], x[j]] for (i, j), m in pair.items())

    def minus_log(i, *js):
        places = (i, *js)
        states = list(np.ndindex(*[k] * len(places)))
        e = []
        for state in states:
            x = seq.copy()
            for place, a in zip(places, state):
                x[place] = a
            e.append(-total(x))
        at = states.index(tuple(seq[q] for q in places))
        return np.log(np.exp(e).sum()) - e[at]

    got = energy.pseudo_likelihood(o, p, s).first()
    assert got.n == n and abs(got.nlpl - np.mean([minus_log(i) for i in range(n)])) < 1e-9
    got = energy.composite_likelihood(o, p, s).first()
    assert got.n == 2 * len(pair) and abs(got.nlcpl - np.mean([minus_log(i, j) for i, j in pair])) < 1e-9
