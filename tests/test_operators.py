"""Operators against plain Python: grid joins, neighbours, grouped algorithms, energies, geometry."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeq.functions import alphabet, geometry, sequences
from latticeq.operators import chains, counting, energy, grouped, selection, spatial
from latticeq.operators.graph import components
from latticeq.staging import Workspace


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("AB"), i % 9, rng.uniform(0.5, 2.0), *(rng.uniform(-4, 4) for _ in range(3))) for i in range(120)] + [(500, "A", 1, 1.0, None, 0.0, 0.0)]
    return rows, spark.createDataFrame(rows, "id long, chain string, pos int, radius double, x double, y double, z double").cache()


def far(p, q):
    return math.dist(p[4:], q[4:])


def test_grid_join_is_the_theta_join(cloud):
    rows, df = cloud
    rows = rows[:-1]
    got = {(r.l_id, r.r_id) for r in spatial.range_join(df, df, 1.3).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows if far(p, q) <= 1.3}
    got = {(r.l_id, r.r_id) for r in spatial.radius_pairs(df, 2.0, 0.7, valid=spatial.residue_pair_allowed(2)).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows if far(p, q) < 0.7 * (p[3] + q[3]) and (p[1] != q[1] or abs(p[2] - q[2]) > 2)}
    near = {r.id: r.n_near for r in spatial.contact_counts(df, df, 1.0, "id").collect()}
    assert near[500] == 0 and all(near[p[0]] == sum(far(p, q) <= 1.0 for q in rows) for p in rows)


def test_nearest_neighbours(cloud):
    rows, df = cloud
    df, rows = df.filter("x IS NOT NULL"), rows[:-1]
    for radius in (0.3, None):
        got = {(r.l_id, r.r_id, r.nth) for r in spatial.nearest(df, df, 5, radius, "id").collect()}
        want = {(p[0], q[0], n + 1) for p in rows for n, q in enumerate(sorted(rows, key=lambda q: (far(p, q) ** 2, q[0]))[:5])}
        assert got == want


def test_angles_wrap(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 2 * math.pi)) for i in range(80)] + [(100, 0.01), (101, 2 * math.pi - 0.01)]
    df = spark.createDataFrame(rows, "id long, t double")
    got = {(r.l_id, r.r_id) for r in spatial.angle_join(df, df, ["t"], 0.3).collect()}
    gap = lambda a, b: min(abs(a - b), 2 * math.pi - abs(a - b))
    assert got == {(i, j) for i, a in rows for j, b in rows if gap(a, b) <= 0.3} and (100, 101) in got


def test_superposition():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(8, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert grouped.superposed_rmsd(p, p @ q + 3) < 1e-6
    assert grouped.superposed_rmsd(p, p * [1, 1, -1]) > 0.1


def test_greedy_selection_and_clusters(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["aaaa", "aaab", "abbb", "bbbb", "cccc"])], "g int, o int, s string")
    assert [r.s for r in grouped.greedy_distinct(rows, "g", "s", "o", 3, 3).orderBy("o").collect()] == ["aaaa", "abbb", "cccc"]
    line = spark.createDataFrame([(1, i, [float(x), 0.0, 0.0]) for i, x in enumerate([0, 1, 2, 10, 11, 30])], "g int, id long, v array<double>")
    got = {r.id: (r.cluster, r.representative) for r in grouped.greedy_clusters(line, "g", "id", "v", 1.0, superpose=False).collect()}
    assert got == {0: (0, False), 1: (0, True), 2: (0, False), 3: (1, True), 4: (1, False), 5: (2, True)}


def test_complete_linkage():
    d = np.abs(np.subtract.outer([0, 1, 2.1, 8, 9], [0, 1, 2.1, 8, 9]))
    assert grouped.complete_linkage(d, 1.5).tolist() == [0, 0, 1, 2, 2]


def test_exact_and_annealed_minimum():
    rng = np.random.default_rng(4)
    own, pair = rng.normal(size=(6, 3)), np.zeros((6, 6, 3, 3))
    for i, j in itertools.combinations(range(6), 2):
        pair[i, j] = rng.normal(size=(3, 3))
        pair[j, i] = pair[i, j].T
    every = sorted((grouped.total_energy(own, pair, np.array(s)), s) for s in itertools.product(range(3), repeat=6))
    best = grouped.exact_minimum(own, pair, 2, 3)
    assert math.isclose(best[0][0], every[0][0]) and tuple(best[0][1]) == every[0][1]
    second = next(e for e, s in every if sum(a != b for a, b in zip(s, best[0][1])) >= 3)
    assert math.isclose(best[1][0], second)
    first, e0, seq, e = grouped.annealed(own, pair, 1, 4000, 2.0, 0.05)
    assert math.isclose(e, every[0][0], abs_tol=1e-9) and e <= e0 and math.isclose(e0, grouped.total_energy(own, pair, first))


def test_energy_deltas_and_merge(spark):
    rng = random.Random(2)
    own = [(p, a, rng.uniform(-1, 1)) for p in range(5) for a in range(3)]
    pair = [(p, q, a, b, rng.uniform(-1, 1)) for p in range(5) for q in range(p + 1, 5) for a in range(3) for b in range(3)]
    seq = [0, 1, 2, 1, 0]
    total = lambda s: sum(e for p, a, e in own if s[p] == a) + sum(e for p, q, a, b, e in pair if s[p] == a and s[q] == b)
    o = spark.createDataFrame(own, "pos long, aa long, e double")
    p = spark.createDataFrame(pair, "pos_i long, pos_j long, aa_i long, aa_j long, e double")
    q = spark.createDataFrame(list(enumerate(seq)), "pos long, aa long")
    for r in energy.mutation_deltas(o, p, q).collect():
        assert abs(r.delta - (total(seq[: r.pos] + [r.aa] + seq[r.pos + 1 :]) - total(seq))) < 1e-9
    twice = p.unionAll(energy.transposed(p.select(F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), "aa_i", "aa_j", "e")))
    once = energy.canonical_pairs(twice)
    assert once.count() == len(pair) and energy.canonical_pairs(once).exceptAll(once).count() == 0
    sums = energy.letter_probabilities(o, ["pos"]).groupBy("pos").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_complexity_of_known_sequences(spark):
    # letters of one kind: no choice, but for the approximation of the factorials
    row = spark.range(1).select(sequences.complexity(F.lit("AAAA")).alias("a"), sequences.complexity(F.lit("ACDEFGHIKLMNPQRSTVWY" * 2)).alias("b"), sequences.complexity(F.lit("")).alias("c")).first()
    stirling = lambda n: 0.5 * math.log(2 * math.pi * n) + n * math.log(n / math.e)
    assert row.a == 0 and row.c is None and abs(row.b - (stirling(40) - 20 * stirling(2)) / 40) < 1e-12


def test_complexity_golden_values(spark):
    # fixed values: designed sequences and their published complexities
    golden = {
        "SEEEQKLNERLRKEVEEKLKDPSPVEVTLEQL": 1.772079689527669, "MLEEEKLDEELIREVEERLKNPQPVEVSIEEL": 1.728867937632283, "SKEEEERDKILRERVKERMKNPEPVEVTLDEL": 1.813180884921566,
        "EKEIEELEKQLIEEVKERLKNPEPVEVTLEEL": 1.5907351519760586, "GREERELEARLIAEVKERRKNPSPVLVTLEDL": 1.8833520132283472,
    }
    rows = spark.createDataFrame([(x,) for x in golden], "s string").select("s", sequences.complexity(F.col("s")).alias("c")).collect()
    assert all(abs(r.c - golden[r.s]) < 1e-12 for r in rows)
    assert all(abs(grouped.letter_complexity(np.frombuffer(x.encode(), np.uint8)) - c) < 1e-12 for x, c in golden.items())


def test_histogram_and_log_odds_values(spark):
    rows = spark.createDataFrame([("g", 0.5, 0.5), ("g", 0.5, 1.5), ("g", 1.5, 0.5), ("g", 9.0, -1.0)], "k string, x double, y double")
    cells = {(r.i, r.j): (r.n, r.density) for r in counting.histogram2d(rows, "x", "y", (0, 2), (0, 4), (2, 4), ["k"]).collect()}
    assert cells == {(0, 0): (1, 0.25), (0, 1): (1, 0.25), (1, 0): (2, 0.5)}  # what lies outside counts for the border
    odds = {(r.g, r.t): r.score for r in counting.log_odds(spark.createDataFrame([("a", "x")] * 3 + [("b", "y")], "g string, t string"), ["g"], "t", 2).collect()}
    assert abs(odds["a", "x"] + math.log2(4 / 5 / 0.75)) < 1e-12 and abs(odds["a", "y"] + math.log2(1 / 5 / 0.25)) < 1e-12


def test_modified_residues(spark):
    names = ["MSE", "FME", "PCA", "DGL", "KYN", "0A9", "CME", "HIS", "0Q4"]
    row = spark.range(1).select(*(alphabet.normal_residue(F.lit(n)).alias(n) for n in names)).first()
    assert list(row) == ["MET", "MET", "GLN", "GLU", "TRP", "PHE", "CYS", "HIS", "0Q4"]


def test_codons_against_a_dictionary(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(rng.randrange(0, 200))) for _ in range(50)]
    got = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i").select(sequences.translate_codons(F.col("s")).alias("p")).collect()]
    for t, p in zip(texts, got):
        want = ""
        for i in range(0, len(t) - 2, 3):
            if t[i : i + 3] not in alphabet.CODONS:
                break
            want += alphabet.CODONS[t[i : i + 3]]
        assert p == want


def test_pair_keys_in_both_orders(spark):
    rows = [("x", t, p) for t, p in (("a", 1), ("b", 1), ("a", 3), ("c", 7))]
    df = spark.createDataFrame(rows, "k string, t string, p long")
    forward = {r.pair_key for r in counting.pair_keys(df, "k", "t", "p", 2).collect()}
    assert forward == {f"{t}_{u}_{q - p}" for _, t, p in rows for _, u, q in rows if 1 <= q - p <= 2}
    compat = {r.pair_key for r in counting.pair_keys(df, "k", "t", "p", 2, compat=True).collect()}
    assert compat == {f"{t}_{u}_{p - q}" for i, (_, t, p) in enumerate(rows) for j, (_, u, q) in enumerate(rows) if i != j and p - q <= 2}


def test_sequences(spark):
    row = spark.range(1).select(
        sequences.identity_percent(F.lit("TIGKCPK"), F.lit("PVGVVPP")).alias("a"), sequences.identity_percent(F.lit("KCPKYVK"), F.lit("SLPPIEE")).alias("b"),
        sequences.reverse_complement(F.lit("AcgTN")).alias("c"), sequences.translate_codons(F.lit("ATGGCCNNNATG")).alias("d"), sequences.translate_codons(F.lit("AT")).alias("e"),
        sequences.trim_stop(F.lit("MAB*CD")).alias("f"), sequences.after_primer(F.lit("xxACGTrest"), "ACGT").alias("g"), sequences.after_primer(F.lit("none"), "ACGT").alias("h"),
        alphabet.residue_letter(F.lit("MSE")).alias("i"), alphabet.residue_number(F.lit("???")).alias("j"), F.size(sequences.radial_basis(F.lit(3.0))).alias("k"),
    ).first()
    assert abs(row.a - 28.57142857142857) < 1e-12 and abs(row.b - 14.285714285714285) < 1e-12
    assert tuple(row)[2:] == ("NAcgT", "MA", "", "AB", "rest", None, "M", 20, 16)
    with pytest.raises(Exception, match="different length"):
        spark.range(1).select(sequences.hamming(F.lit("a"), F.lit("ab"))).collect()


def test_frames(spark):
    point = lambda *c: geometry.vec(*(F.lit(float(x)) for x in c))
    df = spark.range(1).select(geometry.frame(point(1, 0, 0), point(0, 0, 0), point(0, 1, 0)).alias("f"))
    row = df.select(geometry.relative_frame(F.col("f"), F.col("f")).alias("r"), geometry.distance(geometry.virtual_cb(F.col("f")), F.col("f.o")).alias("d")).first()
    assert all(abs(row.r[a][b] - (i == j)) < 1e-12 for i, a in enumerate("xyz") for j, b in enumerate("xyz")) and abs(row.d - 1.5) < 1e-12


def test_below_the_exact_median(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 7, 100, 5001):
        values = [rng.choice([rng.random(), round(rng.random(), 1)]) for _ in range(n)] + [None] * 3
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        known = [v for v in values if v is not None]
        want = sorted(v for v in known if v < np.median(known)) if known else []
        assert sorted(r.v for r in selection.below_median(df, "v").collect()) == want


def test_selection_builders(spark):
    df = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "chain string, resnum string")
    assert df.filter(selection.selected([])).count() == 0
    assert df.filter(selection.selected([("A", set()), ("B", {"9"})])).count() == 2
    parts = [spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")]
    assert {tuple(r) for r in selection.merge_first_wins(parts, "k").collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in selection.merge_last_wins(parts, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_scores_without_matches(spark):
    row = spark.range(1).select(
        counting.native_score(F.lit(0), F.lit(0), F.lit(0.05), F.lit(True)).alias("a"), counting.native_score(F.lit(1), F.lit(2), F.lit(0.05), F.lit(False)).alias("b"),
        counting.native_score(F.lit(3), F.lit(10), F.lit(0.1), F.lit(True)).alias("c"),
    ).first()
    assert (row.a, row.b) == (10.0, -1000.0) and abs(row.c + math.log2(4 / 30 / 0.1)) < 1e-12


def test_bridges_and_gaps(spark):
    df = spark.createDataFrame([("c", i, float(i * i)) for i in range(6)], "chain string, n long, x double")
    rows = chains.bridges(df, "chain", ["n"], ["x"], 1).collect()
    got = {(r.start, r.len): (r.d1, r.d2, r.d3) for r in rows}
    # places count from 1: the ends of (3, 0) are rows 0, 1, 2 and 3, 4, 5
    assert got == {(3, 0): (9.0, 15.0, 21.0)} and rows[0].ends == [0.0, 1.0, 4.0, 9.0, 16.0, 25.0]
    longer = spark.createDataFrame([("c", i, float(i)) for i in range(9)], "chain string, n long, x double")
    assert {(r.start, r.len): r.d2 for r in chains.bridges(longer, "chain", ["n"], ["x"], 2).collect()} == {(s, n): n + 3.0 for s in range(3, 7) for n in range(3) if s + n <= 6}
    runs = chains.gap_groups(df.filter("n <> 3"), "chain", ["n"], "n").orderBy("n").collect()
    assert [r.run for r in runs] == [0, 0, 0, 1, 1] and [r["index"] for r in runs] == [-1, 0, 1, -1, 0]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i * 7919 % 101, (i + 1) * 7919 % 101) for i in range(60)] + [(500, 501)], "a long, b long")
    labels = {r.node: r.label for r in components(links, Workspace(spark, "test")).collect()}
    assert len({labels[i * 7919 % 101] for i in range(61)}) == 1 and labels[500] == labels[501] != labels[0]
