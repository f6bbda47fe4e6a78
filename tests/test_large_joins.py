"""Joins of all pairs in the form that large tables need, against plain Python."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from latticeq.operators import counting, grouped, interface, selection, spatial


def test_unlike_windows(spark):
    """Windows cut at either end, letters of any script, more letters than one number has; as ``not_homologous`` has them."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abé世" if k % 3 else "a") for _ in range(rng.randint(0, 24)))) for k in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "key long, s string")
    for places, w in (([(0, 2), (20, 18)], 5), ([(3, 3), (9, 7), (12, 1)], 12)):
        got = {(r.query, r.match): r.identity for r in interface.unlike_windows(df, "key", "s", F.col("key") % 2 == 0, places, w, 0.5).collect()}
        want = {}
        for a, s in rows[::2]:
            for b, t in rows:
                if a == b or s is None or t is None:
                    continue
                met = [(i + k, j + k) for i, j in places for k in range(-w, w + 1) if 0 <= i + k < len(s) and 0 <= j + k < len(t)]
                if met and sum(s[x] == t[y] for x, y in met) / len(met) < 0.5:
                    want[a, b] = sum(s[x] == t[y] for x, y in met) / len(met)
        assert got == want and got
    # no text goes through the join of all pairs
    assert "substr" not in interface.unlike_windows(df, "key", "s", F.lit(True), [(0, 0)], 3, 0.5)._jdf.queryExecution().optimizedPlan().toString()


def test_cross_pairs_use_all_cores(spark):
    a, b = spark.range(0, 9, numPartitions=1), spark.range(9, 12, numPartitions=1)
    out = selection.cross_pairs(a, b, "id")
    assert sorted(map(tuple, out.collect())) == sorted([(x, y) for x in range(9) for y in range(9, 12)] + [(y, x) for x in range(9) for y in range(9, 12)])
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_points_within():
    """As one superposition at a time has it: also mirror images, points on a line or in one place, equal ones and other sizes."""
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(60, 21)), rng.normal(size=(50, 21))
    q[:20] = p[:20] + rng.normal(size=(20, 21)) * rng.uniform(0, 0.6, (20, 1))
    q[20:25] = (p[20:25].reshape(5, 7, 3) * [1, 1, -1]).reshape(5, 21)
    q[25:30] = p[25:30]
    q[30:34, 3:] = np.tile(q[30:34, :3], 6)
    p[30:34] = np.outer(rng.normal(size=4), np.arange(21) // 3 * 1.0)
    for cutoff in (0.0, 0.3, 0.6, 1.0, 1.4):
        want = np.array([[grouped.superposed_rmsd(x.reshape(-1, 3), y.reshape(-1, 3)) for y in q] for x in p])
        got = grouped.points_within(p, q, cutoff)
        assert (got == (want <= cutoff))[np.abs(want - cutoff) > 1e-7].all()
        want = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
        assert (grouped.points_within(p, q, cutoff * 4, superpose=False) == (want <= cutoff * 4)).all()


def test_greedy_clusters_measure_equal_points_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(40, 12))] * 5)
    points[:40] += rng.normal(size=(40, 12)) * 0.2
    asked = []
    real = grouped.points_within
    monkeypatch.setattr(grouped, "points_within", lambda p, q, *a: asked.append(len(p) * len(q)) or real(p, q, *a))
    cluster, head = grouped._greedy(points, 0.7, 0.9, True)
    assert max(asked) <= 80 * 80
    d = np.array([[grouped.superposed_rmsd(x.reshape(-1, 3), y.reshape(-1, 3)) for y in points] for x in points]) <= 0.7
    np.fill_diagonal(d, True)
    free, number = np.ones(200, bool), 0
    while free.any():
        best = int(np.where(free, (d & free).sum(axis=1), -1).argmax()) if 1 - free.mean() < 0.9 else int(np.flatnonzero(free)[0])
        members = d[best] & free if 1 - free.mean() < 0.9 else np.arange(200) == best
        assert (cluster[members] == number).all() and head[best]
        free &= ~members
        number += 1
    assert cluster.max() == number - 1 and head.sum() == number


def test_vector_pairs(spark, monkeypatch):
    """Crowded cells in several blocks, negative cells, other lengths, nulls; no vector is joined to a pair."""
    monkeypatch.setattr(spatial, "VECTORS", 16)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(scale=0.1, size=(150, 5)), np.zeros((40, 5))]).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(500, [0.0] * 4), (501, [0.0] * 4), (502, None), (503, [0.0, 0.0, 0.0, None, 0.0]), (504, [0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    out = spatial.vector_pairs(df, "id", "v", 3, 0.08, 0.25)
    w = v.astype(float)
    want = {(a, b) for a in range(190) for b in range(a + 1, 190) if (np.abs(w[a, :3] - w[b, :3]) <= 0.08).all() and np.sqrt(((w[a] - w[b]) ** 2).sum()) <= 0.25} | {(500, 501)}
    got = [(r.a, r.b) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(abs(r.distance - np.sqrt(((w[r.a] - w[r.b]) ** 2).sum())) < 1e-12 for r in out.filter("a < 190").collect())


def test_similar_sets(spark, monkeypatch):
    """Members in several groups, pairs counted in several goes; those of ``set_similarity`` from the share on."""
    monkeypatch.setattr(counting, "GROUP_MEMBERS", 900)
    monkeypatch.setattr(counting, "PAIRS_AT_ONCE", 500)
    monkeypatch.setattr(counting, "BITMAP_MEMBERS", 4)
    rng = random.Random(9)
    sets = {k: set(rng.sample(range(k // 10 * 60, k // 10 * 60 + 120), rng.randint(1, 60))) for k in range(120)}
    df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s] + [(5, None), (None, 3)], "k long, m long")
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in counting.similar_sets(df, "k", "m", 0.25).collect()}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    assert got == {p: v for p, v in want.items() if v[1] >= 0.25} and len(got) > 20

def test_similar_sets_by_blocks_of_keys(spark, monkeypatch):
    """Groups larger than a task may hold: blocks of keys meet in tasks, none of which holds more, and no pair is lost."""
    monkeypatch.setattr(counting, "BITMAP_MEMBERS", 4)
    rng = random.Random(10)
    sets = {k: set(rng.sample(range(k // 10 * 60, k // 10 * 60 + 120), rng.randint(1, 60))) for k in range(-60, 60)}
    df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s], "k long, m long")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: v for p, v in want.items() if v >= 0.25}
    for shared in (2, 6, 1000):
        monkeypatch.setattr(counting, "GROUP_MEMBERS", 100)
        monkeypatch.setattr(counting, "PAIRS_AT_ONCE", 300)
        monkeypatch.setattr(counting, "GROUP_SHARED", shared)
        out = counting.similar_sets(df, "k", "m", 0.25)
        assert {(r.a, r.b): r.jaccard for r in out.collect()} == want and len(want) > 20


def test_a_task_holds_few_members():
    """What the counting of a group's pairs takes, beside the pieces that it is given and empties, stays below 50 bytes a member."""
    rng = np.random.default_rng(11)
    n = 1_000_000
    run = np.sort(rng.integers(0, n // 10, n)).astype(np.int32)
    key = rng.integers(0, 10_000, n)
    pieces = [np.array_split(x, 10) for x in (key, run, np.full(n, 100, np.int32), np.zeros(n, bool))]
    tracemalloc.start()
    a, b = counting._met_often(*pieces, 0.25, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * n + 60 * counting.PAIRS_AT_ONCE and all(x is None for p in pieces for x in p) and len(a) == len(b)


def test_cross_pairs_are_written_in_little_space(spark, tmp_path):
    """Many keys on a side: all pairs, repeated and null keys too, in columns of far less than a byte a pair."""
    a, b = spark.range(40, numPartitions=1), spark.range(100, 60_100, numPartitions=1)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if neither side were small
    try:
        selection.cross_pairs(a, b, "id").write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    back = spark.read.parquet(str(tmp_path / "pairs"))
    assert back.count() == back.distinct().count() == 2 * 40 * 60_000 and back.filter("(first < 40) = (second < 40)").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 2 * 40 * 60_000
    keys = [*range(600), 3, 3, None]
    got = selection.cross_pairs(spark.createDataFrame([(k,) for k in keys], "id long"), None, "id", symmetric=True)
    known = keys[:-1]
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in known for y in known if x != y)
