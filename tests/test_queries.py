"""Registered queries over the whole tables, against plain Python on the smallest ones."""

from __future__ import annotations

import collections
import math

import numpy as np
import pyarrow.parquet as pq

from latticeq.operators import grouped
from latticeq.plans import relational, structural

SF = "/root/testdata/sf0.001"


def rows_of(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))[c].to_pylist() for c in columns)))


def test_similarity_of_queries_with_all_customers(spark):
    customer, brand = dict(rows_of("orders", "o_orderkey", "o_custkey")), dict(rows_of("part", "p_partkey", "p_brand"))
    sets: dict = {}
    for order, part in rows_of("lineitem", "l_orderkey", "l_partkey"):
        if order in customer and part in brand:
            sets.setdefault(customer[order], set()).add(brand[part])
    shared = {(a, b): len(sets[a] & sets[b]) for a in sets if a % 100 == 0 for b in sets if a != b}
    value = {(a, b): round(n / len(sets[a] | sets[b]), 6) if max(len(sets[a]), len(sets[b])) >= 10 else 0.0 for (a, b), n in shared.items()}
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in relational.jaccard_pairs(spark, SF).collect()}
    assert got and got == {k: (n, value[k]) for k, n in shared.items() if n}
    assert {(r.a, r.b): r.jaccard for r in relational.jaccard_matrix(spark, SF).collect()} == value | {(a, a): 1.0 for a in sets if a % 100 == 0}


def test_density_of_every_row(spark):
    def bin_of(row):
        _, _, flag, quantity, discount = row
        i, j = math.floor((float(quantity) - 1) / ((51 - 1) / 10.0)), math.floor(float(discount) / (0.1 / 5))
        return flag, max(0, min(9, i)), max(0, min(4, j))

    rows = rows_of("lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    n, total = collections.Counter(map(bin_of, rows)), collections.Counter(r[2] for r in rows)
    want = sorted((r[0], r[1], n[bin_of(r)] / total[r[2]] / (5.0 * (0.1 / 5))) for r in rows)
    got = sorted((r.l_orderkey, r.l_linenumber, r.density) for r in relational.hist2d_lookup(spark, SF).collect())
    assert len(got) == len(want)
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want))


def test_clusters_of_all_suppliers(spark):
    parts = {k: set() for (k,) in rows_of("supplier", "s_suppkey")}
    for supplier, part in rows_of("lineitem", "l_suppkey", "l_partkey"):
        parts[supplier].add(part)
    keys = sorted(parts)
    d = np.array([[1 - len(parts[a] & parts[b]) / max(1, len(parts[a] | parts[b])) for b in keys] for a in keys])
    got = {r.key: r.cluster for r in structural.complete_linkage(spark, SF).collect()}
    assert got == dict(zip(keys, grouped.complete_linkage(d, 0.75).tolist()))


def test_overlap_of_queries_with_all_vectors(spark):
    v = {k: np.array(e[:63], float).reshape(-1, 3) for k, e in rows_of("embeddings", "vec_id", "embedding")}
    far = {(a, b): grouped.superposed_rmsd(v[a][:2], v[b][-2:]) for a in v if a % 100 == 0 for b in v}
    assert {(r.src, r.dst) for r in structural.segment_overlap_graph(spark, SF).collect()} == {k for k, x in far.items() if x <= 0.08}
    assert any(b % 10 for (_, b), x in far.items() if x <= 0.08)


def test_best_windows_of_queries_with_all_chains(spark):
    chains: dict = {}
    for user, _, _, value in sorted(rows_of("events", "user_id", "ts", "event_id", "value")):
        chains.setdefault(user, []).append(value)
    got = {(r.a, r.b): r.rmsd for r in structural.best_window_alignment(spark, SF).collect()}
    windows = {c: [np.array(v[i : i + 3], float) for i in range(len(v) - 2)] for c, v in chains.items()}
    want = {
        (a, b): min(math.sqrt(((x - y) ** 2).mean()) for x in windows[a] for y in windows[b])
        for a in windows if a % 100 == 0 for b in windows if a != b and windows[a] and windows[b]
    }
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
