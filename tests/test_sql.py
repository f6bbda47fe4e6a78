"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from latticeq.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b


def ordered(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in place) for r in rows]
    return [columns[i] for i in place], sorted(rows, key=lambda r: tuple((x is None, round(x, 3) + 0.0 if isinstance(x, float) else x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_and_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    result = tables.sql(registry.SQL[name])
    columns, got = ordered(df.columns, [tuple(r) for r in df.collect()])
    names, want = ordered(result.columns, result.fetchall())
    assert columns == names and len(got) == len(want)
    assert all(all(map(same, g, w)) for g, w in zip(got, want))
