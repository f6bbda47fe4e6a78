"""Features of residue graphs as column expressions: dihedrals, directions, rotations, positions along the chain."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeq.functions.geometry import dot, in_frame, let, unit, vec


def dihedral_features(*angles: Column) -> Column:
    """Cosines, then sines of dihedral angles; a missing one counts as 0 radians."""
    known = [F.coalesce(a, F.lit(0.0)) for a in angles]
    return F.array(*(F.cos(a) for a in known), *(F.sin(a) for a in known))


def position_encoding(offset: Column, n: int = 16) -> Column:
    """Cosines, then sines of an offset along the chain at n / 2 geometric frequencies."""
    rates = [math.exp(i * -(math.log(10000.0) / n)) for i in range(0, n, 2)]
    return F.array(*(F.cos(offset * r) for r in rates), *(F.sin(offset * r) for r in rates))


def direction(frame: Column, point: Column) -> Column:
    """Unit vector to a point in a frame's axes; zero if the point is its origin."""
    return F.coalesce(unit(in_frame(frame, point)), vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def rotation(f: Column, g: Column) -> Column:
    """Rotation from frame f to g, row by row: nine numbers, axis of f times axis of g."""
    return let(F.struct(f.alias("f"), g.alias("g")), lambda s: F.array(*(dot(s.f[a], s.g[b]) for a in "xyz" for b in "xyz")))


def quaternion(r: Column) -> Column:
    """Unit quaternion (x, y, z, w) of a rotation of nine numbers, row by row."""

    def parts(m: Column) -> Column:
        at = lambda i, j: m[3 * i + j]
        size = lambda a, b, c: 0.5 * F.sqrt(F.abs(1 + a + b + c))
        x = F.signum(at(2, 1) - at(1, 2)) * size(at(0, 0), -at(1, 1), -at(2, 2))
        y = F.signum(at(0, 2) - at(2, 0)) * size(-at(0, 0), at(1, 1), -at(2, 2))
        z = F.signum(at(1, 0) - at(0, 1)) * size(-at(0, 0), -at(1, 1), at(2, 2))
        w = F.sqrt(F.greatest(F.lit(0.0), 1 + at(0, 0) + at(1, 1) + at(2, 2))) / 2
        return F.array(x, y, z, w)

    norm = lambda q: F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return let(let(r, parts), lambda q: let(norm(q), lambda n: F.transform(q, lambda v: v / F.greatest(n, F.lit(1e-12)))))


def transposed(matrix: Column, rows: int, columns: int) -> Column:
    """A matrix of numbers row by row, turned over."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda k: F.element_at(matrix, (F.pmod(k, F.lit(rows)) * columns + F.floor(k / rows) + 1).cast("int")))


def diagonal(matrix: Column, n: int) -> Column:
    """The diagonal of an n by n matrix of numbers row by row."""
    return F.array(*(F.element_at(matrix, i * n + i + 1) for i in range(n)))
