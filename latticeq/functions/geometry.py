"""Vectors, residue frames, contacts and hydrogen bonds as column expressions over struct<x,y,z>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it: keeps nested expressions small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: Column, b: Column) -> Column:
    return vec(a.x - b.x, a.y - b.y, a.z - b.z)


def scale(a: Column, k) -> Column:
    return vec(a.x * k, a.y * k, a.z * k)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Column, b: Column) -> Column:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1 in the same direction; null for the zero vector."""
    return let(a, lambda v: F.when(dot(v, v) > 0, scale(v, 1 / norm(v))))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, in radians."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Torsion about b-c in radians, in (-pi, pi]."""
    steps = F.struct(sub(b, a).alias("u"), sub(c, b).alias("v"), sub(d, c).alias("w"))
    normals = let(steps, lambda s: F.struct(cross(s.u, s.v).alias("m"), cross(s.v, s.w).alias("n"), unit(s.v).alias("v")))
    return let(normals, lambda s: F.atan2(dot(cross(s.m, s.n), s.v), dot(s.m, s.n)))


def frame(n: Column, ca: Column, c: Column) -> Column:
    """Residue frame: origin at CA, z = (C - CA) x (CA - N), y = (CA - N) - (C - CA), x = y x z, as unit vectors."""
    steps = F.struct(sub(ca, n).alias("i"), sub(c, ca).alias("o"), ca.alias("ca"))
    axes = let(steps, lambda s: F.struct(unit(cross(s.o, s.i)).alias("z"), unit(sub(s.i, s.o)).alias("y"), s.ca.alias("ca")))
    return let(axes, lambda s: F.struct(s.ca.alias("o"), cross(s.y, s.z).alias("x"), s.y.alias("y"), s.z.alias("z")))


def in_frame(f: Column, p: Column) -> Column:
    """Coordinates of a point in a frame."""
    return let(F.struct(f.alias("f"), sub(p, f.o).alias("d")), lambda s: vec(dot(s.d, s.f.x), dot(s.d, s.f.y), dot(s.d, s.f.z)))


def relative_frame(f: Column, g: Column) -> Column:
    """Frame g seen from frame f."""

    def seen(s: Column) -> Column:
        turn = lambda v: vec(dot(v, s.f.x), dot(v, s.f.y), dot(v, s.f.z))
        return F.struct(in_frame(s.f, s.g.o).alias("o"), turn(s.g.x).alias("x"), turn(s.g.y).alias("y"), turn(s.g.z).alias("z"))

    return let(F.struct(f.alias("f"), g.alias("g")), seen)


def circular(a: Column) -> Column:
    """An angle brought into [0, 2 pi)."""
    return F.pmod(a, F.lit(2 * math.pi))


def frame_angles(f: Column) -> Column:
    """Three circular angles of a frame: of its x axis in the xy plane, of y in the yz plane, of z in the zx plane."""
    return F.array(circular(F.atan2(f.x.y, f.x.x)), circular(F.atan2(f.y.z, f.y.y)), circular(F.atan2(f.z.x, f.z.z)))


def circular_deviation(a: Column, b: Column) -> Column:
    """Distance of two angles on the circle, at most pi."""
    d = F.pmod(F.abs(a - b), F.lit(2 * math.pi))
    return F.least(d, F.lit(2 * math.pi) - d)


# fixed values: spherical position of the virtual CB in the residue frame: distance, polar and azimuth angle in degrees.
CB_R, CB_POLAR, CB_AZIMUTH = 1.5, 37.794, 87.948


def virtual_cb(f: Column) -> Column:
    """Virtual CB of a frame."""
    polar, azimuth = math.radians(CB_POLAR), math.radians(CB_AZIMUTH)
    local = (CB_R * math.sin(polar) * math.cos(azimuth), CB_R * math.sin(polar) * math.sin(azimuth), CB_R * math.cos(polar))
    return let(f, lambda s: vec(*(s.o[k] + s.x[k] * local[0] + s.y[k] * local[1] + s.z[k] * local[2] for k in "xyz")))


def ideal_cb(n: Column, ca: Column, c: Column) -> Column:
    """CB from backbone atoms by the usual linear form."""
    b, e = sub(ca, n), sub(c, ca)
    return add(add(add(scale(cross(b, e), -0.58273431), scale(b, 0.56802827)), scale(e, -0.54067466)), ca)


def normalised_cb(d: Column, low: float, high: float) -> Column:
    """A CB distance as a share of its possible range."""
    return (d - low) / (high - low)


def cb_angle(ca: Column, cb: Column, other: Column) -> Column:
    """Cosine of CA->CB against CA->other CA."""
    return cosine(sub(cb, ca), sub(other, ca))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment, null where its foot lies beyond an end."""
    ab = sub(b, a)
    t = F.try_divide(dot(sub(p, a), ab), dot(ab, ab))
    return F.when((t >= 0) & (t <= 1), distance(p, add(a, scale(ab, t))))


def atom_class(d: Column, ra: Column, rb: Column, clash: float = 0.7, contact: float = 1.0) -> Column:
    """clash, contact or none, by the distance against scaled sums of radii."""
    return F.when(d < (ra + rb) * clash, "clash").when(d < (ra + rb) * contact, "contact").otherwise("none")


BACKBONE = ("N", "CA", "C", "O", "OXT")


def contact_type(a: Column, b: Column) -> Column:
    """BB, BS, SB or SS by whether each atom name is of the backbone."""
    side = lambda x: F.when(x.isin(*BACKBONE), "B").otherwise("S")
    return F.concat(side(a), side(b))


def amide_hydrogen(n: Column, ca: Column, previous_c: Column, length: float = 1.0) -> Column:
    """H against the bisector of the directions from N to CA and to the previous C."""
    return add(n, scale(unit(add(unit(sub(n, ca)), unit(sub(n, previous_c)))), length))


def lone_pair_normal(ca: Column, c: Column, o: Column) -> Column:
    """Normal of the plane of a carbonyl oxygen's lone pairs: (C - CA) x (O - C)."""
    return cross(sub(c, ca), sub(o, c))


# fixed values: depth and distance of the N...O well, energy below which there is a bond, energies of an exposed NH and CO
HBOND_DEPTH, HBOND_BEST, HBOND_CUT, EXPOSED_NH, EXPOSED_CO = 2.8, 3.0, -0.25, -2.8, -4.0


def hbond_energy(n: Column, h: Column, donor_c: Column, donor_o: Column, ca: Column, c: Column, o: Column) -> Column:
    """Energy of a hydrogen bond from a donor's N-H to an acceptor's O: an 8-6 well in N...O times two angular terms.

    The first falls with the angle of N->H against H->O. The second takes O->H apart along the normal of the acceptor's
    lone-pair plane: the angle out of the plane, and within it the angle against the donor's carbonyl bond, with other
    formulas below 90, below 110 and beyond. Distances at which the well alone is above -0.25 give 0; null without H.
    """
    r = F.lit(HBOND_BEST) / distance(n, o)
    well = HBOND_DEPTH * (3 * F.pow(r, F.lit(8.0)) - 4 * F.pow(r, F.lit(6.0)))
    steps = F.struct(angle(sub(h, n), sub(o, h)).alias("t"), sub(h, o).alias("v"), lone_pair_normal(ca, c, o).alias("k"), sub(donor_o, donor_c).alias("b"), well.alias("well"))
    plane = lambda s: sub(s.v, scale(s.k, dot(s.v, s.k) / dot(s.k, s.k)))
    angles = let(steps, lambda s: F.struct(s.well.alias("well"), s.t.alias("t"), F.abs(math.pi / 2 - angle(s.v, s.k)).alias("out"), angle(plane(s), s.b).alias("within")))
    far = math.radians(110)
    k1, k2 = 0.9 / math.cos(far) ** 6, math.cos(far) ** 2

    def energy(s: Column) -> Column:
        first = F.when(s.t < math.pi / 2, F.pow(F.cos(s.t), F.lit(2.0))).otherwise(0.0)
        near = (0.9 + 0.1 * F.sin(2 * s.within)) * F.cos(s.out)
        wide = k1 * F.pow(k2 - F.pow(F.cos(s.within), F.lit(2.0)), F.lit(3.0)) * F.cos(s.out)
        second = F.when(s.within < math.pi / 2, near).when(s.within < far, wide).otherwise(0.0)
        return F.when(s.well > HBOND_CUT, 0.0).otherwise(s.well * first * second)

    return let(angles, energy)


def water_position(h: Column, n: Column, length: float = 3.0) -> Column:
    """Where a water's oxygen would stand before an NH: from N through H."""
    return add(n, scale(unit(sub(h, n)), length))


def carbonyl_waters(ca: Column, c: Column, o: Column, length: float = 2.8) -> Column:
    """Where two waters' oxygens would stand at a carbonyl's lone pairs: 30 and 120 degrees in their plane, from y x z to C->O."""
    steps = let(F.struct(unit(lone_pair_normal(ca, c, o)).alias("z"), unit(sub(o, c)).alias("y"), o.alias("o")), lambda s: F.struct(cross(s.y, s.z).alias("x"), s.y.alias("y"), s.o.alias("o")))
    place = lambda s, turn: add(s.o, add(scale(s.x, length * math.cos(math.radians(turn))), scale(s.y, length * math.sin(math.radians(turn)))))
    return let(steps, lambda s: F.array(place(s, 30), place(s, 120)))


# fixed values: least distances of a water's oxygen from N and O, and from CA and C
WATER_NO, WATER_C = 2.9, 3.1


def water_overlaps(w: Column, n: Column, ca: Column, c: Column, o: Column) -> Column:
    """Whether a water would overlap one of a residue's backbone atoms."""
    return (distance(w, n) < WATER_NO) | (distance(w, ca) < WATER_C) | (distance(w, c) < WATER_C) | (distance(w, o) < WATER_NO)
