"""Targets and binders: chains, neighbours, contacts, frames, bridges, homology and hydrogen bonds between them."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeq.functions import geometry as g
from latticeq.functions.geometry import circular_deviation
from latticeq.operators.grouped import kabsch
from latticeq.operators.spatial import cell_columns, range_join, surrounded
from latticeq.staging import Workspace, ship


def listed(chain: Column, chains: Column | str) -> Column:
    """Whether a chain is in a list of chains joined by ``_``."""
    return F.array_contains(F.split(F.lit(chains) if isinstance(chains, str) else chains, "_"), chain)


def split_complex(residues: DataFrame, target: str, binder: str, chain: str = "chain") -> tuple[DataFrame, DataFrame]:
    """Rows of the target's chains and of the binder's; rows of neither are left out."""
    return residues.filter(listed(F.col(chain), target)), residues.filter(listed(F.col(chain), binder))


def appended(binder: DataFrame, target: DataFrame, by: str = "name", chain: str = "chain", pos: str = "pos") -> DataFrame:
    """Binder rows as chain A with the target's chains behind them as B, C, .. in the order of their names.

    Both are numbered on without a break: by, chain, resnum and the other columns of both.
    """
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    rows = binder.withColumn("__part", F.lit(0)).unionByName(target.withColumn("__part", F.lit(1)))
    order = Window.partitionBy(by).orderBy("__part", chain, pos)
    nth = F.when(F.col("__part") == 0, 0).otherwise(F.dense_rank().over(Window.partitionBy(by, "__part").orderBy(chain)))
    out = rows.withColumns({"resnum": F.row_number().over(order).cast("long"), "__letter": F.substr(letters, nth + 1, F.lit(1))})
    return out.drop("__part", chain).withColumnRenamed("__letter", chain)


def long_enough(residues: DataFrame, by: list[str], least: int, most: int | None = None) -> DataFrame:
    """Rows of structures with at least ``least`` residues, and at most ``most``."""
    sizes = residues.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    keep = F.col("__n") >= least
    sizes = sizes.filter(keep if most is None else keep & (F.col("__n") <= most)).drop("__n")
    return residues.join(sizes, by, "left_semi")


def with_target(binders: DataFrame, target: DataFrame, features: list[str]) -> DataFrame:
    """Binders with the arrays of their target's one row before their own."""
    one = target.limit(1).select(*(F.col(f).alias(f"__{f}") for f in features))
    out = binders.crossJoin(F.broadcast(one))  # a single row
    return out.withColumns({f: F.concat(f"__{f}", f) for f in features}).drop(*(f"__{f}" for f in features))


def filled(given: Column, defaults: dict[str, str]) -> Column:
    """A map with the defaults of keys that it lacks."""
    base = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    return F.map_zip_with(base, F.coalesce(given, base), lambda _, d, v: F.coalesce(v, d))


def centres(atoms: DataFrame, by: list[str], axes=("x", "y", "z")) -> DataFrame:
    """Geometric centre of each structure: by and the axes."""
    return atoms.groupBy(*by).agg(*(F.avg(a).alias(a) for a in axes))


def bounding_box(points: DataFrame, pad: float = 0.0, axes=("x", "y", "z")) -> DataFrame:
    """One row with the least and largest coordinate of each axis, moved out by ``pad``: x_min, x_max, .."""
    return points.agg(*(f for a in axes for f in ((F.min(a) - pad).alias(f"{a}_min"), (F.max(a) + pad).alias(f"{a}_max"))))


def with_radius(atoms: DataFrame, radii: DataFrame, strict: bool = False) -> DataFrame:
    """Atoms with the radius of their residue and name; unknown ones have 0 (strict: an error)."""
    out = atoms.join(radii.select("resname", "atom", F.col("radius").alias("__r")), ["resname", "atom"], "left")
    missing = F.raise_error(F.concat(F.lit("no radius of "), "resname", F.lit(" "), "atom")).cast("double") if strict else F.lit(0.0)
    return out.withColumn("radius", F.coalesce("__r", missing)).drop("__r")


def in_contact(d: Column, ra: Column, rb: Column, low: float = 0.7, high: float = 1.2) -> Column:
    """Whether a distance is from ``low`` to below ``high`` times the sum of two radii."""
    return (d >= (ra + rb) * low) & (d < (ra + rb) * high)


def contact_flags(pairs: DataFrame, contacts: DataFrame, kinds: list[str], a: str = "a", b: str = "b", kind: str = "kind") -> DataFrame:
    """Pairs with a flag for each kind of contact: whether it holds between them."""
    flags = contacts.groupBy(a, b).agg(*(F.max((F.col(kind) == k).cast("int")).alias(f"is_{k}") for k in kinds))
    out = pairs.join(flags, [a, b], "left")
    return out.withColumns({f"is_{k}": F.coalesce(F.col(f"is_{k}") == 1, F.lit(False)) for k in kinds})


def potential_contacts(pairs: DataFrame, least: float = 0.05, reach: float = 8.0) -> DataFrame:
    """Pairs that a density says can touch, with ``ss``, ``sb`` and ``bb``.

    Columns: ss_density and sb_density as ``counting.density_lookup`` gives them (null: no histogram for the residue),
    distance of the CA, backbone (whether backbone atoms are in contact, see ``in_contact``). Backbones are asked only
    within ``reach``. A pair stays for side chains or backbones.
    """
    ss = F.coalesce(F.col("ss_density") >= least, F.lit(False))
    sb = F.coalesce(F.col("sb_density") >= least, F.lit(False))
    bb = (F.col("distance") <= reach) & F.coalesce("backbone", F.lit(False))
    return pairs.withColumns({"ss": ss, "sb": sb, "bb": bb}).filter("ss OR bb")


def designable(ss_density: Column, sb_density: Column, least: float = 0.0025) -> Column:
    """Whether both clash densities of a pair are high enough; without side-chain to backbone data the first alone."""
    return (ss_density >= least) & F.coalesce(sb_density >= least, F.lit(True))


def atoms_between(pairs: DataFrame, atoms: DataFrame, width: float, reach: float, key: str = "pair") -> DataFrame:
    """Number of atoms in the cylinder of radius ``width`` about the segment of each pair: key, n.

    pairs: key, p and q (struct x, y, z) at most ``reach`` apart; an atom whose foot lies beyond an end is not counted.
    """
    middles = pairs.select(key, "p", "q", *(((F.col("p")[a] + F.col("q")[a]) / 2).alias(a) for a in "xyz"))
    within = g.segment_distance(g.vec(F.col("r_x"), F.col("r_y"), F.col("r_z")), F.col("l_p"), F.col("l_q")) <= width
    near = range_join(middles, atoms, math.hypot(reach / 2, width), within=within)
    counts = near.groupBy(F.col(f"l_{key}").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def frame_matches(queries: DataFrame, frames: DataFrame, far: float, turn: float, angles=("alpha", "beta", "gamma"), within: Column | None = None) -> DataFrame:
    """Pairs (l_*, r_*) of frames at most ``far`` apart whose three angles deviate by at most ``turn`` radians together."""
    dev = sum((circular_deviation(F.col(f"l_{a}"), F.col(f"r_{a}")) for a in angles), F.lit(0.0))
    return range_join(queries, frames, far, within=(dev <= turn) if within is None else (dev <= turn) & within)


def bridge_search(queries: DataFrame, bridges: DataFrame, cutoff: float, longest: float | None = None, rmsd: float | None = None, within: Column | None = None) -> DataFrame:
    """Pairs (l_*, r_*) of query ends and bridges whose three distances are within ``cutoff`` as a vector.

    Queries whose middle distance d2 is over ``longest`` are left out. With ``rmsd`` the coordinates of the ends are then
    superposed, and pairs at most so far apart stay, with column rmsd.
    """
    asked = queries if longest is None else queries.filter(F.col("d2") <= longest)
    found = range_join(asked, bridges, cutoff, ("d1", "d2", "d3"), within)
    return found if rmsd is None else found.withColumn("rmsd", kabsch("l_ends", "r_ends")).filter(F.col("rmsd") <= rmsd)


def window_identity(s: Column, i: Column, t: Column, j: Column, w: int) -> Column:
    """struct(length, same) of the letters around place i of s and j of t (from 0), w on each side as far as both reach."""
    back = F.least(F.lit(w), i, j).cast("int")
    on = F.least(F.lit(w), F.length(s) - 1 - i, F.length(t) - 1 - j).cast("int")
    size = back + on + 1
    cut = lambda x, k: F.split(F.substr(x, (k - back + 1).cast("int"), size), "")
    same = F.aggregate(F.zip_with(cut(s, i), cut(t, j), lambda a, b: (a == b).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    # the split of a string has an empty piece at its end in both, or in neither
    pad = F.size(cut(s, i)) - size
    return F.struct(size.cast("long").alias("length"), (same - pad).alias("same"))


def not_homologous(matches: DataFrame, w: int = 15, threshold: float = 0.6) -> DataFrame:
    """Matches without those whose two residues stand in like sequences.

    Columns: query_i, query_j, match_i, match_j (sequences of the chains) and qi, qj, mi, mj (places, from 0). The share of
    equal letters over both windows together must be below ``threshold``.
    """
    one = window_identity(F.col("query_i"), F.col("qi"), F.col("match_i"), F.col("mi"), w)
    two = window_identity(F.col("query_j"), F.col("qj"), F.col("match_j"), F.col("mj"), w)
    share = F.try_divide(one.same + two.same, one.length + two.length)
    return matches.withColumn("identity", share).filter(F.col("identity") < threshold)


#: Letters in one number of a bit plane. Numbers of the queries' side that is broadcast.
PLANE, BROADCAST_NUMBERS = 60, 4_000_000


def unlike_windows(sequences: DataFrame, key: str, sequence: str, queries: Column, places: list[tuple[int, int]], w: int, threshold: float) -> DataFrame:
    """``not_homologous`` for each query, a condition on the key, with every other key: query, match, identity.

    ``places``, from 0, are those of the query and of the match, a pair for each window. Letters are numbered, and the bits of
    their numbers are planes over all windows, so that a pair costs a few operations on whole numbers and no text.
    """
    work = Workspace(sequences.sparkSession, "windows")
    spots = [[place[side] + k for place in places for k in range(-w, w + 1)] for side in (0, 1)]
    # there is no letter before the first and behind the last
    letters = lambda at: F.array(*(F.substring(sequence, k + 1, 1) if k >= 0 else F.substring(sequence, 1, 0) for k in at))
    rows = work.table(sequences.select(key, letters(spots[0]).alias("q"), letters(spots[1]).alias("m")))
    names = ["", *(r.letter for r in rows.select(F.explode(F.concat("q", "m")).alias("letter")).filter("letter <> ''").distinct().collect())]
    parts, depth = range(0, len(spots[0]), PLANE), (len(names) - 1).bit_length()

    def planes(name: str, rows: DataFrame) -> DataFrame:
        numbers = F.transform(name, lambda c: F.array_position(F.array(*map(F.lit, names)), c) - 1)
        plane = lambda at, bit: F.aggregate(F.slice("numbers", at + 1, PLANE), F.lit(0).cast("long"), lambda t, c: t * 2 + bit(c))
        there = [plane(at, lambda c: (c > 0).cast("long")).alias(f"{name}{at}") for at in parts]
        bits = [plane(at, lambda c, p=p: F.shiftright(c, p).bitwiseAND(F.lit(1).cast("long"))).alias(f"{name}{at}_{p}") for at in parts for p in range(depth)]
        return rows.withColumn("numbers", numbers).select(F.col(key).alias({"q": "query", "m": "match"}[name]), *there, *bits)

    a = work.table(planes("q", rows.filter(queries)))
    if a.count() * len(a.columns) <= BROADCAST_NUMBERS:
        a = F.broadcast(a)
    # the matches are dealt out; the queries come whole to each part
    b = work.table(planes("m", rows)).repartition(sequences.sparkSession.sparkContext.defaultParallelism * 4)
    both = [F.col(f"q{at}").bitwiseAND(F.col(f"m{at}")) for at in parts]
    differ = [reduce(Column.bitwiseOR, (F.col(f"q{at}_{p}").bitwiseXOR(F.col(f"m{at}_{p}")) for p in range(depth)), F.lit(0).cast("long")) for at in parts]
    length = sum((F.bit_count(x) for x in both), F.lit(0))
    unlike = sum((F.bit_count(x.bitwiseAND(d)) for x, d in zip(both, differ)), F.lit(0))
    identity = F.try_divide(length - unlike, length)
    return b.join(a, (F.col("query") != F.col("match")) & (identity < threshold)).select("query", "match", identity.alias("identity"))


def backbones(residues: DataFrame, chain: str = "chain", pos: str = "pos", bond: float = 2.0) -> DataFrame:
    """Residues (n, ca, c, o) with the amide hydrogen ``h`` where the residue before is bonded, else null."""
    before = F.lag("c").over(Window.partitionBy(chain).orderBy(pos))
    h = F.when(g.distance(before, F.col("n")) < bond, g.amide_hydrogen(F.col("n"), F.col("ca"), before))
    return residues.withColumn("h", h)


_ATOMS = ["n", "ca", "c", "o", "h"]


#: Residues of a block, about: two blocks of one cell are measured against each other at once.
BLOCK = 512
#: Tasks at most that the blocks of one cell are dealt to.
SHARES = 8


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of columns of vectors; 0 where one has no length, as ``geometry.angle``."""
    c = _dots(a, b) / (_lengths(a) * _lengths(b))
    return np.arccos(np.clip(np.where(np.isnan(c), 1.0, c), -1.0, 1.0))


def _bond_energies(n, h, donor_c, donor_o, ca, c, o) -> np.ndarray:
    """``geometry.hbond_energy`` of columns of points, (3, m) each."""
    r = g.HBOND_BEST / _lengths(n - o)
    r2 = r * r
    r6 = r2 * r2 * r2
    well = g.HBOND_DEPTH * (3 * (r6 * r2) - 4 * r6)
    t, v = _angles(h - n, o - h), h - o
    x, y = c - ca, o - c
    k = np.stack([x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]])
    out = np.cos(np.abs(math.pi / 2 - _angles(v, k)))
    within = _angles(v - k * (_dots(v, k) / _dots(k, k)), donor_o - donor_c)
    far = math.radians(110)
    wide = 0.9 / math.cos(far) ** 6 * (math.cos(far) ** 2 - np.cos(within) ** 2) ** 3
    second = np.where(within < math.pi / 2, 0.9 + 0.1 * np.sin(2 * within), np.where(within < far, wide, 0.0)) * out
    first = np.where(t < math.pi / 2, np.cos(t) ** 2, 0.0)
    return np.where(well > g.HBOND_CUT, 0.0, well * first * second)


def _block_bonds(left: dict, right: dict, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bonds from the donors of a block to the acceptors of another: places in both, energies.

    Products of matrices, with room for their error, leave out pairs that cannot be bonds: too far, or with the oxygen
    where the well is above the cut or behind the hydrogen.
    """
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    some = np.flatnonzero(np.isfinite(left["h"]).all(axis=0) & np.isfinite(left["ca"]).all(axis=0))
    if not len(some):
        return empty
    ca, n, h = (left[a][:, some] for a in ("ca", "n", "h"))
    ca2, o = right["ca"], right["o"]
    middle = ca.mean(axis=1, keepdims=True)
    ca, n, h, ca2, o = (x - middle for x in (ca, n, h, ca2, o))
    squares = lambda x: (x * x).sum(axis=0)
    gap = lambda x, y: squares(x)[:, None] + squares(y)[None, :] - 2 * (x.T @ y)
    with np.errstate(all="ignore"):
        largest = np.nanmax(np.concatenate([squares(x) for x in (ca, n, h, ca2, o)]))
        slack = 1e-6 + 1e-12 * largest
        keep = gap(ca, ca2) <= reach * reach + slack
        d2 = gap(n, o)
        # the well is above the cut below 0.86 and beyond 1.81 times its place
        keep &= (d2 >= (0.86 * g.HBOND_BEST) ** 2 - slack) & (d2 <= (1.81 * g.HBOND_BEST) ** 2 + slack)
        u = h - n
        keep &= (u.T @ o) - (u * h).sum(axis=0)[:, None] >= -slack
        keep &= (left["binder"][some][:, None] | right["binder"][None, :]) & (left["key"][some][:, None] != right["key"][None, :])
        i, j = np.nonzero(keep)
        i = some[i]
        d = left["ca"][:, i] - right["ca"][:, j]
        near = (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2] <= reach * reach
        i, j = i[near], j[near]
        e = _bond_energies(*(left[a][:, i] for a in ("n", "h", "c", "o")), *(right[a][:, j] for a in ("ca", "c", "o")))
        bond = e < g.HBOND_CUT
    return i[bond], j[bond], e[bond]


def _blocks(column: pa.Array) -> dict:
    """The residues of a block's array: key, binder, and the atoms as (3, m) numbers, NaN for null."""
    rows = column.flatten()
    at = {rows.type.field(n).name: rows.field(n) for n in range(rows.type.num_fields)}
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(float)
    out = {a: np.stack([number(at[f"{a}{x}"]) for x in "xyz"]) for a in _ATOMS}
    return out | {"key": at["key"].to_numpy(zero_copy_only=False), "names": at["key"], "binder": at["binder"].to_numpy(zero_copy_only=False).astype(bool)}


def _met_blocks(residues: DataFrame, reach: float, key: str, binder: str) -> DataFrame:
    """Blocks l of donors and r of residues that may be within ``reach``: of one cell, and of it or those around it."""
    rows = residues.select(F.struct(F.col(key).alias("key"), F.coalesce(binder, F.lit(False)).alias("binder"), *(F.col(a)[x].cast("double").alias(f"{a}{x}") for a in _ATOMS for x in "xyz")).alias("row"), *(F.col("ca")[x].alias(x) for x in "xyz")).dropna(subset=list("xyz"))
    keys = ["__c0", "__c1", "__c2"]
    donors = rows.filter("row.hx IS NOT NULL")
    own, around = donors.select("row", "x", "y", "z", *cell_columns("xyz", reach)), surrounded(rows, "xyz", reach)

    parts = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    part = lambda n: F.pmod(F.xxhash64("row.key"), F.col(n)).alias("part")
    # few cells may hold nearly all residues: a crowded cell's blocks are shared out to up to SHARES tasks
    sizes = parts(own, "nl").withColumn("shares", F.least(F.lit(SHARES), "nl"))
    left = own.join(sizes, keys).groupBy(*keys, "shares", part("nl")).agg(F.collect_list("row").alias("l")).select(*keys, F.pmod("part", "shares").cast("int").alias("share"), "l")
    right = around.join(parts(around, "nr"), keys).groupBy(*keys, part("nr")).agg(F.collect_list("row").alias("r"))
    right = right.join(sizes, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"), "r")
    tasks = residues.sparkSession.sparkContext.defaultParallelism * 4
    return left.repartition(tasks, *keys, "share").join(right.repartition(tasks, *keys, "share").hint("shuffle_hash"), [*keys, "share"]).select("l", "r")


def hydrogen_bonds(residues: DataFrame, reach: float, key: str = "id", binder: str = "binder") -> DataFrame:
    """Hydrogen bonds of binder residues with each other and with the target: donor, acceptor, energy (below the cut).

    residues: key, binder (boolean) and the atoms of ``backbones``; only residues whose CA are within ``reach`` are asked.
    """
    ship(residues.sparkSession)
    kind = residues.schema[key].dataType.simpleString()

    def bonds(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                left, right = (_blocks(batch.column(c).slice(n, 1)) for c in ("l", "r"))
                i, j, e = _block_bonds(left, right, reach)
                if len(e):
                    yield pa.RecordBatch.from_arrays([left["names"].take(pa.array(i)), right["names"].take(pa.array(j)), pa.array(e)], names=["donor", "acceptor", "energy"])

    return _met_blocks(residues, reach, key, binder).mapInArrow(bonds, f"donor {kind}, acceptor {kind}, energy double")


def hydrogen_bond_sums(residues: DataFrame, reach: float, key: str = "id", binder: str = "binder") -> DataFrame:
    """``hydrogen_bonds`` without its rows: those of each donor (donor, n, energy; acceptor null), and every acceptor (n and energy 0)."""
    ship(residues.sparkSession)
    kind = residues.schema[key].dataType.simpleString()

    def sums(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                left, right = (_blocks(batch.column(c).slice(n, 1)) for c in ("l", "r"))
                i, j, e = _block_bonds(left, right, reach)
                if not len(e):
                    continue
                counts, energies = np.bincount(i), np.bincount(i, e)
                d, a = np.flatnonzero(counts), np.unique(j)
                yield pa.RecordBatch.from_arrays([left["names"].take(pa.array(d)), pa.nulls(len(d), right["names"].type), pa.array(counts[d]), pa.array(energies[d])], names=["donor", "acceptor", "n", "energy"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), left["names"].type), right["names"].take(pa.array(a)), pa.array(np.zeros(len(a), np.int64)), pa.array(np.zeros(len(a)))], names=["donor", "acceptor", "n", "energy"])

    out = _met_blocks(residues, reach, key, binder).mapInArrow(sums, f"donor {kind}, acceptor {kind}, n long, energy double")
    return out.groupBy("donor", "acceptor").agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"))


def exposed_groups(residues: DataFrame, bonds: DataFrame, reach: float, key: str = "id", binder: str = "binder", first: str = "first", last: str = "last") -> DataFrame:
    """Binder groups without a bond that a water could reach: key, kind (NH or CO), energy.

    The first residue's NH and the last one's CO don't count (boolean columns ``first`` and ``last``). A water overlaps if
    it is too near any backbone atom of a residue within ``reach``; of a carbonyl's two waters one must be free.
    """
    own = residues.filter(F.col(binder))
    nh = own.filter(~F.col(first) & F.col("h").isNotNull()).join(bonds.select(F.col("donor").alias(key)).distinct(), key, "left_anti").select(key, "ca", F.lit("NH").alias("kind"), F.array(g.water_position(F.col("h"), F.col("n"))).alias("waters"))
    co = own.filter(~F.col(last)).join(bonds.select(F.col("acceptor").alias(key)).distinct(), key, "left_anti").select(key, "ca", F.lit("CO").alias("kind"), g.carbonyl_waters(F.col("ca"), F.col("c"), F.col("o")).alias("waters"))
    groups = nh.unionAll(co).select(key, "kind", "waters", *(F.col("ca")[a].alias(a) for a in "xyz"))
    rows = residues.select(key, *_ATOMS, *(F.col("ca")[a].alias(a) for a in "xyz"))
    # a water is free if no residue bars it: the join ends at the first that does
    each = groups.select(key, "kind", "x", "y", "z", F.explode("waters").alias("water"))
    bars = g.water_overlaps(F.col("l_water"), F.col("r_n"), F.col("r_ca"), F.col("r_c"), F.col("r_o"))
    free = range_join(each, rows, reach, within=(F.col(f"l_{key}") != F.col(f"r_{key}")) & bars, how="left_anti").select(key, "kind").distinct()
    return free.withColumn("energy", F.when(F.col("kind") == "NH", g.EXPOSED_NH).otherwise(g.EXPOSED_CO))


def hbond_totals(bonds: DataFrame, exposed: DataFrame) -> DataFrame:
    """One row: n_hbonds, n_exposed_nh, n_exposed_co and the sum of all energies; bonds may be ``hydrogen_bond_sums``."""
    times = F.col("n") if "n" in bonds.columns else F.lit(1).cast("long")
    rows = bonds.select(F.lit("bond").alias("kind"), "energy", times.alias("n")).unionAll(exposed.select("kind", "energy", F.lit(1).cast("long")))
    n = lambda k, name: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return rows.agg(n("bond", "n_hbonds"), n("NH", "n_exposed_nh"), n("CO", "n_exposed_co"), F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy"))
