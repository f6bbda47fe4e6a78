"""Range, contact and nearest-neighbour joins on a hash grid.

Points fall into cubic cells at least as wide as the radius; one side is copied to the 27 cells around its own, so that
an equi-join on the cell meets every pair within the radius once, and the exact test follows. Both sides of the join
are plain exchanges, which adaptive execution can split where a cell is crowded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeq.functions.geometry import circular_deviation
from latticeq.staging import Workspace, ship

XYZ = ("x", "y", "z")


def cell_columns(axes, width) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(width)).cast("long").alias(f"__c{i}") for i, a in enumerate(axes)]


def surrounded(df: DataFrame, axes, width: float) -> DataFrame:
    """Rows copied to their own and all neighbouring cells."""
    out = df.select("*", *cell_columns(axes, width))
    for i in range(len(axes)):
        c = f"__c{i}"
        out = out.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return out


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns with a prefix, so that two sides of a join never clash."""
    return df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns))


def squared_distance(a: str, b: str, axes=XYZ) -> Column:
    """Sum of squared differences of columns with the two prefixes."""
    total = F.lit(0.0)
    for x in axes:
        d = F.col(f"{a}{x}") - F.col(f"{b}{x}")
        total = total + d * d
    return total


def range_join(left: DataFrame, right: DataFrame, radius: float, axes=XYZ, within: Column | None = None, box: bool = False, how: str = "inner") -> DataFrame:
    """Pairs (columns l_*, r_*) at most ``radius`` apart and satisfying ``within``; ``box``: in each axis, not in space.

    ``radius`` bounds every pair that ``within`` can accept, e.g. the largest sum of radii. ``how`` may be ``inner``,
    ``left_semi`` (left rows with a partner) or ``left_anti`` (without). Rows with a null coordinate meet none.
    """
    a, b = prefixed(left, "l_"), prefixed(right, "r_")
    wide = a.select("*", *cell_columns([f"l_{x}" for x in axes], radius))
    copies = surrounded(b, [f"r_{x}" for x in axes], radius)
    near = F.lit(True)
    if box:
        for x in axes:
            near = near & (F.abs(F.col(f"l_{x}") - F.col(f"r_{x}")) <= radius)
    else:
        near = squared_distance("l_", "r_", axes) <= radius * radius
    if within is not None:
        near = near & within
    keys = [f"__c{i}" for i in range(len(axes))]
    condition = near
    for k in keys:
        condition = condition & (wide[k] == copies[k])
    out = wide.join(copies, condition, how)
    return out.select(*a.columns, *b.columns) if how == "inner" else out.select(*(F.col(f"l_{c}").alias(c) for c in left.columns))


#: Rows of a block of vectors, of those measured at once, and tasks that the blocks of one crowded cell are shared out to.
VECTORS, AT_ONCE, VECTOR_SHARES = 2048, 512, 16


def _close_vectors(p: np.ndarray, q: np.ndarray, box: int, half: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in p (m, d) and q (k, d) of pairs in one box and at most ``most`` apart, and their distances."""
    found = []
    for lo in range(0, len(p), AT_ONCE):
        for at in range(0, len(q), AT_ONCE):
            x, y = p[lo : lo + AT_ONCE], q[at : at + AT_ONCE]
            size = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
            # a product leaves out nearly all; those left are measured number by number
            near = size - 2 * (x @ y.T) <= most * most + 1e-9 * (size + most * most)
            for k in range(box):
                near &= np.abs(x[:, k, None] - y[None, :, k]) <= half
            i, j = np.nonzero(near)
            d2 = np.zeros(len(i))
            for k in range(p.shape[1]):
                step = x[i, k] - y[j, k]
                d2 += step * step
            d = np.sqrt(d2)
            i, j, d = i[d <= most], j[d <= most], d[d <= most]
            found.append((i + lo, j + at, d))
    return tuple(np.concatenate(c) for c in zip(*found))


def vector_pairs(df: DataFrame, key: str, vector: str, box: int, half: float, most: float) -> DataFrame:
    """Pairs of vectors of one length, at most ``half`` apart in each of the first ``box`` (2 or more) numbers and ``most`` in all: a, b, distance.

    a < b. Vectors meet in blocks by cells of their first two numbers, each pair of neighbouring cells once; only pairs
    of the result leave a task. Vectors with a null, and null keys, meet none.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    cell = [F.floor(F.element_at(vector, i + 1).cast("double") / F.lit(half)).cast("long").alias(f"__c{i}") for i in range(2)]
    whole = df.filter(F.col(key).isNotNull() & (F.size(vector) >= box) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    rows = whole.select(F.struct(F.col(key).alias("key"), F.col(vector).alias("v")).alias("row"), F.size(vector).alias("__n"), *cell)
    keys = ["__n", "__c0", "__c1"]
    # a cell's own rows, and those of the four neighbours that come after it
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (1, -1))))
    around = rows.withColumn("__s", F.explode(steps)).select("row", "__n", *((F.col(c) - F.col("__s")[x]).alias(c) for c, x in (("__c0", "i"), ("__c1", "j"))), ((F.col("__s.i") == 0) & (F.col("__s.j") == 0)).alias("own"))
    blocks = lambda of, n: of.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / VECTORS).alias(n))
    part = lambda n: F.pmod(F.xxhash64("row.key"), F.col(n)).alias("part")
    sizes = blocks(rows, "nl").withColumn("shares", F.least(F.lit(VECTOR_SHARES), "nl"))
    left = rows.join(sizes, keys).groupBy(*keys, "shares", part("nl")).agg(F.collect_list("row").alias("l")).select(*keys, F.pmod("part", "shares").cast("int").alias("share"), "l")
    right = around.join(blocks(around, "nr"), keys).groupBy(*keys, "own", part("nr")).agg(F.collect_list("row").alias("r"))
    right = right.join(sizes, keys).select(*keys, "own", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"), "r")
    tasks = df.sparkSession.sparkContext.defaultParallelism * 4
    met = left.repartition(tasks, *keys, "share").join(right.repartition(tasks, *keys, "share").hint("shuffle_hash"), [*keys, "share"]).select("own", "l", "r")

    def block(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        held = column.flatten()
        names, v = held.field("key"), held.field("v")
        return names, names.to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(names), -1)

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                (a, ka, p), (b, kb, q) = (block(batch.column(c).slice(n, 1)) for c in ("l", "r"))
                i, j, d = _close_vectors(p, q, box, half, most)
                first, last = ka[i] < kb[j], ka[i] > kb[j]
                if batch.column("own")[n].as_py():  # the pair comes the other way round too
                    last = np.zeros(len(i), bool)
                for some, x, at, y, to in ((first, a, i, b, j), (last, b, j, a, i)):
                    if some.any():
                        yield pa.RecordBatch.from_arrays([x.take(pa.array(at[some])), y.take(pa.array(to[some])), pa.array(d[some])], names=["a", "b", "distance"])

    return met.mapInArrow(run, f"a {kind}, b {kind}, distance double")


def radius_pairs(atoms: DataFrame, largest: float, factor: float = 1.0, radius: str = "radius", axes=XYZ, valid: Column | None = None) -> DataFrame:
    """Pairs of atoms closer than ``factor`` times the sum of their radii (each pair in both orders).

    ``largest`` is a bound of the radii; ``valid`` restricts the pairs (columns l_*, r_*).
    """
    reach = factor * (F.col(f"l_{radius}") + F.col(f"r_{radius}"))
    close = F.sqrt(squared_distance("l_", "r_", axes)) < reach
    return range_join(atoms, atoms, 2 * largest * factor, axes, close if valid is None else close & valid)


def contact_counts(left: DataFrame, right: DataFrame, radius: float, key: str, axes=XYZ, within: Column | None = None) -> DataFrame:
    """Number of right rows near each left row, zero included: key, n_near."""
    pairs = range_join(left, right, radius, axes, within).groupBy(F.col(f"l_{key}").alias(key)).agg(F.count(F.lit(1)).alias("n_near"))
    return left.select(key).join(pairs, key, "left").select(key, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def residue_pair_allowed(min_separation: int = 8, chain: str = "chain", pos: str = "pos", left: list | None = None, right: list | None = None, residue: str = "id") -> Column:
    """False for a residue with itself and for pairs of one chain that are at most ``min_separation`` apart along it.

    ``left`` and ``right`` are lists of residues (column ``residue``) that the two sides must be among.
    """
    apart = (F.col(f"l_{chain}") != F.col(f"r_{chain}")) | (F.abs(F.col(f"l_{pos}") - F.col(f"r_{pos}")) > min_separation)
    for side, members in (("l", left), ("r", right)):
        if members is not None:
            apart = apart & F.col(f"{side}_{residue}").isin(members)
    return apart


def clashes_within(atoms: DataFrame, largest: float, factor: float = 0.7, chain: str = "chain", pos: str = "pos", key: str = "id") -> DataFrame:
    """Pairs of atoms of one chain, more than one residue apart, that are nearer than scaled radii allow; each pair once."""
    valid = (F.col(f"l_{chain}") == F.col(f"r_{chain}")) & (F.abs(F.col(f"l_{pos}") - F.col(f"r_{pos}")) > 1) & (F.col(f"l_{key}") < F.col(f"r_{key}"))
    return radius_pairs(atoms, largest, factor, valid=valid)


def near_any(left: DataFrame, right: DataFrame, radius: float, by: str, key: str, axes=XYZ) -> DataFrame:
    """Number of different right rows within ``radius`` of any left row of each group, zero included: by, n_near."""
    met = range_join(left, right, radius, axes).groupBy(F.col(f"l_{by}").alias(by)).agg(F.count_distinct(f"r_{key}").alias("n_near"))
    return left.select(by).distinct().join(met, by, "left").select(by, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float | None, key: str, axes=XYZ, grow: float = 4.0, with_self: bool = True) -> DataFrame:
    """The k nearest right rows of each left row: l_<key>, r_<key>, d2, nth; ties by key.

    A grid join at ``radius`` (default: from the mean density) answers the left rows that have k partners there; the
    others go on with a radius ``grow`` times larger. Once the radius spans all points every row is answered, with fewer than k partners if there are none.
    """
    axes = tuple(axes)
    bounds = left.select(key, *axes).unionAll(right.select(key, *axes)).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    spans = [(bounds[f"hi_{a}"] or 0.0) - (bounds[f"lo_{a}"] or 0.0) for a in axes]
    largest = sum(s * s for s in spans) ** 0.5
    if radius is None:
        volume = math.prod(s or 1e-9 for s in spans)
        radius = 1.5 * (2 * k / max(bounds["n"], 1) * volume) ** (1 / len(axes))
    by = Window.partitionBy(f"l_{key}").orderBy("d2", f"r_{key}")
    other = None if with_self else F.col(f"l_{key}") != F.col(f"r_{key}")
    work = Workspace(left.sparkSession, "nearest")
    left_over, right = left.select(key, *axes), right.select(key, *axes)
    found = None
    while True:
        reach = min(radius, max(largest, 1e-9)) * (1 + 1e-9)
        pairs = range_join(left_over, right, reach, axes, other).withColumn("d2", squared_distance("l_", "r_", axes))
        ranked = pairs.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k).select(f"l_{key}", f"r_{key}", "d2", "nth")
        if radius >= largest:
            return ranked if found is None else found.unionAll(ranked)
        # each round is written, so that the next one starts from what it left over
        ranked = work.table(ranked.withColumn("full", F.max("nth").over(Window.partitionBy(f"l_{key}")) == k))
        done = ranked.filter("full").drop("full")
        found = done if found is None else found.unionAll(done)
        left_over = work.table(left_over.join(done.filter(F.col("nth") == k).select(F.col(f"l_{key}").alias(key)), key, "left_anti"))
        if left_over.isEmpty():
            return found
        radius = radius * grow


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different members: a, b with a < b."""
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def angle_join(left: DataFrame, right: DataFrame, angles: list[str], cutoff: float, within: Column | None = None) -> DataFrame:
    """Pairs (l_*, r_*) whose circular deviations sum to at most ``cutoff`` radians; angles in [0, 2 pi).

    Bins wrap around, so the neighbours of the first bin include the last.
    """
    bins = max(1, int(2 * math.pi / cutoff))
    width = 2 * math.pi / bins
    a, b = prefixed(left, "l_"), prefixed(right, "r_")
    wide = a.select("*", *(F.pmod(F.floor(F.col(f"l_{x}") / width), F.lit(bins)).alias(f"__c{i}") for i, x in enumerate(angles)))
    copies = b
    for i, x in enumerate(angles):
        at = F.floor(F.col(f"r_{x}") / width)
        copies = copies.withColumn(f"__c{i}", F.explode(F.array_distinct(F.transform(F.sequence(at - 1, at + 1), lambda c: F.pmod(c, F.lit(bins))))))
    total = F.lit(0.0)
    condition = F.lit(True)
    for i, x in enumerate(angles):
        total = total + circular_deviation(F.col(f"l_{x}"), F.col(f"r_{x}"))
        condition = condition & (wide[f"__c{i}"] == copies[f"__c{i}"])
    condition = condition & (total <= cutoff)
    return wide.join(copies, condition if within is None else condition & within).select(*a.columns, *b.columns)


def voxel_address(axes, low, width: float, counts) -> Column:
    """Linear address z*nx*ny + y*nx + x of the voxel a point lies in, -1 outside the box."""
    bins = [F.floor((F.col(a) - lo) / width).cast("long") for a, lo in zip(axes, low)]
    inside = F.lit(True)
    for b, n in zip(bins, counts):
        inside = inside & (b >= 0) & (b < n)
    return F.when(inside, bins[2] * counts[0] * counts[1] + bins[1] * counts[0] + bins[0]).otherwise(F.lit(-1)).cast("long")


def occupancy(points: DataFrame, mobile: DataFrame, width: float, axes=XYZ) -> DataFrame:
    """Voxels that ``points`` occupy with the number of ``mobile`` rows in each (zero included): v0, v1, v2, n."""
    taken = points.select(*cell_columns(axes, width)).distinct()
    inside = mobile.select(*cell_columns(axes, width)).groupBy("__c0", "__c1", "__c2").agg(F.count(F.lit(1)).alias("n"))
    return taken.join(inside, ["__c0", "__c1", "__c2"], "left").select(*(F.col(f"__c{i}").alias(f"v{i}") for i in range(3)), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def outside_occupied(points: DataFrame, mobile: DataFrame, width: float, axes=XYZ) -> DataFrame:
    """Number of mobile rows in no occupied voxel: the normalising constant of occupancy probabilities."""
    taken = points.select(*cell_columns(axes, width)).distinct()
    return mobile.select(*cell_columns(axes, width)).join(taken, ["__c0", "__c1", "__c2"], "left_anti").agg(F.count(F.lit(1)).alias("n_outside"))


def shell(edges: DataFrame, selected: DataFrame, a: str = "a", b: str = "b", key: str = "id") -> DataFrame:
    """Edges that touch the selection or one of its first neighbours."""
    chosen = selected.select(F.col(key).alias("__k")).distinct()
    one = edges.join(chosen, F.col(a) == F.col("__k"), "left_semi").select(a, b)
    two = edges.join(chosen, F.col(b) == F.col("__k"), "left_semi").select(a, b)
    touching = one.unionAll(two)
    near = touching.select(F.col(a).alias("__k")).unionAll(touching.select(F.col(b))).unionAll(chosen).distinct()
    return edges.join(near, F.col(a) == F.col("__k"), "left_semi").unionAll(edges.join(near, F.col(b) == F.col("__k"), "left_semi")).distinct()
