"""Windows along ordered chains: flanks, segments, bridges, bonds, renumbering, gaps, best alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeq.staging import Workspace


def numbered(df: DataFrame, chain: str, order: list, name: str = "pos") -> DataFrame:
    """Rows with their position along the chain, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(chain).orderBy(*order)).cast("long"))


def flanks(df: DataFrame, chain: str, order: list, value: str, n: int, whole: bool = False) -> DataFrame:
    """Rows with the values of up to n neighbours on each side and their own, clipped at the ends (whole: such rows go)."""
    w = Window.partitionBy(chain).orderBy(*order)
    out = df.withColumn("flank", F.collect_list(value).over(w.rowsBetween(-n, n)))
    return out.filter(F.size("flank") == 2 * n + 1) if whole else out


def segments(df: DataFrame, chain: str, order: list, value: str, k: int) -> DataFrame:
    """Every run of k consecutive values, by its first row."""
    w = Window.partitionBy(chain).orderBy(*order).rowsBetween(0, k - 1)
    return df.withColumn("segment", F.collect_list(value).over(w)).filter(F.size("segment") == k)


def bridges(df: DataFrame, chain: str, order: list, axes: list[str], longest: int, end: int = 3) -> DataFrame:
    """Every stretch of 0..longest rows between two ends of ``end`` rows each: chain, start, len, d1, .., ends.

    start is the position of the last row of the first end. d1 spans the first rows of both ends, d2 their second rows and
    so on; ``ends`` has the coordinates of all their rows, flat, for a superposition.
    """
    w = Window.partitionBy(chain).orderBy(*order)
    point = F.struct(*axes)
    rows = df.select(chain, F.row_number().over(w).cast("long").alias("start"), F.collect_list(point).over(w.rowsBetween(1 - end, 0)).alias("one"), F.collect_list(point).over(w.rowsBetween(1, longest + end)).alias("after"))
    rows = rows.filter((F.size("one") == end) & (F.size("after") >= end))
    out = rows.withColumn("len", F.explode(F.sequence(F.lit(0), F.size("after") - end))).withColumn("two", F.slice("after", F.col("len") + 1, F.lit(end)))

    def gap(i: int) -> Column:
        a, b = F.element_at("one", i + 1), F.element_at("two", i + 1)
        return F.sqrt(sum(((a[x] - b[x]) * (a[x] - b[x]) for x in axes), F.lit(0.0)))

    flat = F.flatten(F.transform(F.concat("one", "two"), lambda p: F.array(*(p[x].cast("double") for x in axes))))
    return out.select(chain, "start", F.col("len").cast("long").alias("len"), *(gap(i).alias(f"d{i + 1}") for i in range(end)), flat.alias("ends"))


def bonded_previous(df: DataFrame, chain: str, order: list, gap: Column, most: float, value: str) -> DataFrame:
    """Rows with the previous row's value if the gap to it is below ``most``; ``gap`` may use ``lag`` columns."""
    w = Window.partitionBy(chain).orderBy(*order)
    return df.withColumn("previous", F.when(gap < most, F.lag(value).over(w)))


def renumbered(df: DataFrame, chain_lengths_by: str, order: list, length: str) -> DataFrame:
    """Rows (one for each chain) with the sum of lengths of the chains before, within each structure."""
    w = Window.partitionBy(chain_lengths_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def gap_groups(df: DataFrame, chain: str, order: list, number: str, step: float = 1) -> DataFrame:
    """Rows with the number of their run (a new one where ``number`` rises by more than ``step``) and their index in it,

    counted from the run's middle."""
    w = Window.partitionBy(chain).orderBy(*order)
    marked = df.withColumn("__new", F.coalesce((F.col(number) - F.lag(number).over(w) > step).cast("int"), F.lit(0)))
    marked = marked.withColumn("run", F.sum("__new").over(w).cast("long"))
    inside = Window.partitionBy(chain, "run")
    nth = F.row_number().over(inside.orderBy(*order)) - 1
    return marked.withColumn("index", (nth - F.floor(F.count(F.lit(1)).over(inside) / 2)).cast("long")).drop("__new")


def moving_orientation(df: DataFrame, chain: str, order: list, axes: list[str], window: int = 4) -> DataFrame:
    """Mean over each chain of the vectors from a row to the one ``window`` later: chain, one column an axis, n."""
    w = Window.partitionBy(chain).orderBy(*order)
    steps = df.select(chain, *((F.lead(a, window).over(w) - F.col(a)).alias(a) for a in axes)).dropna(subset=axes)
    return steps.groupBy(chain).agg(*(F.avg(a).alias(a) for a in axes), F.count(F.lit(1)).alias("n"))


#: Windows of a block, about; windows of a chain beyond which it is cut into pieces.
BLOCK, PIECE = 8192, 1024


def _nearest_windows(p: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Least RMSD of the windows p (m, k), ordered by i, to each run of q (n, k) that begins at ``starts``: rmsd, i, j by run.

    Distances come from single-precision products; every window of a run that their error leaves in question is measured
    again as it stands, so that results and ties (least i, then j) are those of the plain formula.
    """
    k = p.shape[1]
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(q))))
    if np.isfinite(p).all() and np.isfinite(q).all():
        middle = p.mean(axis=0)
        c, d = p - middle, q - middle
        cc, dd = (c * c).sum(axis=1), (d * d).sum(axis=1)
        error = (cc.max() + dd) * (2.0**-24 * 8 * (k + 4)) + 1e-30
        if cc.max() + dd.max() < 1e30:
            left = np.column_stack([c, cc, np.ones(len(c))]).astype(np.float32)
            right = np.vstack([-2 * d.T, np.ones(len(d)), dd]).astype(np.float32)
            step = max(256, (1 << 18) // len(p))
            least = np.concatenate([(left @ right[:, at : at + step]).min(axis=0) for at in range(0, len(q), step)]).astype(float)
            asked = np.flatnonzero(least - error <= np.minimum.reduceat(least + error, starts)[run])
        else:
            asked = np.arange(len(q))
    else:
        asked = np.arange(len(q))
    found = []
    step = max(1, (1 << 20) // len(p))
    for at in range(0, len(asked), step):
        n = asked[at : at + step]
        d2 = 0.0
        for x in range(k):
            gap = p[:, x, None] - q[None, n, x]
            d2 = d2 + gap * gap
        far = np.sqrt(d2 / k)
        # NaN is the largest, as in an ORDER BY
        first = np.argmin(np.where(np.isnan(far), np.inf, far), axis=0)
        for z in np.flatnonzero(np.isnan(far[first, np.arange(len(n))])).tolist():
            numbers = np.flatnonzero(~np.isnan(far[:, z]))
            first[z] = numbers[0] if len(numbers) else 0
        found.append((far[first, np.arange(len(n))], first))
    far, first = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((j[asked], i[first], far, run[asked]))
    best = order[np.searchsorted(run[asked][order], np.arange(len(starts)))]
    return far[best], i[first[best]], j[asked[best]]


def _blocked(rows: DataFrame, size: int, name: str, work: Workspace) -> DataFrame:
    """Windows in blocks of whole pieces, a row each with the array ``name``."""
    blocks = max(1, -(-rows.count() // BLOCK))
    out = rows.groupBy(F.pmod(F.xxhash64("chain", "piece"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("chain", "piece", "pos", *(f"v{i}" for i in range(size))))).alias(name))
    return work.table(out.select(name))


def _best_of_blocks(x: DataFrame, y: DataFrame, size: int, kind: str, place: str) -> DataFrame:
    """Best windows of each pair of pieces of blocks with arrays x and y: a, b, i, j, rmsd."""

    def runs(column: pa.Array) -> tuple:
        rows = column.flatten()
        chain, piece, pos, *numbers = (rows.field(n) for n in range(size + 3))
        chain = chain.dictionary_encode()
        code, piece = chain.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece.to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero((np.diff(code) != 0) | (np.diff(piece) != 0)) + 1)
        return chain.dictionary, code[starts], starts, pos.to_numpy(zero_copy_only=False), np.column_stack([n.to_numpy(zero_copy_only=False) for n in numbers]).astype(float)

    def best(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                names, code, starts, i, p = runs(batch.column("x").slice(n, 1))
                others, other, begins, j, q = runs(batch.column("y").slice(n, 1))
                ends = np.append(starts, len(p))
                for r in range(len(starts)):
                    own = names.take(pa.array([code[r]]))
                    keep = ~pc.equal(others, own[0]).to_numpy(zero_copy_only=False)[other]
                    if not keep.any():
                        continue
                    far, at, to = _nearest_windows(p[ends[r] : ends[r + 1]], i[ends[r] : ends[r + 1]], q, j, begins)
                    m = int(keep.sum())
                    columns = [own.take(pa.array(np.zeros(m, np.int64))), others.take(pa.array(other[keep])), pa.array(at[keep]), pa.array(to[keep]), pa.array(far[keep])]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "i", "j", "rmsd"])

    # dealt out by block of y, else a few small files would make a few tasks
    pairs = y.repartition(max(1, min(y.count(), 2000))).crossJoin(x)
    return pairs.mapInArrow(best, f"a {kind}, b {kind}, i {place}, j {place}, rmsd double")


def best_window(a: DataFrame, b: DataFrame, chain: str, pos: str, window: str, size: int) -> DataFrame:
    """For each pair of chains the pair of windows of least RMSD (no superposition; ties: the first): a, b, i, j, rmsd.

    Every window of ``a``, a set of queries, meets every one of ``b``; windows are arrays of ``size`` numbers, none null.
    Blocks of whole chains meet each other, and a pair is done where it is met; nothing is shuffled but the windows. Only
    chains of more than ``PIECE`` windows are cut, and the best of their pieces compared afterwards.
    """
    work = Workspace(a.sparkSession, "windows")
    kind, place = b.schema[chain].dataType.simpleString(), b.schema[pos].dataType.simpleString()
    nth = F.row_number().over(Window.partitionBy("chain").orderBy("pos")) - 1

    def flat(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(chain).alias("chain"), F.col(pos).alias("pos"), *(F.element_at(window, n + 1).cast("double").alias(f"v{n}") for n in range(size)))
        return work.table(rows.filter("chain IS NOT NULL").withColumn("piece", F.floor(nth / PIECE)))

    x, y = flat(a), flat(b)
    tall = [r.filter("piece > 0").select("chain").distinct() for r in (x, y)]
    some = [not t.isEmpty() for t in tall]
    short = [r.join(t, "chain", "left_anti") if s else r for r, t, s in zip((x, y), tall, some)]
    block = lambda r, name: _blocked(r, size, name, work)
    bx, by = block(short[0], "x"), block(short[1], "y")
    out = _best_of_blocks(bx, by, size, kind, place)
    cut = []
    if some[0]:
        cut.append(_best_of_blocks(block(x.join(tall[0], "chain", "left_semi"), "x"), by, size, kind, place))
    if some[1]:
        cut.append(_best_of_blocks(block(x, "x"), block(y.join(tall[1], "chain", "left_semi"), "y"), size, kind, place))
    for part in cut:
        best = part.groupBy("a", "b").agg(F.min(F.struct("rmsd", "i", "j")).alias("m"))
        out = out.unionAll(best.select("a", "b", "m.i", "m.j", "m.rmsd"))
    return out


def topology_positions(df: DataFrame, topology: str, order: list, length: str, overlap: int = 3) -> DataFrame:
    """Fragments laid end to end with ``overlap`` shared places: start, end and whether each may be placed.

    A fragment is valid if it is the first, or longer than the overlap, so that it extends the topology by one at least.
    """
    w = Window.partitionBy(topology).orderBy(*order)
    before = F.coalesce(F.sum(F.col(length) - overlap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    first = F.row_number().over(w) == 1
    return df.select("*", before.alias("start"), (before + F.col(length)).cast("long").alias("end"), (first | (F.col(length) > overlap)).alias("valid"))


def shift_starts(df: DataFrame, topology: str, start: str) -> DataFrame:
    """After an insertion before the first fragment: starts moved so that the least is 0."""
    least = F.min(start).over(Window.partitionBy(topology))
    return df.withColumn(start, F.col(start) - least)
