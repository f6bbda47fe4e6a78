"""Counts, histograms, log-odds, enrichment, set similarity and weighted statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeq.staging import Workspace


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal bin of a value, clamped to the first and last."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / ((high - low) / bins)))).cast("long")


def histogram2d(df: DataFrame, x: str, y: str, x_range, y_range, bins, by: list[str] = ()) -> DataFrame:
    """Counts on a grid of bins with their density, count / total / (bin width 1 * bin width 2): by, i, j, n, density."""
    wx, wy = (x_range[1] - x_range[0]) / bins[0], (y_range[1] - y_range[0]) / bins[1]
    counts = df.groupBy(*by, bin_of(F.col(x), *x_range, bins[0]).alias("i"), bin_of(F.col(y), *y_range, bins[1]).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*[F.col(c) for c in by])) if by else None
    if by:
        return counts.withColumn("density", F.col("n") / total / F.lit(wx * wy))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).withColumn("density", F.col("n") / F.col("__all") / F.lit(wx * wy)).drop("__all")


def density_lookup(df: DataFrame, hist: DataFrame, x: str, y: str, x_range, y_range, bins, by: list[str] = ()) -> DataFrame:
    """All rows with the density of their bin, 0 where the histogram has none."""
    cells = hist.select(*by, F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("density").alias("__density"))
    keyed = df.withColumns({"__i": bin_of(F.col(x), *x_range, bins[0]), "__j": bin_of(F.col(y), *y_range, bins[1])})
    return keyed.join(cells, [*by, "__i", "__j"], "left").select(*df.columns, F.coalesce("__density", F.lit(0.0)).alias("density"))


def zero_filled_counts(df: DataFrame, key: str, kind: str, kinds: list, pseudocount: int = 0) -> DataFrame:
    """One row per key with a count for each of the given kinds, plus a pseudocount."""
    return df.groupBy(key).agg(*((F.count_if(F.col(kind) == k) + pseudocount).cast("long").alias(f"n_{k}") for k in kinds))


def log_odds(df: DataFrame, by: list[str], kind: str, kinds: int, empty: float = 10.0) -> DataFrame:
    """For each group and kind: -log2(((n + 1) / (total + kinds)) / background), background over the whole table.

    Kinds that a group lacks count as 0 of its total; a kind without background scores ``empty``.
    """
    counts = df.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    background = counts.groupBy(kind).agg(F.sum("n").alias("b"))
    background = background.crossJoin(F.broadcast(background.agg(F.sum("b").alias("all")))).select(kind, (F.col("b") / F.col("all")).alias("share"))
    full = totals.crossJoin(F.broadcast(background)).join(counts, [*by, kind], "left")
    odds = -F.log2((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + kinds) / F.col("share"))
    return full.select(*by, kind, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "total", F.when(F.col("share") > 0, odds).otherwise(empty).alias("score"))


def native_score(native: Column, total: Column, background: Column, has_contacts: Column, kinds: int = 20) -> Column:
    """Log-odds of the native kind; no matches: 10; no contacts: -1000."""
    score = -F.log2((native + 1) / (total + kinds) / background)
    return F.when(~has_contacts, -1000.0).when(total == 0, 10.0).otherwise(score)


def per_unit_filter(df: DataFrame, by: list[str], size: str, least: float) -> DataFrame:
    """Groups with at least so many rows for each unit of their size: by, n, per_unit."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("__size"))
    return out.withColumn("per_unit", F.col("n") / F.col("__size")).filter(F.col("per_unit") >= least).drop("__size")


def read_counts(library: DataFrame, reads: DataFrame, sequence: str, read_id: str) -> DataFrame:
    """Number of reads of each library sequence, zero included: sequence, n_reads."""
    counts = reads.groupBy(sequence).agg(F.count(read_id).alias("n_reads"))
    return library.select(sequence).join(counts, sequence, "left").select(sequence, F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads"))


def enrichment(before: DataFrame, after: DataFrame, key: str, n: str, total_before: Column | None = None, total_after: Column | None = None) -> DataFrame:
    """(after / total after) / (before / total before) for each key of both; null where before is 0."""
    sums = before.agg(F.sum(n).alias("t1")).crossJoin(after.agg(F.sum(n).alias("t2")))
    both = before.select(key, F.col(n).alias("n1")).join(after.select(key, F.col(n).alias("n2")), key).crossJoin(F.broadcast(sums))
    t1, t2 = total_before if total_before is not None else F.col("t1"), total_after if total_after is not None else F.col("t2")
    return both.select(key, "n1", "n2", F.try_divide(F.col("n2") / t2, F.col("n1") / t1).alias("ratio"))


#: Different members up to which sets are compared as bitmaps, row by row; beyond, keys meet by the members they share.
BITMAP_MEMBERS = 1024
#: Numbers of all bitmaps of the queries, up to which these are broadcast.
BROADCAST_NUMBERS = 4_000_000


def _bitmaps(sets: DataFrame, key: str, names: list) -> DataFrame:
    """Sets as bitmaps over ``names``: key, n and the words w0, w1, .. of 64 members each."""
    bit = lambda i: 1 << i % 64 if i % 64 < 63 else -(1 << 63)
    places = sets.sparkSession.createDataFrame([(m, i // 64, bit(i)) for i, m in enumerate(names)], f"m {sets.schema['m'].dataType.simpleString()}, word int, bit long")
    sets = sets.join(F.broadcast(places), "m", "left")
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{w}") for w in range(max(1, -(-len(names) // 64)))]
    return sets.groupBy(key).agg(F.count("m").alias("n"), *words)


def _share(spark, shared: Column, union: Column, members: int, digits: int | None) -> Column:
    """shared / union, 0 for empty sets, rounded to ``digits``; of few members every rounded value is looked up."""
    if digits is None or members > 64:
        j = F.coalesce(F.try_divide(shared, union), F.lit(0.0))
        return j if digits is None else F.round(j, digits)
    width = 2 * members + 1
    table = spark.range((members + 1) * width).select("id", F.coalesce(F.round(F.try_divide(F.floor(F.col("id") / width), F.col("id") % width), digits), F.lit(0.0)).alias("j"))
    return F.get(F.array(*(F.lit(r.j) for r in sorted(table.collect()))), (shared * width + union).cast("int"))


def _bitmap_pairs(sets: DataFrame, key: str, least: int, queries: Column | None, names: list, work: Workspace, absent: bool, digits: int | None) -> DataFrame:
    """What ``set_similarity`` gives, by comparing all pairs as bitmaps: no pair is shuffled.

    ``absent``: also the pairs that share nothing, and each query with itself.
    """
    rows = work.table(_bitmaps(sets, key, names))
    words = [c for c in rows.columns if c.startswith("w")]
    a = (rows if queries is None else rows.filter(queries)).select(F.col(key).alias("a"), F.col("n").alias("na"), *(F.col(w).alias(f"a{w}") for w in words))
    if a.count() * (len(words) + 2) <= BROADCAST_NUMBERS:
        a = F.broadcast(a)
    # the side of all keys is dealt out; the other comes whole to each of its parts
    tasks = sets.sparkSession.sparkContext.defaultParallelism * 4
    b = rows.repartition(tasks, key).select(F.col(key).alias("b"), F.col("n").alias("nb"), *(F.col(w).alias(f"b{w}") for w in words))
    shared = sum((F.bit_count(F.col(f"a{w}").bitwiseAND(F.col(f"b{w}"))).cast("long") for w in words), F.lit(0).cast("long"))
    if absent:
        met = b.join(a, F.col("a") <= F.col("b")) if queries is None else b.crossJoin(a)
        met = met.withColumn("shared", shared)
    else:
        met = b.join(a, (F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b")) & (shared > 0)).withColumn("shared", shared)
    j = _share(sets.sparkSession, F.col("shared"), F.col("na") + F.col("nb") - F.col("shared"), len(names), digits)
    value = F.when(F.greatest("na", "nb") < least, 0.0).otherwise(j)
    if absent:
        value = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("b").isNull(), 0.0).otherwise(value)
    return met.select("a", "b", "shared", value.alias("jaccard"))


def _member_sets(members: DataFrame, key: str, member: str, work: Workspace) -> tuple[DataFrame, list | None]:
    """The distinct members of each key (key, m), and all different members if they are few enough for bitmaps, else None."""
    sets = work.table(members.select(F.col(key).alias(key), F.col(member).alias("m")).distinct())
    names = [r.m for r in sets.select("m").filter("m IS NOT NULL").distinct().limit(BITMAP_MEMBERS + 1).collect()]
    return sets, names if len(names) <= BITMAP_MEMBERS else None


def set_similarity(members: DataFrame, key: str, member: str, least: int = 0, queries: Column | None = None, digits: int | None = None) -> DataFrame:
    """Jaccard similarity of the member sets of each two keys that share a member: a, b, shared, jaccard (a < b).

    0 where the larger set has fewer than ``least`` members. ``queries``, a condition on the key: only pairs of a query a
    with any other key b. Where few different members make nearly all pairs share one, the pairs are compared as bitmaps;
    else they are met by their members.
    """
    work = Workspace(members.sparkSession, "sets")
    sets, names = _member_sets(members, key, member, work)
    if names is not None:
        return _bitmap_pairs(sets, key, least, queries, names, work, False, digits)
    sets = sets.filter("m IS NOT NULL")
    sized = sets.join(sets.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
    a = (sized if queries is None else sized.filter(queries)).select(F.col(key).alias("a"), "m", F.col("n").alias("na"))
    b = sized.select(F.col(key).alias("b"), "m", F.col("n").alias("nb"))
    shared = a.join(b, "m").filter("a < b" if queries is None else "a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    j = j if digits is None else F.round(j, digits)
    return shared.select("a", "b", "shared", F.when(F.greatest("na", "nb") < least, 0.0).otherwise(j).alias("jaccard"))


#: Members in a group of ``similar_sets`` that it aims at (a task holds six times as many at most), and pairs that it counts at once.
GROUP_MEMBERS, PAIRS_AT_ONCE = 1_000_000, 1_000_000
#: Shared members that a similar pair has at least in some group; with fewer, too many others have them by chance.
GROUP_SHARED = 6


def _met_often(k: list, run: list, n: list, second: list, share: float, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of keys with enough shared members in one group, whose pieces (emptied here) come in the order of its members.

    k: keys; run: numbers of members; n: sizes of the keys' whole sets; second: whether the key is in the second of two
    blocks, whose keys meet those of the first alone.
    """
    held = np.unique(np.concatenate([np.unique(x) for x in k]))
    size, late, rows, at = np.zeros(len(held), np.int64), np.zeros(len(held), bool), np.empty(sum(map(len, k)), np.int64), 0
    for part in range(len(k)):
        code = np.searchsorted(held, k[part])
        size[code], late[code] = n[part], second[part]
        rows[at : at + len(code)] = run[part].astype(np.int64) * len(held) + code
        at += len(code)
        k[part] = run[part] = n[part] = second[part] = None
    if late.any():  # keys of the first block come first
        order = np.argsort(late, kind="stable")
        held, size, late, place = held[order], size[order], late[order], np.argsort(order)
        rows += place[rows % len(held)] - rows % len(held)
    rows.sort()
    code = (rows % len(held)).astype(np.int32)
    rows //= len(held)
    ends = np.flatnonzero(np.append(np.diff(rows) != 0, True)) + 1
    lengths = np.diff(ends, prepend=0)
    del rows
    first = np.arange(1, len(code) + 1, dtype=np.int32)  # of a row's partners, which are the others up to the end
    if late.any():
        first = np.repeat((ends - np.add.reduceat(late[code].astype(np.int64), ends - lengths)).astype(np.int32), lengths)
        first[late[code]] = len(code)
    many = np.maximum(np.repeat(ends.astype(np.int32), lengths) - first, 0)
    by = np.argsort(code, kind="stable").astype(np.int32)
    # whole keys at a time, so that a pair is counted at once
    last = np.cumsum(np.bincount(code, minlength=len(held)))
    total = np.cumsum(np.bincount(code, weights=many, minlength=len(held)).astype(np.int64))
    out, lo = [np.empty((2, 0), held.dtype)], 0
    while lo < len(held):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        at = by[last[lo - 1] if lo else 0 : last[hi - 1]]
        times = many[at].astype(np.int64)
        before = np.cumsum(times) - times
        other = np.repeat(first[at] - before, times) + np.arange(times.sum())
        met = np.repeat(code[at].astype(np.int64) * len(held), times) + code[other]
        met.sort()
        ends = np.flatnonzero(np.append(np.diff(met) != 0, True)[: len(met)])
        times = np.diff(ends, prepend=-1)
        a, b = np.divmod(met[ends], len(held))
        enough = (times * groups >= share / (1 + share) * (size[a] + size[b]) - 1e-6) & (a != b)
        x, y = held[a[enough]], held[b[enough]]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        lo = hi
    return tuple(np.concatenate(out, axis=1))


def similar_sets(members: DataFrame, key: str, member: str, share: float) -> DataFrame:
    """``set_similarity`` of keys (longs) from ``share`` (above 0) on: a, b, shared, jaccard (a < b).

    Members are dealt to groups, as many as leave a pair of that similarity some shared members in one of them: there it
    shares its part of them at least, so each task counts shared members of its own group and gives only such pairs on; these
    are compared as whole sets. What a task holds is bounded: where groups are larger, their keys are dealt to blocks, and
    each two blocks meet in a task.
    """
    work = Workspace(members.sparkSession, "sets")
    sets, names = _member_sets(members.filter(F.col(key).isNotNull()), key, member, work)
    if names is not None:
        return _bitmap_pairs(sets, key, 0, None, names, work, False, None).filter(F.col("jaccard") >= share)
    sets = sets.filter("m IS NOT NULL")
    sizes = work.table(sets.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n")))
    entries, keys = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    most = int(share / (1 + share) * 2 * entries / keys / GROUP_SHARED)
    groups = max(1, min(most, max(min(8, entries // 100_000), -(-entries // GROUP_MEMBERS))))
    held = 6 * GROUP_MEMBERS
    blocks = 1 if entries <= groups * held else -(-2 * entries // (groups * held))

    def meet(batches):
        k, run, n, second, task, last, number = [], [], [], [], None, None, 0
        for batch in batches:
            tag, *columns = (batch.column(c).to_numpy() for c in ("tag", "k", "n"))
            cuts = np.flatnonzero(np.diff(tag >> 40)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tag)]):
                if lo == hi:
                    continue
                if k and tag[lo] >> 40 != task:
                    yield from pairs_of(k, run, n, second)
                    k, run, n, second, last, number = [], [], [], [], None, 0
                some = tag[lo:hi] >> 1
                runs = number + np.cumsum(np.diff(some, prepend=some[0] if last is None else last) != 0)
                task, last, number = tag[lo] >> 40, some[-1], int(runs[-1])
                k.append(columns[0][lo:hi].copy())
                n.append(columns[1][lo:hi].copy())
                run.append(runs.astype(np.int32))
                second.append((tag[lo:hi] & 1).astype(bool))
        if k:
            yield from pairs_of(k, run, n, second)

    def pairs_of(*pieces):
        a, b = _met_often(*pieces, share, groups)
        for lo in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (a, b)], ["a", "b"])

    # a row's tag: its task's number, 39 bits of its member's hash (members that have them in common only add to pairs) and whether its key is in the second block
    rows = sets.join(sizes, key).select(F.col(key).cast("long").alias("k"), "n", F.xxhash64("m").alias("t")).withColumn("x", F.pmod(F.shiftrightunsigned("t", 40), F.lit(groups)))
    second = F.lit(0)
    if blocks > 1:
        own = F.pmod(F.xxhash64("k", F.lit("block")), F.lit(blocks))
        rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = rows.withColumn("x", (F.col("x") * blocks + F.least("own", "with")) * blocks + F.greatest("own", "with"))
        second = (F.col("own") > F.col("with")).cast("long")
    tag = F.shiftleft(F.col("x").cast("long"), 40).bitwiseOR(F.shiftleft(F.col("t").bitwiseAND((1 << 39) - 1), 1)).bitwiseOR(second)
    # more parts than tasks, so that few share a part
    dealt = rows.select("x", tag.alias("tag"), "k", "n").repartition(groups * blocks * (blocks + 1) * 2, "x").sortWithinPartitions("tag")
    pairs = work.table(dealt.select("tag", "k", "n").mapInArrow(meet, "a long, b long").distinct())
    some = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    whole = work.table(sets.join(some, key, "left_semi").groupBy(key).agg(F.collect_list("m").alias("in")))
    a, b = (whole.select(F.col(key).alias(x), F.col("in").alias(f"in_{x}")) for x in "ab")
    shared = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("in_a").alias("na"), F.size("in_b").alias("nb"), F.size(F.array_intersect("in_a", "in_b")).cast("long").alias("shared"))
    return shared.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard")).filter(F.col("jaccard") >= share)


def set_matrix(members: DataFrame, key: str, member: str, least: int = 0, queries: Column | None = None, digits: int | None = None) -> DataFrame:
    """``similarity_matrix`` of ``set_similarity`` in one pass where the sets are bitmaps: a, b, jaccard."""
    work = Workspace(members.sparkSession, "sets")
    sets, names = _member_sets(members, key, member, work)
    if names is None:
        return similarity_matrix(set_similarity(members, key, member, least, queries, digits), members, key, queries)
    return _bitmap_pairs(sets, key, least, queries, names, work, True, digits).select("a", "b", "jaccard")


def similarity_matrix(similar: DataFrame, keys: DataFrame, key: str, queries: Column | None = None) -> DataFrame:
    """Every unordered pair of keys (of each query with any key) with its similarity, 0 where absent, 1 with itself: a, b, jaccard."""
    k = keys.select(key).distinct()
    a, b = (k if queries is None else k.filter(queries)).select(F.col(key).alias("a")), k.select(F.col(key).alias("b"))
    pairs = a.join(b, F.col("a") <= F.col("b")) if queries is None else a.crossJoin(b)
    out = pairs.join(similar.select("a", "b", "jaccard"), ["a", "b"], "left")
    return out.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("jaccard", F.lit(0.0))).alias("jaccard"))


def pair_keys(contacts: DataFrame, key: str, target: str, pos: str, window: int, compat: bool = False) -> DataFrame:
    """Keys ``target_target_distance`` of ordered pairs of contacts that lie 1 to ``window`` apart along the binder.

    compat: all ordered pairs of different contacts of a key whose signed distance, the first's place less the second's,
    is at most ``window``. A key's contacts are met window by window, so that only pairs near enough are made.
    """
    rows = contacts.select(F.col(key).alias("k"), F.col(target).alias("t"), F.col(pos).alias("p"))
    if compat:
        # the signed distance has no lower bound: all of a key's later contacts are partners of a first one
        a = rows.select("k", F.col("t").alias("ta"), F.col("p").alias("pa"), F.monotonically_increasing_id().alias("ia"))
        b = a.select("k", F.col("ta").alias("tb"), F.col("pa").alias("pb"), F.col("ia").alias("ib"))
        met = a.join(b, "k").filter((F.col("ia") != F.col("ib")) & (F.col("pa") - F.col("pb") <= window))
        d = F.col("pa") - F.col("pb")
    else:
        near = Window.partitionBy("k").orderBy("p").rangeBetween(1, window)
        met = rows.withColumn("later", F.collect_set(F.struct("t", "p")).over(near)).select("k", F.col("t").alias("ta"), F.col("p").alias("pa"), F.explode("later").alias("o"))
        met = met.select("k", "ta", "pa", F.col("o.t").alias("tb"), F.col("o.p").alias("pb"))
        d = F.col("pb") - F.col("pa")
    return met.select(F.col("k").alias(key), F.concat_ws("_", F.col("ta").cast("string"), F.col("tb").cast("string"), d.cast("string")).alias("pair_key")).distinct()


def wide_distribution(df: DataFrame, key: str, value: str, values: list[int]) -> DataFrame:
    """A count column for each value, zero filled, and each value's share of the row."""
    counts = df.groupBy(key).agg(*(F.count_if(F.col(value) == v).cast("long").alias(f"v{v}") for v in values))
    total = sum((F.col(f"v{v}") for v in values), F.lit(0))
    return counts.select("*", *(F.try_divide(F.col(f"v{v}"), total).alias(f"share{v}") for v in values))


def weighted_loss(df: DataFrame, by: list[str], loss: str, weight: str) -> DataFrame:
    """sum(loss * weight) / sum(weight) in each group."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(loss) * F.col(weight)), F.sum(weight)).alias("loss"))


def masked_mean(df: DataFrame, by: list[str], value: Column, mask: Column) -> DataFrame:
    """Mean over rows that the mask keeps; null if none."""
    return df.groupBy(*by).agg(F.avg(F.when(mask, value)).alias("mean"), F.count_if(mask).cast("long").alias("n"))


def masked_mse(df: DataFrame, by: list[str], value: Column, truth: Column, mask: Column) -> DataFrame:
    """Mean squared difference over rows that the mask keeps; null if none."""
    return df.groupBy(*by).agg(F.avg(F.when(mask, (value - truth) * (value - truth))).alias("mse"), F.count_if(mask).cast("long").alias("n"))
