"""Deterministic deduplication, top-k, sampling, folds, merges and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeq.staging import Workspace


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order (an aggregate, so that rows are combined before the shuffle)."""
    names = df.columns
    ordered = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in names)), ordered).alias("__row"))
    return out.select("__row.*")


def below_median(df: DataFrame, value: str) -> DataFrame:
    """Rows below the exact median of their own column: the mean of the one or two middle values of its sorted parts."""
    ordered = numbered(df.select(F.col(value).cast("double").alias("__x")).filter("__x IS NOT NULL"), ["__x"])
    counted = ordered.crossJoin(F.broadcast(ordered.agg(F.count(F.lit(1)).alias("__n"))))  # one row
    half = (F.col("__n") - 1) / 2
    median = counted.filter((F.col("index") == F.floor(half)) | (F.col("index") == F.ceil(half))).agg(F.avg("__x").alias("__median"))
    return df.crossJoin(F.broadcast(median)).filter(F.col(value) < F.col("__median")).drop("__median")


def lowest(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def arithmetic_hash(key: Column, seed: int = 12345) -> Column:
    """A pseudorandom order that SQL engines agree on."""
    return F.pmod(key * 1103515245 + seed, F.lit(2147483648))


def top_per_group(df: DataFrame, by: list[str], n: int, order: list) -> DataFrame:
    """The first n rows of each group (limited in each task before the shuffle)."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__nth") <= n).drop("__nth")


def grouped_sample(df: DataFrame, by: list[str], n: int, key: str, whole: Column | None = None) -> DataFrame:
    """n pseudorandom rows of each group; groups for which ``whole`` holds stay complete."""
    sample = lambda x: top_per_group(x, by, n, [arithmetic_hash(F.col(key)), F.col(key)])
    return sample(df) if whole is None else sample(df.filter(~whole)).unionByName(df.filter(whole))


def bernoulli(df: DataFrame, key: str, share: float) -> DataFrame:
    """About ``share`` of the rows, chosen by hash: the same rows each time."""
    return df.filter(arithmetic_hash(F.col(key)) < F.lit(int(share * 2147483648)))


def shuffled(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows without replacement, in pseudorandom order."""
    return df.orderBy(arithmetic_hash(F.col(key)), key).limit(n)


def folds(df: DataFrame, key: str, n: int) -> DataFrame:
    """For each of n folds the role of each row: test in its own, validation in the next one (cyclic), else train.

    Rows go to folds by hash, so no global order is needed.
    """
    own = F.pmod(F.shiftright(arithmetic_hash(F.col(key)), 8), F.lit(n))
    out = df.withColumn("__own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    role = F.when(F.col("__own") == F.col("fold"), "test").when(F.pmod(F.col("__own") + 1, F.lit(n)) == F.col("fold"), "validation").otherwise("train")
    return out.withColumn("role", role).drop("__own")


def merge_first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of parts of which, for each key, the first part's row stays (within one: the smallest row)."""
    names = parts[0].columns
    union = None
    for i, part in enumerate(parts):
        part = part.select(*names, F.lit(i).alias("__part"))
        union = part if union is None else union.unionByName(part)
    return first_per_key(union, [key], ["__part", *names]).select(*names)


def merge_last_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """As ``merge_first_wins``, but later parts replace earlier ones."""
    return merge_first_wins(parts[::-1], key)


#: Keys of either side that meet in a task of ``cross_pairs``, about, and in a block of the second.
PART, BLOCK = 4_000, 256


def cross_pairs(a: DataFrame, b: DataFrame, key: str, symmetric: bool = False) -> DataFrame:
    """Ordered pairs of keys: all of a with others of a (symmetric), or a with b and b with a.

    The keys lie in few files, their pairs are many: both sides are dealt out and each two parts meet in a task. There each
    key of one comes with a block of the other in the same order, so that columns of pairs are written in little space.
    """
    x, y = a.select(F.col(key).alias("first")), (a if symmetric else b).select(F.col(key).alias("second"))
    seconds = max(1, -(-y.count() // PART))
    firsts = max(-(-x.count() // PART), -(-a.sparkSession.sparkContext.defaultParallelism * 4 // seconds))
    blocks = y.repartition(seconds).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)).groupBy("block").agg(F.collect_list("second").alias("seconds"))
    met = blocks.select("seconds").repartition(seconds).hint("shuffle_replicate_nl").crossJoin(x.repartition(firsts))
    pairs = met.select("first", F.explode("seconds").alias("second")).filter("first <> second")
    return pairs if symmetric else pairs.unionAll(pairs.select("second", "first"))


def offsets(df: DataFrame, length: Column, most: int, least: int, name: str = "offset") -> DataFrame:
    """Each row with every offset 0..min(most, max(0, length - least))."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most), F.greatest(F.lit(0), length - least)).cast("long"))))


def named_subset(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return df.join(names.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key).distinct(), key, "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that come more than once: a guard before order-dependent steps."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def selected(groups: list[tuple[str, set[str]]], chain: str = "chain", residue: str = "resnum") -> Column:
    """Predicate of residue groups: none without groups; a chain with an empty set is wholly selected."""
    out = F.lit(False)
    for name, residues in groups:
        out = out | ((F.col(chain) == name) & (F.col(residue).isin(*sorted(residues)) if residues else F.lit(True)))
    return out


def ranked(df: DataFrame, pipeline: str, most: int, kind: str = "pipeline", rank: str = "rank") -> DataFrame:
    """Rows of one pipeline with a rank of at most ``most``."""
    return df.filter((F.col(kind) == pipeline) & (F.col(rank) <= most))


def ranked_names(df: DataFrame, by: list[str], order: list, kind: str = "pipeline", name: str = "design") -> DataFrame:
    """Rows with their rank in their group, from 1, and a name ``pipeline_rank``."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out.withColumn(name, F.concat_ws("_", F.col(kind).cast("string"), F.col("rank").cast("string")))


def numbered(entries: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Rows with their index in an order, from ``start``.

    They are ordered in ranges, which are written, so that their sizes are those of the rows that get numbers; no task
    orders them all.
    """
    work = Workspace(entries.sparkSession, "order")
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = work.table(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))  # a row for each range
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    out = ranged.join(F.broadcast(sizes), "__part")
    return out.withColumn("index", F.lit(start) + F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")
