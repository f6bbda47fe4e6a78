"""Structure, frame, seed, bridge and segment databases as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeq.operators.selection import numbered


def write_structures(structures: DataFrame, path: str, append: bool = False) -> None:
    """Structures (one row a residue or atom); ``append`` merges into a database that is there."""
    structures.write.mode("append" if append else "error").parquet(path)


def read_structures(spark: SparkSession, paths: list[str], contacts: bool = False) -> DataFrame:
    """Databases as one, columns by name. ``contacts``: for seeds, a database without the property ``vdw`` is an error."""
    parts = [spark.read.parquet(p) for p in paths]
    if contacts and (missing := [p for p, part in zip(paths, parts) if "vdw" not in part.columns]):
        raise ValueError(f"no property vdw in {', '.join(missing)}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=not contacts)
    return out


def append_entries(entries: DataFrame, path: str, order: list[str]) -> None:
    """Entries at the end of a seed database (made if it isn't there), with their index."""
    spark = entries.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    start = spark.read.parquet(path).count() if there else 0
    numbered(entries, order, start).write.mode("append").parquet(path)


def entries_from(database: DataFrame, first: int, count: int | None = None) -> DataFrame:
    """Entries from an index on: what skipping and reading the next ones gives."""
    at = F.col("index") >= first
    return database.filter(at if count is None else at & (F.col("index") < first + count))


def entries_named(database: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    return database.join(names.select(key).distinct(), key, "left_semi")


def renamed(database: DataFrame, names: DataFrame, key: str = "name", new: str = "new_name") -> DataFrame:
    """Entries with the new names of a table (name, new_name); others keep theirs."""
    out = database.join(names.select(F.col(key).alias("__key"), F.col(new).alias("__new")), F.col(key) == F.col("__key"), "left")
    return out.withColumn(key, F.coalesce("__new", key)).drop("__key", "__new")


def write_bridges(bridges: DataFrame, path: str) -> None:
    """Bridges (``chains.bridges``), by length, so that a reader of short ones skips the others' files."""
    bridges.write.partitionBy("len").parquet(path)


def read_bridges(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """Bridges of at most ``longest`` residues."""
    rows = spark.read.parquet(path)
    rows = rows if longest is None else rows.filter(F.col("len") <= longest)
    return rows.withColumn("len", F.col("len").cast("long"))


def write_segments(representatives: DataFrame, edges: DataFrame, path: str) -> None:
    """Segment representatives and their overlap graph (src, dst, rmsd)."""
    representatives.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def neighbours(edges: DataFrame, nodes: DataFrame, key: str, forward: bool = True) -> DataFrame:
    """For each node the nodes that may follow it (forward: it is the edge's source) or come before it: key, neighbour, rmsd."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return nodes.select(key).join(edges.select(F.col(a).alias(key), F.col(b).alias("neighbour"), "rmsd"), key)


def similarity_json(similar: DataFrame, names: Column, sparse: bool = True) -> DataFrame:
    """One JSON object of binder names and similarities: pairs ``[[i, j], s]`` (sparse), or rows of a matrix.

    similar: a, b, jaccard with a and b numbers into the names. The object is one row, as its file is one.
    """
    pairs = similar if not sparse else similar.filter("jaccard > 0")
    if sparse:
        cells = F.array_sort(F.collect_list(F.struct("a", "b", "jaccard")))
        text = F.concat(F.lit("["), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("[["), c.a.cast("string"), F.lit(", "), c.b.cast("string"), F.lit("], "), c.jaccard.cast("string"), F.lit("]"))), ", "), F.lit("]"))
    else:
        rows = pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "jaccard"))).alias("row"))
        pairs = rows.select("a", F.transform("row", lambda c: c.jaccard).alias("row"))
        text = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("a", "row"))), lambda r: r.row))
    return pairs.agg(F.concat(F.lit('{"binder_names": '), F.to_json(names), F.lit(', "similarity": '), text, F.lit("}")).alias("value"))
