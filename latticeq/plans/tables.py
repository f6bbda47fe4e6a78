"""Readers of the driver's tables and frames derived from them for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: vec_id, label, x, y, z."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), *(F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")))


POINTS = "p AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as residues of chains (users): chain, pos, letter, value."""
    from latticeq.operators.chains import numbered

    e = table(spark, sf_dir, "events")
    return numbered(e, "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("chain"), "pos", F.substring("event_type", 1, 1).alias("letter"), "event_type", "value", "event_id")


RESIDUES = "r AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, substr(event_type, 1, 1) AS letter, event_type, value, event_id FROM events)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each chain in order: chain, s."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    return residues(spark, sf_dir).groupBy("chain").agg(F.array_join(F.transform(ordered, lambda x: x.letter), "").alias("s"))


SEQUENCES = f"{RESIDUES}, q AS (SELECT chain, string_agg(letter, '' ORDER BY pos) AS s FROM r GROUP BY chain)"


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as nucleotides: doc_id, s (only A, C, G and T)."""
    d = table(spark, sf_dir, "documents")
    mapped = F.translate(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return d.select("doc_id", mapped.alias("s"))


BASES = "b AS (SELECT doc_id, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM documents)"


def energies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An energy table over 25 nations (positions) and 5 letters: self_e, pair_e (neighbours in a ring of 3), seq."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"))
    a = spark.range(5)
    own = n.crossJoin(F.broadcast(a)).select("pos", F.col("id").alias("aa"), (((F.col("pos") * 7 + F.col("id") * 13) % 17) / 4.0 - 2.0).alias("e"))
    pair = n.select(F.col("pos").alias("pos_i"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 3)).alias("pos_j")).filter("pos_j < 25")
    pair = pair.crossJoin(F.broadcast(a.select(F.col("id").alias("aa_i")))).crossJoin(F.broadcast(a.select(F.col("id").alias("aa_j"))))
    pair = pair.withColumn("e", ((F.col("pos_i") * 3 + F.col("pos_j") * 5 + F.col("aa_i") * 11 + F.col("aa_j") * 2) % 19) / 8.0 - 1.0)
    seq = n.select("pos", (F.col("pos") * 3 % 5).alias("aa"), (F.col("pos") >= 15).alias("binder"))
    return own, pair, seq


ENERGIES = """n AS (SELECT CAST(n_nationkey AS BIGINT) AS pos FROM nation), a AS (SELECT range AS aa FROM range(5)),
self_e AS (SELECT pos, aa, ((pos * 7 + aa * 13) % 17) / 4.0::DOUBLE - 2.0 AS e FROM n, a),
pair_e AS (SELECT i.pos AS pos_i, j.pos AS pos_j, a.aa AS aa_i, b.aa AS aa_j, ((i.pos * 3 + j.pos * 5 + a.aa * 11 + b.aa * 2) % 19) / 8.0::DOUBLE - 1.0 AS e
  FROM n i JOIN n j ON j.pos BETWEEN i.pos + 1 AND i.pos + 3, a, a b),
both_e AS (SELECT * FROM pair_e UNION ALL SELECT pos_j, pos_i, aa_j, aa_i, e FROM pair_e),
seq AS (SELECT pos, pos * 3 % 5 AS aa, pos >= 15 AS binder FROM n)"""


def structures(spark: SparkSession, sf_dir: str, places: int = 6, letters: int = 4) -> DataFrame:
    """Small energy tables for optimisers, one for each region: sid, pos_i, pos_j, aa_i, aa_j, e."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("sid"))
    p, a = spark.range(places), spark.range(letters)
    own = r.crossJoin(p.withColumnRenamed("id", "pos_i")).crossJoin(a.withColumnRenamed("id", "aa_i"))
    own = own.select("sid", "pos_i", F.lit(None).cast("long").alias("pos_j"), "aa_i", F.lit(None).cast("long").alias("aa_j"), ((F.col("sid") * 5 + F.col("pos_i") * 7 + F.col("aa_i") * 3) % 11 / 4.0).alias("e"))
    pair = r.crossJoin(p.withColumnRenamed("id", "pos_i")).crossJoin(p.withColumnRenamed("id", "pos_j")).filter("pos_i < pos_j")
    pair = pair.crossJoin(a.withColumnRenamed("id", "aa_i")).crossJoin(a.withColumnRenamed("id", "aa_j"))
    pair = pair.select("sid", "pos_i", "pos_j", "aa_i", "aa_j", ((F.col("sid") + F.col("pos_i") * 3 + F.col("pos_j") * 5 + F.col("aa_i") * 7 + F.col("aa_j") * 2) % 13 / 5.0 - 1.2).alias("e"))
    return own.unionAll(pair)
