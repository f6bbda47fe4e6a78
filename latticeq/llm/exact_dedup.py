"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned on sampled splitters of their normalised text and sorted, so that equal texts lie next to
each other in one partition; neighbours are compared over the full text, and what is equal is a run, which is settled
on the spot: its size and the identifier that stays come from the sorted run itself. The splitters see a bounded prefix
and a hash, so what the driver samples stays small however long the texts are.

A group of copies may be any share of the table. Texts of which there are more rows than a piece may hold (at most
``PIECES`` a partition, by counts of their hashes) carry a piece number behind their hash, so that splitters can cut
them; each piece is a run, and the few pieces of such a text are compared once more to settle it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeq.llm.shared import Workspace

#: Characters of the text in the splitters, pieces of hot texts for each shuffle partition, fewest rows of a piece.
SPLITTER_CHARS, PIECES, PIECE_ROWS = 48, 4, 256


def _runs(docs: DataFrame, work: Workspace, id_col: str, text_col: str, keep: str, normalise, *carried: Column) -> DataFrame:
    """All rows with their place in the run of equal texts that they are sorted into, and what the run says.

    __id, the carried columns, __sha, __nth (1: the row that stays of its run), __best (its identifier), __size, and for
    pieces of hot texts __piece and, at __nth = 1, __text; both are null for all others.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("__id"), *carried, text.alias("__text"), F.xxhash64(text).alias("__hash"))
    counts = docs.groupBy(F.xxhash64(text).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    share = max(PIECE_ROWS, docs.count() // (PIECES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # more rows than a piece holds: there are fewer such texts than pieces, whatever the table
    hot = work.table(counts.filter(F.col("__n") > share).select("__of", F.ceil(F.col("__n") / share).cast("int").alias("__pieces")))
    rows = rows.join(F.broadcast(hot), F.col("__hash") == F.col("__of"), "left").drop("__of")
    rows = rows.withColumns({
        "__head": F.substring("__text", 1, SPLITTER_CHARS),
        "__piece": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__pieces")).cast("int"),
    })
    best = F.col("__id").desc_nulls_last() if keep == "largest" else F.col("__id").asc_nulls_last()
    run = Window.partitionBy("__head", "__hash", "__piece", "__text")
    nth = F.row_number().over(run.orderBy(best))
    names = [c for c in rows.columns if c not in ("__text", "__hash", "__pieces", "__head", "__piece")]
    return rows.repartitionByRange("__head", "__hash", "__piece").select(
        *names,
        F.sha2("__text", 256).alias("__sha"),
        nth.alias("__nth"),
        (F.max("__id") if keep == "largest" else F.min("__id")).over(run).alias("__best"),
        F.count(F.lit(1)).over(run).alias("__size"),
        "__piece",
        F.when(F.col("__piece").isNotNull() & (nth == 1), F.col("__text")).alias("__text"),
    )


def _settled(runs: DataFrame, keep: str) -> DataFrame:
    """For each hot text, from its pieces: the identifier that stays, its piece, the size of the whole group."""
    last = F.col("__best").desc_nulls_last() if keep == "largest" else F.col("__best").asc_nulls_last()
    text = Window.partitionBy("__text")
    pieces = runs.filter("__piece IS NOT NULL AND __nth = 1")
    heads = pieces.withColumns({"__rank": F.row_number().over(text.orderBy(last, "__piece")), "__all": F.sum("__size").over(text)}).filter("__rank = 1")
    return heads.select(F.col("__sha").alias("__hot"), F.col("__best").alias("__keep"), F.col("__piece").alias("__at"), "__all")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. ``keep`` is ``smallest`` or ``largest``: of equal texts the row with that identifier
    stays; among repeated rows with that same identifier exactly one is kept. A null identifier loses to any other.
    ``normalise`` maps the text column before comparison (default: no change). Texts are compared whole, however long.
    An empty table gives an empty result; other columns are ignored whatever their names.
    """
    work = Workspace(docs.sparkSession, "exact")
    runs = work.table(_runs(docs, work, id_col, text_col, keep, normalise))
    settled = work.table(_settled(runs, keep))
    out = runs.join(F.broadcast(settled), F.col("__piece").isNotNull() & (F.col("__sha") == F.col("__hot")), "left")
    whole = F.col("__piece").isNull()
    return out.select(
        F.col("__id").alias(id_col),
        F.when(whole, F.col("__best")).otherwise(F.col("__keep")).alias("keep_id"),
        F.when(whole, F.col("__size")).otherwise(F.col("__all")).alias("group_size"),
        ((F.col("__nth") == 1) & (whole | (F.col("__piece") == F.col("__at")))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns as they are: one for each text."""
    work = Workspace(docs.sparkSession, "exact")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    heads = work.table(_runs(docs, work, id_col, text_col, keep, normalise, row).filter("__nth = 1"))
    settled = work.table(_settled(heads, keep))
    out = heads.join(F.broadcast(settled), F.col("__piece").isNotNull() & (F.col("__sha") == F.col("__hot")), "left")
    return out.filter(F.col("__piece").isNull() | (F.col("__piece") == F.col("__at"))).select("__row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Copies in ``documents``; the largest doc_id of each text stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
