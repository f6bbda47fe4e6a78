"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. A stage's result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeq.llm.decontaminate import decontaminate
from latticeq.llm.exact_dedup import drop_copies
from latticeq.llm.jaccard_join import drop_near_copies
from latticeq.llm.language import identify_languages, trained_trees
from latticeq.llm.mixing import mix_sources
from latticeq.llm.shared import Workspace

#: Bits of a byte of text as it stands: a text whose code is no shorter than that is in none of the learned languages.
RAW_BITS = 8


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: with a letter, and of a code length below ``RAW_BITS`` a byte in the best one.

    Null and empty texts, and such without a letter, go. Where no language could be learned (no labelled rows, an empty
    table), all texts with a letter stay. Ties between languages and repeated rows don't matter: each row is judged by its own
    whole text, however long. All columns come back as they were, also those named like the model's.
    """
    names = tuple(f"{x} of the language model" for x in ("language", "score", "bits"))
    found = identify_languages(docs, trained_trees(docs), names=names)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.filter(letter & F.coalesce(F.col(f"`{names[2]}`") < RAW_BITS, F.lit(True))).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that of the largest doc_id (null: the least); null text counts as empty.

    Of repeated rows one stays. Empty tables and columns of any further name pass as they are.
    """
    return drop_copies(docs, keep="largest")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id; rows with no word or a null doc_id stay.

    A doc_id with several texts: each text is judged by itself. Repeated rows share their fate. Empty tables and columns
    of any further name pass as they are.
    """
    return drop_near_copies(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none.

    An empty benchmark or table drops nothing; repeated rows share their fate; all columns come back as they were.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: columns, nulls, repeats and empty tables as ``mix_sources`` says."""
    return mix_sources(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", keep_one_copy),
    ("jaccard_join", keep_one_of_near),
    ("decontaminate", keep_clean),
    ("mix_sources", mix),
]

#: Language ID, the tiling and the draws of the mix have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
