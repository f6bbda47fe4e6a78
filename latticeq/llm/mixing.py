"""Mixing sources to target weights.

Each source's documents, in a fixed order, form one stream of words that is cut into blocks of a fixed length.
Every output shard draws how many blocks it takes of each source; slot k of a source takes block
``permutation(k mod blocks)`` of it, so a block comes again only once every other has been taken. Blocks are joined
to documents by index.

The draws are multinomial, conditioned on each source's total over all shards (what exceeds it is drawn again):
unconditioned draws would let a source that is at its limit go over it. The driver holds no draws: every task that makes
a shard's slots draws the counts of the halves of the mix that the shard lies in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeq.llm.shared import Workspace, lean

#: Words that count; block length in words; documents in a chunk whose sizes are summed by one task.
WORD, BLOCK, CHUNK = r"[^\x20\x09-\x0D]+", 256, 2048
#: Slots of an output shard; sources at most, whose sizes and targets the driver and every task hold.
SHARD_SLOTS, MAX_SOURCES = 65_536, 1_000_000


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``limit`` times its size; the excess is shared again by weight."""
    out, rest = [0.0] * len(sizes), float(total)
    left = sorted(range(len(sizes)), key=lambda i: limit * sizes[i] / weights[i])
    mass = float(sum(weights))
    while left and limit * sizes[left[0]] * mass <= rest * weights[left[0]]:
        i = left.pop(0)
        out[i] = limit * float(sizes[i])
        rest, mass = rest - out[i], mass - weights[i]
    mass = float(sum(weights[i] for i in left))
    for i in left:
        out[i] = rest * weights[i] / mass
    return out


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at the points k: a four-round Feistel network, walked back into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                f = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = once(k.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def drawn(rest: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of n draws by the shares of ``rest``: multinomial, with what exceeds a source's rest drawn again."""
    out = np.zeros_like(rest)
    while n > 0:
        free = rest - out
        got = np.minimum(rng.multinomial(n, free / free.sum()), free)
        out, n = out + got, n - int(got.sum())
    return out


def shard_counts(quota: np.ndarray, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source before a shard of ``slots`` slots and in it.

    The shards are halved again and again, and the first half of each part draws its counts, seeded by the part: any
    task finds any shard's counts by itself, in as many draws as halvings, and all agree.
    """
    lo, hi, before, rest = 0, -(-int(quota.sum()) // slots), np.zeros_like(quota), quota
    while hi - lo > 1:
        middle = (lo + hi) // 2
        first = drawn(rest, (middle - lo) * slots, np.random.default_rng([seed, lo, hi]))
        if shard < middle:
            hi, rest = middle, first
        else:
            lo, before, rest = middle, before + first, rest - first
    return before, rest


def _laid_out(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, limit: float, block: int, seed: int, texts: bool,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream (``texts``: and their text), and the mix's slots: shard, slot, idx, at."""
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    text = F.col(f"`{text_col}`").cast("string")
    more = ["text"] if texts else []
    sized = work.table(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("body"), *(text.alias(c) for c in more)))
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    words = [int(r.words) for r in totals]
    target = fill_targets(words, [float(weights[i % len(weights)]) for i in range(len(totals))], share * sum(words), limit)
    length = [max(1, min(block, w // 128)) for w in words]
    blocks = [-(-w // b) for w, b in zip(words, length)]
    quota = [min(round(t * n / w), int(limit * n)) if w else 0 for t, n, w in zip(target, blocks, words)]
    facts = spark.createDataFrame(
        [(i, r.source, words[i], target[i], length[i], max(1, -(-r.n // CHUNK))) for i, r in enumerate(totals)],
        "idx int, source string, source_size long, target double, block int, chunks long",
    )
    known = sized.join(F.broadcast(facts), sized.source.eqNullSafe(facts.source)).select("id", facts.source, "size", "idx", "source_size", "target", "block", "body", *more, F.pmod(F.xxhash64("id", "body", F.lit(seed)), F.col("chunks")).alias("chunk"))

    # where each document begins in its source's stream: sums over chunks, then within each
    sums = known.groupBy("idx", "chunk").agg(F.sum("size").alias("chunk_words"))
    sums = sums.select("idx", "chunk", (F.sum("chunk_words").over(Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("chunk_words")).alias("before"))
    inside = Window.partitionBy("idx", "chunk").orderBy(F.col("id").asc_nulls_last(), "body").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.withColumn("end", F.sum("size").over(inside)).join(sums, ["idx", "chunk"]).withColumn("start", F.col("before") + F.col("end") - F.col("size"))
    placed = work.table(placed.select("id", "source", "size", "idx", "source_size", "target", "block", "start", *more))

    counts = np.array(quota, np.int64)
    shards = spark.range(-(-sum(quota) // SHARD_SLOTS)).repartition("id")

    def picks(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                before, n = shard_counts(counts, SHARD_SLOTS, shard, seed)
                total, first = int(n.sum()), 0
                for i in np.flatnonzero(n).tolist():
                    k = before[i] + np.arange(n[i])
                    at = permute(k % blocks[i], blocks[i], seed * 1_000_003 + i)
                    # the sources' slots are scattered over the shard
                    slot = permute(first + np.arange(n[i]), total, seed * 1_000_003 + shard)
                    first += int(n[i])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array(slot), pa.array(np.full(len(at), i, np.int32)), pa.array(at)], names=["shard", "slot", "idx", "at"])

    return placed, shards.mapInArrow(lean(picks), "shard long, slot long, idx int, at long")


def _by_block(placed: DataFrame) -> DataFrame:
    """Documents of positive size, once for each block that they reach into (``at``), with the words of theirs in it (``part``)."""
    over = placed.filter("size > 0").withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))))
    part = F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("at") * F.col("block"))
    return over.withColumn("part", part)


def mixed_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2, block: int = BLOCK, seed: int = 17,
) -> DataFrame:
    """The mix itself: shard, slot, nth, id, source, words (the piece's words, one space between).

    A slot is a block of one source; its pieces are of the documents that the block spans, in the order ``nth``. The mix
    reads by shard, slot and nth. Parameters as in ``mix_sources``, whose ``taken`` counts these words.
    """
    placed, slots = _laid_out(docs, id_col, text_col, source_col, weights, share, limit, block, seed, True)
    over = _by_block(placed)
    skipped = F.greatest(F.lit(0), F.col("at") * F.col("block") - F.col("start"))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), skipped.cast("int") + 1, F.col("part").cast("int")), " ")
    nth = F.row_number().over(Window.partitionBy("idx", "at").orderBy("start")).cast("long")
    pieces = over.select("idx", "at", nth.alias("nth"), F.col("id").alias(id_col), F.col("source").alias(source_col), words.alias("words"))
    return slots.hint("merge").join(pieces, ["idx", "at"]).select("shard", "slot", "nth", id_col, source_col, "words")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2, block: int = BLOCK, seed: int = 17,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken.

    Sources by code point, null last, get the weights in turn and share ``share`` times all words; a target stops at
    ``limit`` times its source's size. ``taken`` counts the document's words in the mix, repeats included; no document
    exceeds ``limit`` rounded up times its size. Null or blank texts have size 0 and are taken 0 times; a null source is
    a source of its own. Repeated rows count each; documents stand in their source's stream by identifier, then by text.
    A text of any length is so many blocks. An empty table gives an empty result; other columns are ignored whatever
    their names. A source of few words gets shorter blocks (its size / 128), so that rounding to whole blocks stays below
    one percent of its target. Reruns give the same result: all draws are seeded. ``mixed_texts`` gives the words
    themselves, from the same slots. More than ``MAX_SOURCES`` sources: an
    error.
    """
    placed, slots = _laid_out(docs, id_col, text_col, source_col, weights, share, limit, block, seed, False)
    taken = slots.groupBy("idx", "at").agg(F.count(F.lit(1)).alias("times"))
    # (source, start) names a row of positive size, repeated rows included; what was drawn grows with the corpus, though
    # the range of shards that it comes from looks small to the planner, so it is never the broadcast side
    mixed = _by_block(placed).join(taken.hint("merge"), ["idx", "at"], "left").groupBy("idx", "start", "id", "source", "size", "source_size", "target").agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    columns = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return mixed.select(*columns).unionAll(placed.filter("size = 0").withColumn("taken", F.lit(0)).select(*columns))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
