"""What the operators of this subpackage share: broadcasts, frequent keys, bitmaps of keys, tables between steps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeq import staging
from latticeq.staging import ship

__all__ = ["Workspace", "bitmap", "broadcast", "lean", "marked", "most_frequent", "settle", "ship"]


def trim() -> None:
    """Give what this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function over Arrow batches that gives freed memory back to the system at its end: Python workers live on."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


#: Seconds between two collections of the driver's garbage, at least.
SETTLE_SECONDS = 5
_settled = 0.0


def settle(spark: SparkSession, every: float = SETTLE_SECONDS) -> None:
    """Give back what the driver no longer needs, its Python's and its JVM's, unless that was done ``every`` seconds ago or less.

    An operator of many steps leaves plans, generated classes and broadcasts, for which the JVM's heap grows to its bound
    before it looks for them; a whole collection also shrinks the heap, and lets Spark clean up behind what is gone.
    """
    global _settled
    if time.monotonic() - _settled >= every:
        trim()
        spark.sparkContext._jvm.System.gc()
        _settled = time.monotonic()


class Workspace(staging.Workspace):
    """Tables between the steps of an operator; the driver's garbage goes between them."""

    def table(self, df: DataFrame) -> DataFrame:
        out = super().table(df)
        settle(self.spark)
        return out


def broadcast(spark: SparkSession, value):
    """A broadcast of a value of this package's classes, which the executors can read."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def most_frequent(counts: DataFrame, key: str, count: str, limit: int):
    """At most ``limit`` rows (key, count) of the largest counts, as pandas, largest first, equal ones by key.

    A histogram of the logarithm of the counts gives the least count to fetch, so that the driver gets no more than the
    result; a bin that would go over the limit is left out whole.
    """
    scale = F.floor(F.log2(count) * 64)
    bins = sorted(counts.groupBy(scale.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, total = None, 0
    for b in bins:
        if (total := total + b.n) > limit:
            break
        least = b.bin
    chosen = counts.filter(scale >= least) if least is not None else counts.limit(0)
    return chosen.select(key, count).toPandas().sort_values([count, key], ascending=[False, True], ignore_index=True)


#: 64-bit words of a bitmap of keys.
BITMAP_WORDS = 1 << 18


def key_bits(*columns) -> tuple:
    """Where a bitmap has the bit of a key: number of the word, and the word with that bit set."""
    key = F.xxhash64(*columns)
    return F.pmod(key, F.lit(BITMAP_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(key, 32), F.lit(64)).cast("int"))


def bitmap(keys: DataFrame, *columns) -> DataFrame:
    """A bitmap of the hashes of the keys of a table: ``BITMAP_WORDS`` rows at most, however long the table is."""
    word, bit = key_bits(*columns)
    return keys.groupBy(word.alias("latticeq word")).agg(F.bit_or(bit).alias("latticeq bits"))


def marked(rows: DataFrame, bits: DataFrame, *columns, how: str = "left_semi") -> DataFrame:
    """Rows whose key has its bit set: all with a key of the table and few others (left_anti: only such as have none).

    It thins out the large side of an exact join by a broadcast of bounded size, at every size of either side.
    """
    word, bit = key_bits(*columns)
    return rows.join(F.broadcast(bits), (word == F.col("`latticeq word`")) & (bit.bitwiseAND(F.col("`latticeq bits`")) != 0), how)
