"""Line deduplication by winnowing.

A window is a shortest run of lines of ``WORDS`` words or more, from a line on or up to one. Its fingerprint is its least
line hash together with the hash of all its lines. Each window is compared with the first one of its fingerprint (by
identifier, then line), which has the same lines, and later ones are deleted. Windows cover every run of so many words, so
that exactly the lines of runs that an earlier place repeats go, and the first of all copies always stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeq.llm.shared import Workspace, bitmap, lean, marked
from latticeq.llm.tokens import Tokenizer, _power, mix, pieces, text_buffer

#: Words of the shortest run that is deleted.
WORDS = 50


def line_hashes(tokenizer: Tokenizer, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of texts data[at[i]:at[i+1]]: hash of their words (0: blank), number of words, first line of each text."""
    base = at[0]
    part, at = data[base : at[-1]], at - base
    breaks = np.flatnonzero(part == 10)
    # a text of n line breaks has n + 1 lines; an empty one has one
    text_of = np.searchsorted(at, breaks, side="right") - 1
    lines = np.bincount(text_of, minlength=len(at) - 1)[: len(at) - 1] + 1
    first = np.concatenate([[0], np.cumsum(lines)])
    words, starts, _ = tokenizer(data, at + base)
    text = np.searchsorted(at, starts, side="right") - 1
    line = np.searchsorted(breaks, starts) + text
    count = np.bincount(line, minlength=first[-1])
    out = np.zeros(first[-1], np.uint64)
    if len(words):
        begins = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(words)) - np.repeat(begins, np.diff(np.append(begins, len(words))))
        with np.errstate(over="ignore"):
            out[line[begins]] = mix(np.add.reduceat(words * mix((place + 1).astype(np.uint64)), begins)) | np.uint64(1)
    return out, count, first


def windows(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, mass: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shortest runs of ``mass`` words from each line on and up to each line: first line, end, least line hash, hash of all.

    Lines count from 0 over all texts; no window leaves its text. The lines of any run of so many words are just those of
    the windows inside it: up to the end of the first window from a line on, and after that each ends one.
    """
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + mass)
    begins = np.searchsorted(total, total[1:] - mass, side="right") - 1
    text_first, text_end = (np.repeat(x, np.diff(first)) for x in (first[:-1], first[1:]))
    onward, back = np.flatnonzero(ends <= text_end), np.flatnonzero(begins >= text_first)
    both = np.unique(np.concatenate([onward * (n + 1) + ends[onward], begins[back] * (n + 1) + back + 1]))
    a, b = both // (n + 1), both % (n + 1)
    if not len(both):
        return a, b, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    weighed = np.append(np.where(words > 0, hashes, np.uint64(2**64 - 1)), np.uint64(0))
    least = np.minimum.reduceat(weighed, np.stack([a, b], axis=1).reshape(-1))[::2]
    up, down = _power(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(1)) * up[:n], dtype=np.uint64)])
        whole = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return a, b, least, whole


def _windows(mass: int):
    def run(batches):
        tokenizer = Tokenizer()
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for lo, hi in pieces(at):
                hashes, words, first = line_hashes(tokenizer, data, at[lo : hi + 1])
                a, b, least, whole = windows(hashes, words, first, mass)
                text = np.searchsorted(first, a, side="right") - 1
                rows = batch.slice(lo, hi - lo).select(["id", "same"]).take(pa.array(text))
                lines = [pa.array((x - first[text]).astype(np.int32)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *lines, pa.array(least.view(np.int64)), pa.array(whole.view(np.int64))], names=["id", "same", "line", "end", "mark", "whole"])

    return run


def _runs(later: DataFrame) -> DataFrame:
    """For each text (id, same) the merged runs of its windows (line, end), in order: begins and ends of equal length."""
    text = Window.partitionBy("id", "same").orderBy("line", "end")
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("new", F.coalesce(F.col("line") > reach, F.lit(True)).cast("long"))
    runs = apart.withColumn("run", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "same", "run").agg(F.min("line").alias("begin"), F.max("end").alias("end"))
    return runs.groupBy("id", "same").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("latticeq runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mass: int = WORDS) -> DataFrame:
    """All columns of ``docs``, the text without later repeated runs, and n_lines, n_removed, removed.

    ``removed`` lists the deleted lines as ``first-last`` (from 0). Lines are compared by their words, A-Z lower-cased;
    blank lines weigh nothing and go only inside a run. Repeats within one text count too; of equal places the first by
    identifier, then line, stays. A null text stays null, with 0 lines. Rows with a null identifier are left alone and are
    nobody's source; repeated rows of one identifier and text share their fate and are not repeats of each other. Time
    and memory grow in proportion to a text's lines, however many. An empty table gives an empty result. Columns named
    like the added ones are replaced.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    old = docs.drop("n_lines", "n_removed", "removed")
    column = F.col(f"`{text_col}`").cast("string")
    body = F.coalesce(column, F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(body).alias("same"), body.alias("text"))
    places = work.table(rows.mapInArrow(lean(_windows(mass)), f"id {kind}, same long, line int, end int, mark long, whole long"))
    place = F.struct("id", "same", "line")
    firsts = places.groupBy("mark", "whole").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = work.table(firsts.filter("first < last").drop("last"))
    later = places.join(firsts.hint("merge"), ["mark", "whole"]).filter(place > F.col("first")).select("id", "same", "line", "end").distinct()
    gone = work.table(_runs(later).withColumnsRenamed({"id": "latticeq id", "same": "latticeq same"}))
    # what was found grows with the corpus, so it is never broadcast: a bitmap of it parts the texts that stay as they are
    bits = work.table(bitmap(gone, F.col("`latticeq id`"), F.col("`latticeq same`")))
    key = F.col(f"`{id_col}`"), F.xxhash64(body)
    whole = marked(old, bits, *key, how="left_anti").withColumn("latticeq runs", F.lit(None).cast(gone.schema["latticeq runs"].dataType))
    some = marked(old, bits, *key).withColumn("latticeq key", key[1]).join(gone.hint("merge"), (F.col(f"`{id_col}`") == F.col("`latticeq id`")) & (F.col("`latticeq key`") == F.col("`latticeq same`")), "left")
    kept = whole.unionAll(some.select(*(f"`{c}`" for c in whole.columns)))
    lines = F.split(column, "\n", -1)
    # what stands before, between and after the runs
    starts, stops = F.concat(F.array(F.lit(0)), F.col("`latticeq runs`.end")), F.concat(F.col("`latticeq runs`.begin"), F.array(F.size(lines)))
    left = F.array_join(F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")
    text = F.when(F.col("`latticeq runs`").isNull() | column.isNull(), F.col(f"`{text_col}`")).otherwise(left)
    spans = F.array_join(F.transform("`latticeq runs`", lambda r: F.concat_ws("-", r.begin.cast("string"), (r.end - 1).cast("string"))), ",")
    return kept.select(
        *(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in old.columns),
        F.when(column.isNull(), F.lit(0)).otherwise(F.regexp_count(column, F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("`latticeq runs`", F.lit(0), lambda n, r: n + r.end - r.begin), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(spans, F.lit("")).alias("removed"),
    )


def op1_dedup_lines(spark, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` without passages that an earlier document has."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", "text")
