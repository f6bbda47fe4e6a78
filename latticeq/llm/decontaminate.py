"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of ``LEAST`` tokens that a text shares with a benchmark item; every tile is made of seeds, so what
they cover of an item bounds its coverage from above. Where that reaches the threshold, tiles are placed: the longest
matches of unmarked tokens are found by running Karp-Rabin at falling search lengths and marked, longest first, until
none of ``LEAST`` tokens is left. The share of the item under tiles decides, so that passages in another order count.

The benchmark is the stated query set: it is read in blocks of bounded size, each of which meets all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeq.llm.shared import Workspace, broadcast, lean
from latticeq.llm.tokens import SPACES, HashIndex, Tokenizer, _power, mix, pieces, text_buffer, windows

#: Tokens of the shortest tile, share of an item's tokens under tiles that condemns, bytes of benchmark text in a block.
LEAST, COVERAGE, BLOCK_BYTES = 5, 0.5, 16 << 20
SEPARATORS = SPACES + bytes(b for b in range(33, 127) if not chr(b).isalnum())


class _Rolling:
    """Karp-Rabin hashes of all runs of a length: running sums once, then one subtraction a run for each length."""

    def __init__(self, words: np.ndarray) -> None:
        up, self.down = _power(len(words) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])

    def __call__(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _free(free: np.ndarray, length: int) -> np.ndarray:
    """Whether all tokens of each run of a length are unmarked."""
    total = np.concatenate([[0], np.cumsum(free)])
    return total[length:] - total[:-length] == length


def _scan(text: np.ndarray, pattern: np.ndarray, rolling: tuple[_Rolling, _Rolling], free_t: np.ndarray, free_p: np.ndarray, length: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Matches (size, text, pattern) of unmarked tokens, of ``length`` at least; stops early at one over twice that."""
    ht, hp = (r(length) for r in rolling)
    table: dict[int, list[int]] = {}
    for p in np.flatnonzero(_free(free_p, length)).tolist():
        table.setdefault(int(hp[p]), []).append(p)
    found, longest, reach = [], 0, {}
    wanted = np.fromiter(table, np.uint64, len(table)) if table else np.zeros(0, np.uint64)
    for t in np.flatnonzero(_free(free_t, length) & np.isin(ht, wanted)).tolist():
        for p in table[int(ht[t])]:
            if t < reach.get(t - p, -1):
                continue  # inside a match already found on this diagonal
            size = 0
            while t + size < len(text) and p + size < len(pattern) and text[t + size] == pattern[p + size] and free_t[t + size] and free_p[p + size]:
                size += 1
            if size < length:
                continue
            reach[t - p] = t + size
            longest = max(longest, size)
            if size > 2 * length:
                return size, []
            found.append((size, t, p))
    return longest, found


def greedy_tiles(text: np.ndarray, pattern: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (size, start in text, start in pattern), longest first as marked; ties go to the earliest in the text."""
    free_t, free_p = np.ones(len(text), np.int64), np.ones(len(pattern), np.int64)
    rolling = _Rolling(text), _Rolling(pattern)
    tiles, length = [], max(least, min(len(text), len(pattern)) // 2)
    while length >= least and min(len(text), len(pattern)) >= least:
        longest, found = _scan(text, pattern, rolling, free_t, free_p, length) if min(len(text), len(pattern)) >= length else (0, [])
        if longest > 2 * length:
            length = longest
            continue
        queue = sorted(found, key=lambda m: (-m[0], m[1], m[2]))
        while queue:
            size, t, p = queue.pop(0)
            taken = np.flatnonzero((free_t[t : t + size] == 0) | (free_p[p : p + size] == 0))
            if not len(taken):
                free_t[t : t + size] = free_p[p : p + size] = 0
                tiles.append((size, t, p))
                continue
            cuts = [-1, *taken.tolist(), size]  # what is left of it between marked tokens may still do
            queue += [(b - a - 1, t + a + 1, p + a + 1) for a, b in zip(cuts[:-1], cuts[1:]) if b - a - 1 >= length]
            queue.sort(key=lambda m: (-m[0], m[1], m[2]))
        if length == least:
            break
        length = max(least, length // 2)
    return tiles


class Benchmark:
    """Items of one block with the places of their seeds."""

    def __init__(self, ids: list, texts: list[str], least: int) -> None:
        self.tokenizer, self.least, self.ids, self.items = Tokenizer(SEPARATORS), least, [], []
        for i, text in zip(ids, texts):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            words = self.tokenizer(raw, np.array([0, len(raw)]))[0]
            if len(words) >= least:
                self.ids.append(i)
                self.items.append(words)
        grams = [windows(w, least) for w in self.items]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        keys, at, many = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        self.index, self.item, self.place, self.many = HashIndex(keys), item[order], place[order], many
        self.first = np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else np.zeros(0, np.int64)

    def findings(self, column: pa.Array, coverage: float):
        """(row, item id, coverage, tiles) for each text and item that share enough."""
        data, at = text_buffer(column)
        for lo, hi in pieces(at):
            words, _, bounds = self.tokenizer(data, at[lo : hi + 1])
            grams = windows(words, self.least)
            seed = self.index(grams)
            hit = np.flatnonzero(seed >= 0)
            row = np.searchsorted(bounds, hit, side="right") - 1
            inside = hit + self.least <= bounds[row + 1]
            hit, row = hit[inside], row[inside]
            cuts = np.flatnonzero(np.diff(row, prepend=-1)).tolist() + [len(row)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield from ((lo + int(row[a]), *found) for found in self._text(words[bounds[row[a]] : bounds[row[a] + 1]], hit[a:b] - bounds[row[a]], seed[hit[a:b]], coverage))

    def _text(self, words: np.ndarray, where: np.ndarray, seed: np.ndarray, coverage: float):
        at, many = self.first[seed], self.many[seed]
        flat = np.repeat(at - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item, place, where = self.item[flat], self.place[flat], np.repeat(where, many)
        order = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.diff(item[order], prepend=-1)).tolist() + [len(order)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            pattern = self.items[item[rows[0]]]
            covered = np.zeros(len(pattern) + 1, np.int64)
            np.add.at(covered, place[rows], 1)
            np.add.at(covered, place[rows] + self.least, -1)
            if np.count_nonzero(np.cumsum(covered)) < coverage * len(pattern):
                continue
            # only tokens under a seed of this item can be in a tile; between stretches of them stands a token of no item
            under = np.zeros(len(words) + 1, np.int64)
            np.add.at(under, where[rows], 1)
            np.add.at(under, where[rows] + self.least, -1)
            inside = np.cumsum(under)[:-1] > 0
            gap = ~inside & np.concatenate([[False], inside[:-1]])
            keep = np.flatnonzero(inside | gap)
            text = np.where(inside[keep], words[keep], np.uint64(0))
            tiles = sorted((int(keep[t]), p, n) for n, t, p in greedy_tiles(text, pattern, self.least))
            share = sum(n for _, _, n in tiles) / len(pattern)
            if share >= coverage:
                yield self.ids[item[rows[0]]], share, ",".join(f"{t}:{p}:{n}" for t, p, n in tiles)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, least: int):
    """The benchmark as ``Benchmark`` blocks of about ``BLOCK_BYTES`` of text."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        part.sort(key=lambda r: (r.id is None, r.id if r.id is not None else 0, r.text))
        yield Benchmark([r.id for r in part], [r.text for r in part], least)


def _by_block(spark, blocks, apply):
    """``apply`` of each block's broadcast; all but the last result are written, so that tasks hold one block at a time."""
    work, last = Workspace(spark, "benchmark"), None
    for block in blocks:
        if last is not None:
            yield work.table(apply(last))
            last.unpersist()
        last = broadcast(spark, block)
    yield apply(last)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = LEAST, coverage: float = COVERAGE,
) -> DataFrame:
    """One row per text and benchmark item of which tiles cover ``coverage`` or more: id, item, coverage, tiles.

    ``tiles`` lists ``start in text:start in item:tokens``. Tokens are runs of bytes other than white space and ASCII
    punctuation, A-Z lower-cased. Null texts match nothing, nor do items of fewer than ``least`` tokens. Of matches of one
    length the earliest in the text is marked first. Repeated rows and repeated items give repeated findings; an empty
    table gives none; other columns are ignored. A text of any length is read whole; of a long one only what seeds cover
    is tiled.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def finder(model):
        def run(batches):
            for batch in batches:
                found = list(model.value.findings(batch.column("text"), coverage))
                if found:
                    at, items, share, tiles = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(items), pa.array(share), pa.array(tiles)], names=["id", "item", "coverage", "tiles"])

        return run

    layout = f"id {kind}, item {item_kind}, coverage double, tiles string"
    spark = docs.sparkSession
    out = None
    for found in _by_block(spark, blocks_of(benchmark, item_col, item_text_col, least), lambda model: rows.mapInArrow(lean(finder(model)), layout)):
        out = found if out is None else out.unionAll(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, as they are, in which no benchmark item is covered as ``contamination`` has it."""

    def keeper(model):
        def run(batches):
            for batch in batches:
                bad = {row for row, *_ in model.value.findings(batch.column(text_col).cast(pa.string()), coverage)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        return run

    held = [docs]
    for kept in _by_block(docs.sparkSession, blocks_of(benchmark, item_col, item_text_col, least), lambda model: held[0].mapInArrow(lean(keeper(model)), docs.schema)):
        held[0] = kept
    return held[0]


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` that hold items of ``benchmark``."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
