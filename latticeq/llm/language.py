"""Language identification by prediction by partial matching.

For each language the training bytes give a variable-order context tree: counts of the byte that follows each context
of up to ``order`` bytes. A byte seen d distinct ways in n visits of its context has probability c / (n + d); the
escape mass d / (n + d) goes to the unseen bytes in proportion to the next shorter context. A text's code length is
the exact sum of -log2 of these under frozen counts; the language with the shortest code wins.

Frozen counts of bounded order make the tree a table: the context's deepest node and the next byte index the code
lengths of all languages at once, so that a text is scored by two array look-ups a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from latticeq.llm.shared import broadcast, lean, settle, ship
from latticeq.llm.tokens import pieces, text_buffer

#: Bytes of context. Labelled documents a language is learned from, about (chosen by hash; their whole texts are read).
#: Fewest visits a longest context needs to become a node.
ORDER, PER_LANGUAGE, VISITS = 3, 400, 2


class ContextTrees:
    """Code lengths of all languages: ``bits[node * symbols + symbol]`` is one row of floats, a language each."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        """grams: for each language sorted codes of order + 1 bytes, the last one most significant byte first, and counts."""
        self.langs, self.order = langs, order
        if not langs:
            return
        used = sorted({int(b) for codes, _ in grams.values() for k in range(order + 1) for b in np.unique(codes >> np.uint64(8 * k) & np.uint64(255))})
        self.symbol = np.full(256, len(used), np.int32)  # every byte never seen: one symbol, its mass shared equally
        self.symbol[used] = np.arange(len(used))
        self.symbols = s = len(used) + 1
        unseen = 256 - len(used)
        tables = {}
        for lang in langs:
            codes, counts = grams[lang]
            digits = [self.symbol[(codes >> np.uint64(8 * (order - k)) & np.uint64(255)).astype(np.int64)].astype(np.int64) for k in range(order + 1)]
            tables[lang] = (digits, counts.astype(np.float64))
        base = np.full(s, 1.0 / 256)
        base[-1] = unseen / 256
        # nodes of each depth, over all languages; context codes read oldest symbol first
        self.nodes: list[np.ndarray] = [np.zeros(1, np.int64)]
        probs = [np.stack([_step(base[None], d[order], c, np.zeros(len(c), np.int64), 1) for d, c in (tables[x] for x in langs)])]
        for depth in range(1, order + 1):
            keys = {x: _code(tables[x][0][order - depth : order], s) for x in langs}
            every = np.concatenate([keys[x] for x in langs])
            weight = np.concatenate([tables[x][1] for x in langs])
            found, at = np.unique(every, return_inverse=True)
            visits = np.bincount(at, weight, len(found))
            found = found[visits >= (VISITS if depth > 1 else 1)]
            parent = np.searchsorted(self.nodes[-1], found % s ** (depth - 1)) if depth > 1 else np.zeros(len(found), np.int64)
            ok = (parent < len(self.nodes[-1])) & (self.nodes[-1][np.minimum(parent, len(self.nodes[-1]) - 1)] == found % s ** (depth - 1)) if depth > 1 else np.ones(len(found), bool)
            found, parent = found[ok], parent[ok]
            layer = []
            for k, x in enumerate(langs):
                d, c = tables[x]
                node = np.searchsorted(found, keys[x])
                inside = node < len(found)
                inside[inside] = found[node[inside]] == keys[x][inside]
                layer.append(_step(probs[-1][k][parent], d[order][inside], c[inside], node[inside], len(found)))
            self.nodes.append(found)
            probs.append(np.stack(layer))
        # for each context of ``order`` symbols its deepest node
        offsets = np.cumsum([0] + [len(x) for x in self.nodes])
        self.deepest = np.zeros(s**order, np.int32)
        for depth in range(1, order + 1):
            view = self.deepest.reshape(s ** (order - depth), s**depth)
            view[:, self.nodes[depth]] = offsets[depth] + np.arange(len(self.nodes[depth]))
        table = np.concatenate(probs, axis=1)
        table[:, :, -1] /= max(unseen, 1)
        self.bits = np.ascontiguousarray(np.moveaxis(-np.log2(np.maximum(table, 1e-300)), 0, 2).reshape(-1, len(langs)).astype(np.float32))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document under each language (documents: data[offsets[i]:offsets[i+1]])."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data) or not self.langs:
            return out
        sym = self.symbol[data]
        # before a text's first byte stand bytes never seen, so that its first contexts are short
        blank = self.symbols - 1
        context = np.zeros(len(sym), np.int64)
        starts = offsets[:-1]
        for k in range(self.order, 0, -1):
            back = np.full(len(sym), blank, np.int32)
            back[k:] = sym[:-k]
            for j in range(k):
                at = starts + j
                back[at[at < np.minimum(offsets[1:], len(sym))]] = blank
            context = context * self.symbols + back
        row = self.deepest[context].astype(np.int64) * self.symbols + sym
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        for k in range(len(self.langs)):
            out[full, k] = np.add.reduceat(self.bits[:, k][row].astype(np.float64), starts[full])
        return out


def _code(digits: list[np.ndarray], s: int) -> np.ndarray:
    out = np.zeros(len(digits[0]), np.int64)
    for x in digits:
        out = out * s + x
    return out


def _step(shorter: np.ndarray, symbol: np.ndarray, count: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """Probabilities at the nodes of one depth, from those of their shorter contexts."""
    s = shorter.shape[1]
    c = np.bincount(node * s + symbol, count, nodes * s).reshape(nodes, s)
    n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
    free = np.where(c > 0, 0.0, shorter)
    rest = free.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.where(c > 0, c, d * free / rest) / (n + d)
        p = np.where(rest > 0, p, c / n)
    return np.where(n > 0, p, shorter)


def _grams(order: int):
    def run(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            data, at = text_buffer(batch.column("text"))
            for lang in sorted(set(langs)):
                parts = []
                for i in np.flatnonzero(langs == lang).tolist():
                    raw = data[at[i] : at[i + 1]].astype(np.uint64)
                    if len(raw) > order:
                        code = np.zeros(len(raw) - order, np.uint64)
                        for k in range(order + 1):
                            code = code << np.uint64(8) | raw[k : len(raw) - order + k]
                        parts.append(code)
                if parts:
                    codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "many"])

    return run


def learn_languages(labelled: DataFrame, key: str, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, order: int = ORDER) -> ContextTrees:
    """Context trees from about ``per_language`` whole texts a language, chosen by a hash of ``key``.

    The counts are made and added up by the executors; the driver gets them (distinct runs of ``order + 1`` bytes).
    """
    ship(labelled.sparkSession)
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return ContextTrees([], {}, order)
    share = F.coalesce(*(F.when(F.col(lang_col) == x, F.lit(min(1.0, per_language / n))) for x, n in sizes.items()))
    chosen = known.filter(F.pmod(F.xxhash64(F.col(key), F.lit(41)), F.lit(1 << 20)) < share * (1 << 20))
    rows = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(lean(_grams(order)), "lang string, gram long, many long")
    trees = _trees(rows.groupBy("lang", "gram").agg(F.sum("many").alias("many")), order)
    settle(labelled.sparkSession, 0)  # the tables that the trees were made from are many times as large
    return trees


def _trees(rows: DataFrame, order: int) -> ContextTrees:
    grams, counts = {}, rows.toPandas()
    for lang, part in counts.groupby("lang"):
        part = part.assign(gram=part["gram"].to_numpy(np.int64).view(np.uint64)).sort_values("gram")
        grams[lang] = (part["gram"].to_numpy(np.uint64), part["many"].to_numpy(np.int64))
    return ContextTrees(sorted(grams), grams, order)


def _scoring(model, source: str, kept: list[str], added: list[str]):
    def run(batches):
        trees = model.value
        for batch in batches:
            column = batch.column(source)
            data, at = text_buffer(column)
            bits = np.concatenate([trees.code_lengths(data, at[lo : hi + 1]) for lo, hi in pieces(at)]) if len(at) > 1 else np.zeros((0, len(trees.langs)))
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if trees.langs:
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                langs = [trees.langs[b] if ok else "und" for b, ok in zip(best, letters)]
                score = np.where(letters, 1 / odds, 0.0)
                size = np.diff(at)
                rate = pa.array(bits.min(axis=1) / np.maximum(size, 1), mask=size == 0)
            else:
                langs, score, rate = ["und"] * len(letters), np.zeros(len(letters)), pa.nulls(len(letters), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(langs, pa.string()), pa.array(score), rate], names=[*kept, *added])

    return run


def identify_languages(docs: DataFrame, trees: ContextTrees, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, bits_per_byte (or ``names``), replacing columns of those names.

    score is the posterior probability of lang_pred under equal priors, bits_per_byte the code length of the whole text
    in lang_pred. A null text, or one without a letter of any script, is ``und`` with score 0; so is everything if no
    language was learned. bits_per_byte is null for empty texts and where no language was learned. Equal code lengths:
    the first language by name. Repeated rows come out repeated; an empty table gives an empty result; a text of any
    length is one row of one batch and is scored whole. The text is only read; other columns pass through as they are.
    """
    spark: SparkSession = docs.sparkSession
    model = broadcast(spark, trees)
    kept = [f for f in docs.schema.fields if f.name not in names]
    columns = [F.col(f"`{f.name}`") for f in kept]
    source = text_col
    # a text column that passes through needs no copy
    if not isinstance(docs.schema[text_col].dataType, StringType) or text_col in names:
        source = "text to score"
        columns.append(F.col(f"`{text_col}`").cast("string").alias(source))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    added = f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double"
    return docs.select(*columns).mapInArrow(lean(_scoring(model, source, [f.name for f in kept], list(names))), f"{schema}, {added}" if schema else added)


def held_out(id_col: str, modulus: int):
    """Whether a document is kept from training: crc32 of its identifier as text leaves 2 (a null one: not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == 2, F.lit(False))


def trained_trees(docs: DataFrame, id_col: str = "doc_id") -> ContextTrees:
    """Context trees from the training part of a table of documents with ``text`` and ``lang``."""
    return learn_languages(docs.filter(~held_out(id_col, 4)), id_col)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", held_out("doc_id", 4).alias("held_out"), "text")
    return identify_languages(rows, trained_trees(docs)).select("doc_id", "held_out", "lang_pred", "score")
