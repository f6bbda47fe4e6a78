"""Hidden Markov language model, trained by Baum-Welch over a whole corpus.

Words are 64-bit hashes. Their counts come from a distributed sum; a bounded number of the most frequent (``KNOWN``)
goes to every task. Words seen ``LEAST`` times, or the ``OWN`` most frequent if those are more, have emissions of their
own, so that their number grows with the corpus; all other words share one class, within which a word has its smoothed share of the class's count, whatever the state. A text's likelihood is thus the scaled
forward recursion over symbols times the shares of its rarer words, both exact; words that are not among the known ones
get their counts by a join.

Expected counts are made in each partition and added as integers (fixed point), so that their order doesn't matter.
For training, texts are cut into stretches of at most ``STRETCH`` tokens; for scoring, a longer text's stretches are
run from every state and combined, which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeq.llm.language import held_out
from latticeq.llm.shared import Workspace, broadcast, lean, most_frequent
from latticeq.llm.tokens import HashIndex, Tokenizer, pieces, text_buffer

#: States, rounds of training, least number of words with emissions of their own, words whose counts every task has (or all
#: those with emissions), occurrences from which a word has emissions in any case.
STATES, ROUNDS, OWN, KNOWN, LEAST = 8, 3, 2046, 400_000, 50
#: Least and largest weight of staying in a state before training, in weights of leaving it.
STAY = (0.1, 30)
#: Tokens of a stretch, bytes of text run together, tokens counted at a time, units of a fixed-point count.
STRETCH, TOGETHER, AT_A_TIME, UNITS = 1024, 6 << 20, 2_000_000, 1 << 16
#: Expected emissions held by a task before they are added up, symbols in a row of them, rows the driver fetches at a time.
HELD, SPAN, BLOCK = 1 << 20, 512, 512


class Lanes:
    """Sequences laid out by step: at each step the first so many lanes, longest first, have a symbol."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[self.order], lengths[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.width = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than t
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        lane = np.concatenate([np.arange(w) for w in self.width]) if steps else np.zeros(0, np.int64)
        self.symbols = symbols[starts[lane] + np.repeat(np.arange(steps), self.width)]


class Model:
    """start (k), move (k, k) and emit (symbols, k); symbols: the words with emissions, other words, the end."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = (x.astype(np.float32) for x in (start, move, emit))

    @staticmethod
    def initial(counts: np.ndarray, states: int, seed: int = 5) -> Model:
        """Symbol shares, perturbed differently for each state; some states are mostly stayed in, others soon left.

        From moves without a preference the expectations hardly leave the point at which all states are the same. Where a
        state lasts, its perturbations add up over a stretch, and such states part within a round or two, as languages do;
        the others are there for what alternates.
        """
        rng = np.random.default_rng(seed)
        emit = (counts[:, None] + 0.5).astype(np.float32) * (rng.random((len(counts), states), np.float32) * 1.2 + 0.4)
        move = rng.uniform(0.5, 1.5, (states, states)) + states * np.diag(np.geomspace(*STAY, states))
        return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, dtype=np.float64).astype(np.float32))

    @staticmethod
    def of_counts(total: np.ndarray, states: int) -> Model:
        """The maximum of expected counts laid out as ``expected`` does, smoothed by a little."""
        start, move, emit = total[:states] + 0.1, total[states : states + states**2].reshape(states, states) + 0.1, total[states + states**2 :].reshape(-1, states) + 0.01
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def expected(self, lanes: Lanes) -> np.ndarray:
        """Expected counts of starts, moves and emissions of all symbols."""
        start, move, used, emits = self.gathered(lanes)
        every = np.zeros(self.emit.shape)
        every[used] = emits
        return np.concatenate([start, move.reshape(-1), every.reshape(-1)])

    def gathered(self, lanes: Lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts and moves, symbols that occur, their emissions, by scaled forward and backward passes."""
        k, at, width = len(self.start), lanes.at, lanes.width
        occurs = np.zeros(len(self.emit), bool)
        occurs[lanes.symbols] = True
        used = np.flatnonzero(occurs)
        place = np.zeros(len(occurs), np.int32)
        place[used] = np.arange(len(used))
        symbols = place[lanes.symbols]
        emit = self.emit[used][symbols]
        alpha, scale = np.empty_like(emit), np.empty(len(emit), np.float32)
        for t, m in enumerate(width.tolist()):
            a = (self.start if t == 0 else alpha[at[t - 1] : at[t - 1] + m] @ self.move) * emit[at[t] : at[t] + m]
            c = a.sum(axis=1)
            alpha[at[t] : at[t] + m], scale[at[t] : at[t] + m] = a / c[:, None], c
        start, move = np.zeros(k), np.zeros((k, k))
        beta = np.zeros((0, k), np.float32)
        for t in range(len(width) - 1, -1, -1):
            m, rows = int(width[t]), slice(at[t], at[t + 1])
            beta = np.concatenate([beta, np.ones((m - len(beta), k), np.float32)])
            if t:
                before = alpha[at[t - 1] : at[t - 1] + m]
                onward = emit[rows] * beta / scale[rows, None]
                move += self.move * (before.T @ onward)
            alpha[rows] *= beta
            if t:
                beta = onward @ self.move.T
            else:
                start += alpha[rows].sum(axis=0, dtype=np.float64)
        return start, move, used, np.stack([np.bincount(symbols, alpha[:, j], len(used)) for j in range(k)], axis=1)

    def log10(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 likelihood of the sequences symbols[first[i]:last[i]] (each of one symbol at least)."""
        k = len(self.start)
        pieces_, starts, lengths, lane_start = [], [], [], []
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            for at in range(a, b, STRETCH):
                n = min(STRETCH, b - at)
                for state in [-1] if at == a else range(k):  # later stretches run from each state
                    pieces_.append(i)
                    starts.append(at)
                    lengths.append(n)
                    lane_start.append(state)
        lanes = Lanes(symbols, np.array(starts, np.int64), np.array(lengths, np.int64))
        begin = np.array(lane_start)[lanes.order] if len(lane_start) else np.zeros(0, np.int64)
        # what stands before the first emission: the start, or the moves from one state
        ahead = np.concatenate([self.move, self.start[None]])[begin]
        emit = self.emit
        a = np.zeros((len(begin), k), np.float32)
        log = np.zeros(len(begin))
        for t, m in enumerate(lanes.width.tolist()):
            rows = slice(lanes.at[t], lanes.at[t + 1])
            x = (ahead if t == 0 else a[:m] @ self.move) * emit[lanes.symbols[rows]]
            c = x.sum(axis=1)
            a[:m] = x / c[:, None]
            log[:m] += np.log(c)
        out_a, out_log = np.empty_like(a), np.empty_like(log)
        out_a[lanes.order], out_log[lanes.order] = a, log
        out = np.zeros(len(first))
        j = 0
        while j < len(pieces_):
            i = pieces_[j]
            vector, total = out_a[j].astype(np.float64), out_log[j]
            j += 1
            while j < len(pieces_) and pieces_[j] == i:
                top = out_log[j : j + k].max()
                vector = (vector * np.exp(out_log[j : j + k] - top)) @ out_a[j : j + k]
                c = vector.sum()
                vector, total = vector / c, total + top + np.log(c)
                j += k
            out[i] = total / np.log(10)
        return out


def _words(batches):
    """Counts of word hashes, a row for each word and two million tokens."""
    tokenizer, held, many = Tokenizer(), [], 0

    def counted():
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        for lo, hi in pieces(at):
            held.append(tokenizer(data, at[lo : hi + 1])[0])
            many += len(held[-1])
            if many >= AT_A_TIME:
                yield counted()
                held, many = [], 0
    if held:
        yield counted()


def _symbols(words: np.ndarray, bounds: np.ndarray, index, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with an end after each text, where texts begin and end among them."""
    got = index(words)
    n = len(bounds) - 1
    out = np.empty(len(words) + n, np.int32)
    last = bounds[1:] + np.arange(1, n + 1)
    ends = np.zeros(len(out), bool)
    ends[last - 1] = True
    out[ends] = own + 1
    out[~ends] = np.where((got >= 0) & (got < own), got, own)
    return out, np.concatenate([[0], last[:-1]]), last


def _expecting(state):
    """Expected counts in units, packed: a row for each task and run of ``SPAN`` places (starts, moves, then symbols)."""

    def run(batches):
        index, own, model = state.value
        tokenizer, at_, units, many = Tokenizer(), [], [], 0
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for lo, hi in pieces(at, TOGETHER):
                words, bounds = tokenize(tokenizer, data, at, lo, hi)
                symbols, first, last = _symbols(words, bounds, index, own)
                cuts = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(first.tolist(), last.tolist())])
                ends = np.append(cuts[1:], last[-1])
                start, move, used, emits = model.gathered(Lanes(symbols, cuts, ends - cuts))
                at_.append(np.concatenate([np.arange(1 + len(move)), used + 1 + len(move)]))
                units.append(np.rint(np.concatenate([start[None], move, emits]) * UNITS).astype(np.int64))
                many += len(at_[-1])
                if many >= HELD:
                    at_, units = _added(at_, units)
                    if (many := len(at_[0])) >= HELD // 2:
                        yield packed(at_[0], units[0])
                        at_, units, many = [], [], 0
        if at_:
            at_, units = _added(at_, units)
            yield packed(at_[0], units[0])

    return run


def _added(at: list[np.ndarray], units: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    places = np.concatenate(at)
    order = np.argsort(places, kind="stable")
    places = places[order]
    new = np.flatnonzero(np.diff(places, prepend=places[0] - 1))
    return [places[new]], [np.add.reduceat(np.concatenate(units)[order], new, axis=0)]


def packed(at: np.ndarray, units: np.ndarray) -> pa.RecordBatch:
    """Rows (span, at, units) from sorted places and their counts, ``states`` to a place."""
    first = np.flatnonzero(np.diff(at // SPAN, prepend=-1))
    ends = np.append(first, len(at)).astype(np.int32)
    lists = (pa.ListArray.from_arrays(pa.array(ends * k), pa.array(x)) for k, x in ((1, (at % SPAN).astype(np.int32)), (units.shape[1], np.ascontiguousarray(units).reshape(-1))))
    return pa.RecordBatch.from_arrays([pa.array(at[first] // SPAN), *lists], names=_PACKED.names)


_PACKED = pa.schema([("span", pa.int64()), ("at", pa.list_(pa.int32())), ("units", pa.list_(pa.int64()))])


def _unpacked(table, states: int):
    """(span, places within it, counts) of each row."""
    at, units = table.column("at"), table.column("units")
    for i, span in enumerate(table.column("span").to_pylist()):
        yield span, at[i].values.to_numpy(), units[i].values.to_numpy().reshape(-1, states)


def _adding(states: int):
    """Sums of the rows of each span that this task has; a task holds one array for each of its spans, not for each row."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for span, at, units in _unpacked(batch, states):
                if span not in sums:
                    sums[span] = np.zeros((SPAN, states), np.int64)
                sums[span][at] += units
        for span, total in sums.items():
            yield packed(span * SPAN + np.arange(SPAN), total)

    return run


def tokenize(tokenizer: Tokenizer, data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts lo to hi and where each text's begin, hashed a piece at a time."""
    words, bounds, n = [], [np.zeros(1, np.int64)], 0
    for a, b in pieces(at[lo : hi + 1]):
        got, _, first = tokenizer(data, at[lo + a : lo + b + 1])
        words.append(got)
        bounds.append(first[1:] + n)
        n += len(got)
    return np.concatenate(words), np.concatenate(bounds)


class Trained:
    """What every task needs to score: known words and counts, corpus totals, the model."""

    def __init__(self, index: HashIndex, counts: np.ndarray, own: int, tokens: int, types: int, ends: int, model: Model) -> None:
        self.index, self.counts, self.own, self.model = index, counts, own, model
        self.tokens, self.ends = tokens, ends  # N, the end included, and its count
        self.types = types  # V
        self.floor = float(tokens + types + 1)
        shared = tokens - ends - int(counts[:own].sum())
        self.shared = float(shared + max(0, types - (ends > 0) - own) + 1)  # of the class of other words, smoothed


def _scoring(state):
    def run(batches):
        t: Trained = state.value
        tokenizer = Tokenizer()
        known = np.log10((t.counts + 1) / t.floor)
        share = np.where(np.arange(len(t.counts)) < t.own, 0.0, np.log10((t.counts + 1) / t.shared))
        end = float(np.log10((t.ends + 1) / t.floor))
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for lo, hi in pieces(at, TOGETHER):
                words, bounds = tokenize(tokenizer, data, at, lo, hi)
                n = hi - lo
                got = t.index(words)
                symbols, first, last = _symbols(words, bounds, lambda _, got=got: got, t.own)
                inside = got >= 0
                doc = np.repeat(np.arange(n), np.diff(bounds))
                base = np.bincount(doc, np.where(inside, known[got] if len(known) else 0.0, 0.0), n) + end
                rare = np.bincount(doc, np.where(inside, share[got] if len(share) else 0.0, 0.0), n)
                seen = np.bincount(doc, inside, n).astype(np.int64) + (t.ends > 0)
                score = t.model.log10(symbols, first, last) + rare
                rows = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("id"), rows.column("held_out"), pa.array(np.diff(bounds) + 1), pa.array(seen), pa.array(base), pa.array(score), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                    names=_COLUMNS,
                )
                if len(out := np.flatnonzero(~inside)):
                    pairs, times = _pairs(doc[out], words[out])
                    m = len(times)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("row").take(pa.array(pairs[0])), pa.nulls(m, rows.column("id").type), pa.nulls(m, pa.bool_()), *(pa.nulls(m, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(pairs[1].view(np.int64)), pa.array(times)],
                        names=_COLUMNS,
                    )

    return run


def _pairs(doc: np.ndarray, word: np.ndarray):
    """Distinct (text, word) and how often each is."""
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]))
    return (doc[new].astype(np.int64), word[new]), np.diff(np.append(new, len(doc)))


_COLUMNS = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"]


def train(rows: DataFrame, work: Workspace, states: int = STATES, rounds: int = ROUNDS) -> tuple[Trained, DataFrame]:
    """The model of the texts in ``rows`` (column text), and the table of all word counts (word, c)."""
    spark = rows.sparkSession
    counts = work.table(rows.mapInArrow(lean(_words), "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))
    totals = counts.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens")).first()
    ends = rows.count()
    often = counts.filter(F.col("c") >= LEAST)
    many = often.count()
    if many > KNOWN:  # all of them are known
        top = often.select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    else:
        top = most_frequent(counts, "word", "c", KNOWN)
    words, c = top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    own = min(max(OWN, many), len(words))
    symbols = np.concatenate([c[:own], [totals.tokens - c[:own].sum(), ends]]).astype(np.float64)
    model = Model.initial(symbols, states)
    small = HashIndex(words[:own])
    layout = "span long, at array<int>, units array<long>"
    for _ in range(rounds if ends else 0):
        state = broadcast(spark, (small, own, model))
        made = rows.mapInArrow(lean(_expecting(state)), layout).repartition("span")
        units = work.table(made.mapInArrow(lean(_adding(states)), layout))
        # as Model.of_counts, but for a block of spans at a time
        total = np.zeros((1 + states + len(symbols), states), np.float32)
        for lo in range(0, len(total) // SPAN + 1, BLOCK):
            for span, at, part in _unpacked(units.filter(F.col("span").between(lo, lo + BLOCK - 1)).toArrow(), states):
                inside = at[span * SPAN + at < len(total)]
                total[span * SPAN + inside] += part[inside] / UNITS
        head, emit = total[: 1 + states] + 0.1, total[1 + states :]
        emit += np.float32(0.01)
        emit /= emit.sum(axis=0, dtype=np.float64).astype(np.float32)
        model = Model(head[0] / head[0].sum(), head[1:] / head[1:].sum(axis=1, keepdims=True), emit)
        work.drop(units)
        state.unpersist()
    return Trained(HashIndex(words), c, own, totals.tokens + ends, totals.types + (ends > 0), ends, model), counts


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` is a column that is true for rows not learned from (default: none is held out). Null text counts as empty:
    one token, the end. base_score is the add-one unigram log10 probability, score that of the model. Repeated rows
    come out repeated, and each is learned from; of equally frequent words the lesser hash comes first; a text of any
    length is scored whole, by stretches; other columns are ignored; without training texts all words are unknown and the model uniform
    but for its perturbation. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "hmm")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    held = F.lit(False) if held is None else held
    trained, counts = train(docs.filter(~held).select(text), work, states, rounds)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held.alias("held_out"), text)
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, word long, times long"
    made = work.table(rows.mapInArrow(lean(_scoring(broadcast(spark, trained))), schema))
    rare = made.filter("word IS NOT NULL").select("row", "word", "times").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(trained.floor))).alias("base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(trained.shared))).alias("share"),
    )
    out = made.filter("word IS NULL").join(rare, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_hmm_score(spark, sf_dir: str) -> DataFrame:
    """Likelihood of every text of ``documents``, learned from those that are not held out."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), held=held_out("doc_id", 7))
