"""Personal data by a skip-chain conditional random field.

Nodes are the spans that the base patterns find and further candidates: pieces that are written like a telephone number,
an address of four numbers, a grouped or plain number of nine digits or more, or have an ``@``, and lie in no base span,
for instance because the base pattern ran on into what stands next to them. Neighbours in the text are linked, and so
are successive occurrences, however far apart, of nodes that are equal (the same digits, or the same address but for
case) and of nodes that are similar (the same last seven digits, or the same part before the ``@``). Labels are none,
email, ip, card and phone.

The field is trained by pseudo-likelihood on the base spans of the whole corpus, with their own labels masked: how a node
is written, what stands beside it and the labels of the nodes it is linked with predict its label. Tasks count distinct
such cases, of which there are few however large the corpus, and the weights are fitted to the counts. To label a text,
base spans are observed, and loopy belief propagation gives the candidates' marginals; a candidate that is more likely
than not an entity becomes a span.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeq.llm.shared import Workspace, broadcast, lean
from latticeq.llm.spans import join_spans
from latticeq.llm.tokens import text_buffer

KINDS = ["email", "ip", "card", "phone"]
#: Rounds of message passing, share of the old message kept in each; steps of training, strength of its prior.
ROUNDS, DAMPING, STEPS, PRIOR = 12, 0.3, 400, 1.0
#: Weight that the prior gives to equal and to similar nodes of one entity's label, or of none, together.
AGREE = {"same": 6.0, "like": 4.0}
#: Score of no entity that the prior gives to a way of writing: one that no base span has needs its links to be one.
NONE = 3.0

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PIECE = re.compile(
    r"\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-]?[0-9]{2,4}){2,5}(?![0-9])"  # as telephone numbers are written
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"
    r"|(?<![0-9])[0-9]{2,6}(?:[\x20-][0-9]{2,6}){2,4}(?![0-9])"  # grouped
    r"|[0-9]{9,}"
)
_ADDRESS = re.compile(r"(?<![^\s@])(?:[^\sA-Za-z0-9@]*+)([^\s@]*+@[^\s@]*+)")


def luhn(digits: str) -> bool:
    """Whether a string of digits has a valid check digit."""
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping for each kind."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def shape(text: str) -> str:
    """The feature of a node: what it is written like."""
    if "@" in text:
        return "@." if _DOMAIN.fullmatch(text.rpartition("@")[2]) else "@"
    d = digits_of(text)
    return f"{min(len(d), 20)}{'+' * text.startswith('+')}{'.' * (text.count('.') == 3)}{'-' * bool(re.search('[ ()/_-]', text))}{'c' * (12 <= len(d) <= 19 and luhn(d))}"


def alike(text: str) -> tuple[str, str]:
    """Nodes of an equal first key are the same, those of an equal second key similar."""
    if "@" in text:
        return text.lower(), text.lower().partition("@")[0] + "@"
    d = digits_of(text)
    return d, d[-7:]


def beside(c: str) -> str:
    """What kind of character stands next to a node."""
    return "" if not c else "a" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else "."


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans (label: kind + 1) and candidates that overlap none (label 0), by start."""
    spans = [(a, b, k + 1) for a, k, b in base]
    if base or "@" in text or _DIGIT.search(text):
        gap = 0
        for begin, end in [*sorted((a, b) for a, _, b in base), (len(text), len(text))]:
            for expression in (_PIECE, _ADDRESS) if gap < begin and "@" in text else (_PIECE,) if gap < begin else ():
                for m in expression.finditer(text, gap, begin):
                    a, b = m.span(m.lastindex or 0)
                    while b > a and not text[b - 1].isalnum():
                        b -= 1
                    if a < b:
                        spans.append((a, b, 0))
            gap = max(gap, end)
    out = []
    for a, b, k in sorted(spans):
        same, like = alike(text[a:b])
        out.append({"a": a, "b": b, "label": k, "shape": shape(text[a:b]), "left": beside(text[a - 1 : a]), "right": beside(text[b : b + 1]), "same": same, "like": like})
    return out


def links_of(nodes: list[dict]) -> dict[str, np.ndarray]:
    """Index pairs by kind of link: each node with the next one, the next equal one, the next that is similar only."""
    out: dict[str, list] = {"chain": [(i, i + 1) for i in range(len(nodes) - 1)], "same": [], "like": []}
    last: dict[tuple[str, str], int] = {}
    for i, node in enumerate(nodes):
        for kind in ("same", "like"):
            j = last.get((kind, node[kind]))
            if j is not None and (kind == "same" or nodes[j]["same"] != node["same"]):
                out[kind].append((j, i))
            last[kind, node[kind]] = i
    return {kind: np.array(pairs, np.int64).reshape(-1, 2) for kind, pairs in out.items()}


def marginals(unary: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Beliefs of a pairwise model by loopy sum-product. unary: (n, k) logs; links: index pairs with their (k, k) logs."""
    n, k = unary.shape
    links = [(x, w) for x, w in links if len(x)]
    messages = [(np.zeros((len(x), k)), np.zeros((len(x), k))) for x, _ in links]  # to the second, to the first

    def total() -> np.ndarray:
        out = unary.copy()
        for (x, _), (to_b, to_a) in zip(links, messages):
            np.add.at(out, x[:, 1], to_b)
            np.add.at(out, x[:, 0], to_a)
        return out

    def passed(out: np.ndarray, weight: np.ndarray) -> np.ndarray:
        new = np.stack([np.logaddexp.reduce(out + weight[:, j], axis=1) for j in range(k)], axis=1)
        return new - new.max(axis=1, keepdims=True)

    for _ in range(ROUNDS if links else 0):
        belief, made = total(), []
        for (x, w), (to_b, to_a) in zip(links, messages):
            made.append((DAMPING * to_b + (1 - DAMPING) * passed(belief[x[:, 0]] - to_a, w), DAMPING * to_a + (1 - DAMPING) * passed(belief[x[:, 1]] - to_b, w.T)))
        messages = made
    p = total()
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


_FIELDS = {"a": "int", "b": "int", "label": "int", "shape": "string", "left": "string", "right": "string", "same": "string", "like": "string"}
_NODE = f"array<struct<{','.join(f'{x}:{t}' for x, t in _FIELDS.items())}>>"
_NODES = pa.list_(pa.struct([(x, pa.int32() if t == "int" else pa.string()) for x, t in _FIELDS.items()]))


def _finding(batches):
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        base, nodes = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            text = data[lo:hi].tobytes().decode("utf-8", "replace")
            base.append(base_spans(text))
            nodes.append(nodes_of(text, base[-1]))
        counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array([join_spans(s, KINDS) for s in base], pa.string()), pa.array(nodes, _NODES)], names=["id", *(f"n_{k}" for k in KINDS), "base", "nodes"])


#: What a training case consists of: how the node is written and what is beside it, labels before and after it (-1: no
#: node), how many equal and similar nodes of each label it is linked with (two of each at most), its own label.
CASE = ["shape", "left", "right", "before", "after", "same", "like", "label"]


def cases_of(nodes: list[dict]):
    """The training case of each node of a text."""
    links = links_of(nodes)
    labels = [x["label"] for x in nodes]
    met = {kind: [[0] * (len(KINDS) + 1) for _ in nodes] for kind in ("same", "like")}
    for kind, table in met.items():
        for i, j in links[kind].tolist():
            table[i][labels[j]] += 1
            table[j][labels[i]] += 1
    for i, x in enumerate(nodes):
        digits = ("".join(map(str, met[kind][i])) for kind in ("same", "like"))
        yield x["shape"], x["left"], x["right"], labels[i - 1] if i else -1, labels[i + 1] if i + 1 < len(nodes) else -1, *digits, x["label"]


def _counting(batches):
    tally: Counter = Counter()
    for batch in batches:
        for nodes in batch.column("nodes").to_pylist():
            tally.update(cases_of(nodes))
    columns = list(zip(*tally)) if tally else [[]] * len(CASE)
    kinds = [pa.int32() if x in ("before", "after", "label") else pa.string() for x in CASE]
    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(list(tally.values()), pa.int64())], names=[*CASE, "n"])


class Weights:
    """Weights of the field, fitted to cases (see ``CASE``) with their numbers n by gradient ascent of the pseudo-likelihood."""

    def __init__(self, cases: list[tuple]) -> None:
        k = len(KINDS) + 1
        self.unary: dict[str, dict[str, np.ndarray]] = {}
        at, tables = [], []
        for f, name in enumerate(("shape", "left", "right")):
            values = sorted({c[f] for c in cases})
            place = {v: i for i, v in enumerate(values)}
            at.append(np.array([place[c[f]] for c in cases], np.int64))
            tables.append(np.zeros((len(values), k)))
            self.unary[name] = {v: tables[-1][i] for i, v in enumerate(values)}
        before, after = (np.array([c[f] for c in cases], np.int64) for f in (3, 4))
        same, like = (np.array([list(map(int, c[f])) for c in cases], float).reshape(-1, k) for f in (5, 6))
        label, n = (np.array([c[f] for c in cases], np.int64) for f in (7, 8))
        # one-hot labels of the neighbours, nothing where there is none
        first, second = ((np.arange(k) == x[:, None]).astype(float) for x in (before, after))
        prior = {"chain": np.zeros((k, k)), **{x: w * np.eye(k) for x, w in AGREE.items()}}
        self.pair = {x: p.copy() for x, p in prior.items()}
        weight = n / max(1, n.sum()) if len(cases) else n
        seen = max(1, int(n.sum()) if len(cases) else 1)
        target = np.arange(k) == label[:, None]
        params = [*tables, self.pair["chain"], self.pair["same"], self.pair["like"]]
        tables[0][:, 0] = NONE
        means = [*(t.copy() for t in tables), prior["chain"], prior["same"], prior["like"]]
        moved = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, (STEPS if len(cases) else 0) + 1):
            logits = sum((t[i] for t, i in zip(tables, at)), np.zeros((len(cases), k)))
            logits = logits + first @ self.pair["chain"] + second @ self.pair["chain"].T + same @ self.pair["same"] + like @ self.pair["like"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = weight[:, None] * (target - p / p.sum(axis=1, keepdims=True))
            grads = []
            for t, i in zip(tables, at):
                g = np.zeros_like(t)
                np.add.at(g, i, error)
                grads.append(g)
            grads.append(first.T @ error + error.T @ second)
            for x in (same, like):
                g = x.T @ error
                grads.append((g + g.T) / 2)
            for q, g, m, (one, two) in zip(params, grads, means, moved):
                g = g - PRIOR / seen * (q - m)
                one += 0.1 * (g - one)
                two += 0.01 * (g * g - two)
                q += 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-9)

    def of(self, node: dict) -> np.ndarray:
        """Scores of a node's labels by itself."""
        unseen = NONE * (np.arange(len(KINDS) + 1) == 0) * (node["shape"] not in self.unary["shape"])
        return unseen + sum((self.unary[name].get(node[name], np.zeros(len(KINDS) + 1)) for name in ("shape", "left", "right")), np.zeros(len(KINDS) + 1))


def label_nodes(nodes: list[dict], weights: Weights) -> np.ndarray:
    """The most likely label of each node; base nodes keep theirs."""
    labels = np.array([x["label"] for x in nodes], np.int64)
    unary = np.stack([weights.of(x) for x in nodes])
    known = labels > 0
    unary[known] = -60.0
    unary[known, labels[known]] = 0.0
    belief = marginals(unary, [(pairs, weights.pair[kind]) for kind, pairs in links_of(nodes).items()])
    return np.where(known, labels, np.where(belief.max(axis=1) > 0.5, belief.argmax(axis=1), 0))


def _labelling(model):
    def run(batches):
        weights = model.value
        for batch in batches:
            base, spans = batch.column("base").to_pylist(), []
            for text, nodes in zip(base, batch.column("nodes").to_pylist()):
                if all(x["label"] for x in nodes):
                    spans.append(text)
                else:
                    spans.append(join_spans([(x["a"], int(k) - 1, x["b"]) for x, k in zip(nodes, label_nodes(nodes, weights)) if k], KINDS))
            keep = [x for x in batch.schema.names if x != "nodes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(spans, pa.string())], names=[*keep, "spans"])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base matches), base, spans (base and added ones).

    Null text counts as empty; repeated rows come out repeated; other columns are ignored; offsets are code points. Base
    matches of different kinds may overlap, added spans overlap none. A candidate as likely as not stays out. Texts are
    taken whole; memory grows with the nodes of the longest one. An empty table gives an empty result. The cases that train the field cover every
    row; they are a few hundred however large the corpus.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = Workspace(spark, "pii").table(rows.mapInArrow(lean(_finding), f"id {kind}, {counts}, base string, nodes {_NODE}"))
    tally = found.filter(F.size("nodes") > 0).select("nodes").mapInArrow(lean(_counting), "shape string, left string, right string, before int, after int, same string, like string, label int, n long")
    cases = sorted(tuple(r) for r in tally.groupBy(*CASE).agg(F.sum("n").alias("n")).collect())
    weights = Weights(cases)
    out = found.mapInArrow(lean(_labelling(broadcast(spark, weights))), f"id {kind}, {counts}, base string, spans string")
    return out.withColumnRenamed("id", id_col)


def op5_find_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
