"""Secret scan: all rules as one deterministic automaton, run once over every byte.

Texts are cut at bytes that reset the automaton, and all segments are scanned in lock-step. The automaton says of each
byte which rules have a match that ends with it. Every rule ends in a class that repeats, so that a match of the least
length leaves a run of such bytes behind it; in the few segments with a run that is long enough, the rule's own pair of
automata gives the spans: the leftmost start, and the longest match from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeq.llm.automaton import Automaton, Spans
from latticeq.llm.shared import broadcast, lean
from latticeq.llm.spans import join_spans
from latticeq.llm.tokens import pieces, text_buffer


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# fixed values: (kind, expression, least number of characters in its last repeated class); the first three are the base
RULES = [
    ("assign", either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]+", 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 10),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
]
KINDS, BASE = [r[0] for r in RULES], 3


def long_enough(kind: int, match: bytes) -> bool:
    """Whether the last class of a match (in assign: the value) has the characters that it needs."""
    name, _, least = RULES[kind]
    if name == "assign":
        value = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'")) >= least
    before = {"access": 4, "github": 4, "slack": 5}.get(name, 0)
    return min(len(p) for p in match.split(b".")) >= least if name == "jwt" else len(match) - before >= least


class Scanner:
    """The automaton of all rules and the span finders of each."""

    def __init__(self) -> None:
        self.all, self.spans = Automaton([r[1] for r in RULES]), [Spans(r[1]) for r in RULES]

    def candidates(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(segment, kind) where a run of bytes that end a match is as long as the rule needs."""
        bits = self.all.scan(data, starts, ends)
        for kind, (_, _, least) in enumerate(RULES):
            at = np.flatnonzero(bits & (1 << kind))
            if not len(at):
                continue
            segment = np.searchsorted(starts, at, side="right") - 1
            new = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(segment, prepend=-1) > 0))
            run = np.diff(np.append(new, len(at)))
            yield from ((int(i), kind) for i in np.unique(segment[new[run >= least]]))

    def find(self, data: np.ndarray, at: np.ndarray):
        """(text, start, kind, end) of the matches in texts data[at[i]:at[i+1]], in bytes of their text."""
        base, part = at[0], data[at[0] : at[-1]]
        at = at - base
        starts = np.unique(np.concatenate([at[:-1], np.flatnonzero(self.all.resets[part]) + 1]))
        starts = starts[starts < len(part)]
        ends = np.append(starts[1:], len(part))
        for i, kind in self.candidates(part, starts, ends):
            text = int(np.searchsorted(at, starts[i], side="right")) - 1
            segment = part[starts[i] : ends[i]]
            for a, b in self.spans[kind](segment):
                if long_enough(kind, segment[a:b].tobytes()):
                    shift = int(starts[i] - at[text])
                    yield text, a + shift, kind, b + shift


def _scanning(scanner):
    def run(batches):
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            found: list[list] = [[] for _ in range(len(at) - 1)]
            for lo, hi in pieces(at, 4 << 20):
                for text, a, kind, b in scanner.value.find(data, at[lo : hi + 1]):
                    found[lo + text].append((a, kind, b))
            for i, spans in enumerate(found):
                if spans:  # from bytes to code points
                    points = np.concatenate([[0], np.cumsum((data[at[i] : at[i + 1]] & 0xC0) != 0x80)])
                    found[i] = [(int(points[a]), kind, int(points[b])) for a, kind, b in spans]
            base_spans = [[s for s in spans if s[1] < BASE] for spans in found]
            columns = [pa.array([sum(s[1] == k for s in spans) for spans in base_spans], pa.int64()) for k in range(BASE)]
            keep = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), *columns, pa.array([join_spans(s, KINDS) for s in base_spans], pa.string()), pa.array([join_spans(s, KINDS) for s in found], pa.string())],
                names=[*keep, *(f"n_{k}" for k in KINDS[:BASE]), "base", "spans"],
            )

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base, spans.

    ``base`` joins the spans of the three base kinds, ``spans`` all of them (further kinds: github, slack, jwt, pem). Of
    one kind the leftmost match wins, of those with its start the longest; matches of different kinds may overlap. Null
    text counts as empty; repeated rows come out repeated; an empty table gives an empty result; other columns are
    ignored; offsets are code points. A text of any length is scanned in time linear in it.
    """
    scanner = broadcast(docs.sparkSession, Scanner())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(lean(_scanning(scanner)), f"id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")
    return out.withColumnRenamed("id", id_col)


def op6_find_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
