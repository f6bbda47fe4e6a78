"""Regular expressions compiled together into one minimal deterministic automaton over bytes.

Syntax: literals, ``[...]`` classes with ranges and ``^``, ``.`` (any byte but newline), groups, ``|``, ``?``, ``*``,
``+``, ``{m}``, ``{m,}``, ``{m,n}``, and escapes ``\\xHH``, ``\\n``, ``\\t``, ``\\r``, ``\\`` + punctuation.
"""

from __future__ import annotations

import re

import numpy as np


class _Parser:
    """Recursive descent; a node is (kind, ...) with byte sets at the leaves."""

    def __init__(self, pattern: str) -> None:
        self.s, self.i = pattern, 0

    def parse(self):
        node = self.either()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return node

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                m = re.compile(r"\{(\d+)(,(\d*))?\}").match(self.s, self.i)
                if not m:
                    raise ValueError(f"bad repeat in {self.s!r}")
                low, high = int(m[1]), int(m[1]) if m[2] is None else int(m[3]) if m[3] else None
                self.i = m.end()
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                self.i += 1
            node = ("rep", node, low, high)
        return node

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            if self.s.startswith("?:", self.i):
                self.i += 2
            node = self.either()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            negated = self.peek() == "^"
            self.i += negated
            found: set[int] = set()
            first = True
            while first or self.peek() != "]":
                first = False
                low = self.byte()
                if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] != "]":
                    self.i += 1
                    found |= set(range(low, self.byte() + 1))
                else:
                    found.add(low)
            self.i += 1
            return ("set", frozenset(range(256)) - found if negated else frozenset(found))
        if c == ".":
            self.i += 1
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset([self.byte()]))


def _backwards(node):
    """The node of the same strings read from the end."""
    if node[0] == "cat":
        return ("cat", [_backwards(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_backwards(x) for x in node[1]])
    return node if node[0] == "set" else ("rep", _backwards(node[1]), *node[2:])


class Automaton:
    """All rules as one table, by subset construction and minimisation.

    ``step[state * classes + byte_class[byte]]`` is the next state (0: start) and ``accepts[state]`` has bit r set when
    a match of rule r ends there. Matches begin anywhere, or with ``anchored`` at the first byte only; with ``backwards``
    texts are read from the end, so that a match "ends" where it begins. ``resets`` marks bytes that lead every state to
    the start: texts can be cut there.
    """

    def __init__(self, rules: list[str], anchored: bool = False, backwards: bool = False) -> None:
        self._edges: list[list[tuple[frozenset, int]]] = []
        self._empty: list[list[int]] = []
        start, ends = self._state(), {}
        for r, pattern in enumerate(rules):
            node = _Parser(pattern).parse()
            enter, leave = self._build(_backwards(node) if backwards else node)
            self._empty[start].append(enter)
            ends[leave] = r
        self._determinise(start, ends, anchored)
        self._minimise()
        del self._edges, self._empty
        after = self.step.reshape(-1, self.classes)
        self.resets = (after == 0).all(axis=0)[self.byte_class]
        self.rows, self.ends = [row.tolist() for row in after], self.accepts.tolist()  # for steps taken one by one

    def _state(self) -> int:
        self._edges.append([])
        self._empty.append([])
        return len(self._edges) - 1

    def _build(self, node) -> tuple[int, int]:
        kind = node[0]
        if kind == "set":
            a, b = self._state(), self._state()
            self._edges[a].append((node[1], b))
            return a, b
        if kind == "cat":
            a = b = self._state()
            for part in node[1]:
                x, y = self._build(part)
                self._empty[b].append(x)
                b = y
            return a, b
        if kind == "or":
            a, b = self._state(), self._state()
            for part in node[1]:
                x, y = self._build(part)
                self._empty[a].append(x)
                self._empty[y].append(b)
            return a, b
        _, inner, low, high = node
        a = b = self._state()
        for _ in range(low):
            x, y = self._build(inner)
            self._empty[b].append(x)
            b = y
        if high is None:
            x, y = self._build(inner)
            loop = self._state()
            self._empty[b].append(loop)
            self._empty[loop].append(x)
            self._empty[y].append(loop)
            return a, loop
        end = self._state()
        self._empty[b].append(end)
        for _ in range(high - low):
            x, y = self._build(inner)
            self._empty[b].append(x)
            self._empty[y].append(end)
            b = y
        return a, end

    def _closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self._empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _determinise(self, start: int, ends: dict[int, int], anchored: bool) -> None:
        sets = {s for edges in self._edges for s, _ in edges}
        signs = [tuple(b in s for s in sets) for b in range(256)]
        numbers: dict[tuple, int] = {}
        self.byte_class = np.array([numbers.setdefault(x, len(numbers)) for x in signs], np.int32)
        sample = [signs.index(x) for x in numbers]
        self.classes = len(sample)
        initial = self._closed([start])
        known, todo, table, accepts = {initial: 0}, [initial], [], []
        closure = {s: self._closed([s]) for s in range(len(self._edges))}
        while todo:
            now = todo.pop(0)
            accepts.append(sum(1 << r for leave, r in ends.items() if leave in now))
            row = []
            for b in sample:
                then = frozenset().union(() if anchored else initial, *(closure[t] for s in now for on, t in self._edges[s] if b in on))
                if then not in known:
                    known[then] = len(known)
                    todo.append(then)
                row.append(known[then])
            table.append(row)
        self._table, self._accepts = np.array(table, np.int64), np.array(accepts, np.int64)

    def _minimise(self) -> None:
        """Moore's refinement: states stay together while they accept alike and step to the same blocks."""
        _, block = np.unique(self._accepts, return_inverse=True)
        while True:
            keys = np.concatenate([block[:, None], block[self._table]], axis=1)
            _, finer = np.unique(keys, axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        order = np.full(block.max() + 1, -1, np.int64)  # blocks numbered as met, the start's first
        order[block[0]] = 0
        rest = [b for b in range(len(order)) if b != block[0]]
        order[rest] = np.arange(1, len(order))
        head = np.zeros(len(order), np.int64)
        head[order[block[::-1]]] = np.arange(len(block))[::-1]
        self.step = order[block[self._table[head]]].astype(np.int32).reshape(-1)
        self.accepts = self._accepts[head].astype(np.uint8 if self._accepts.max(initial=0) < 256 else np.int64)
        del self._table, self._accepts

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, few: int = 48) -> np.ndarray:
        """For each byte of the segments data[starts[i]:ends[i]] the rules of which a match ends with it, as bits.

        All segments advance together, a byte a step; the last few, long ones go one by one.
        """
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        at, left = starts[order], length[order]
        state, found = np.zeros(len(order), np.int32), np.zeros(len(data), self.accepts.dtype)
        symbols, classes = self.byte_class[data], np.int32(self.classes)
        alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")  # segments of at least t + 1 bytes
        t = 0
        for t, m in enumerate(alive.tolist()):
            if m < few:
                break
            here = at[:m] + t
            now = self.step[state[:m] * classes + symbols[here]]
            state[:m] = now
            found[here] = self.accepts[now]
        else:
            t = len(alive)
        if t < len(alive):
            for i in range(int(alive[t])):
                s, first = int(state[i]), at[i] + t
                bits = []
                for c in symbols[first : at[i] + left[i]].tolist():
                    s = self.rows[s][c]
                    bits.append(self.ends[s])
                found[first : at[i] + left[i]] = bits
        return found


class Spans:
    """The matches of one rule in a short text, by two automata: where matches begin, and how far one reaches."""

    def __init__(self, rule: str) -> None:
        self.begin, self.reach = Automaton([rule], backwards=True), Automaton([rule], anchored=True)
        dead = np.flatnonzero((self.reach.step.reshape(-1, self.reach.classes) == np.arange(len(self.reach.ends))[:, None]).all(axis=1) & (self.reach.accepts == 0))
        self.dead = int(dead[0]) if len(dead) else -1

    def __call__(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the leftmost longest matches that don't overlap, in time linear in the text."""
        rows, ends, s, begins = self.begin.rows, self.begin.ends, 0, []
        for i, c in enumerate(self.begin.byte_class[data[::-1]].tolist()):
            s = rows[s][c]
            if ends[s]:
                begins.append(len(data) - 1 - i)
        rows, ends, symbols, out, done = self.reach.rows, self.reach.ends, self.reach.byte_class[data].tolist(), [], 0
        for a in reversed(begins):
            if a < done:
                continue
            s, i = 0, a
            while i < len(symbols) and s != self.dead:
                s = rows[s][symbols[i]]
                i += 1
                if ends[s]:
                    done = i
            out.append((a, done))
        return out
