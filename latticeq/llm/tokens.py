"""Vectorised tokenising and hashing of Arrow text columns.

Texts stay one byte buffer with offsets. A word's hash is a polynomial over a random 64-bit value for each byte,
modulo 2**64, made by one multiplication and one segmented sum over the buffer, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words (space, tab to carriage return), and bytes of text handled at a time (a longer document: alone).
SPACES, PIECE = b"\x20\x09\x0a\x0b\x0c\x0d", 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"at": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["at"]) < n:
        for name, base in (("at", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["at"], _powers["inverse"]


class Tokenizer:
    """Words between separator bytes, A-Z lower-cased; further bytes can count as separators."""

    def __init__(self, separators: bytes = SPACES) -> None:
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        self.value = np.where(self.word, _RANDOM[_LOWER], 0).astype(np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For documents data[offsets[i]:offsets[i+1]]: word hashes, where words start, first word of each document."""
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        inside = self.word[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        start[first] = inside[first]
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.empty(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
        up, down = _power(len(data))
        sums = np.add.reduceat(self.value[data] * up[: len(data)], starts)
        return mix(sums * down[starts]), starts, np.searchsorted(starts, offsets)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by its first word (fewer words: none)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mix(total + np.uint64(width))


class HashIndex:
    """Positions of 64-bit keys, looked up many at a time (open addressing)."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint64)
        mask = (1 << self.bits) - 1
        left, r = np.arange(len(keys)), 0
        home = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            at = home[left] + r & mask
            free = self.slot[at] < 0
            _, first = np.unique(at, return_index=True)
            win = np.zeros(len(left), bool)
            win[first] = True
            win &= free
            self.slot[at[win]] = left[win]
            self.key[at[win]] = keys[left[win]]
            left, r = left[~win], r + 1
        self.reach = r

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if absent."""
        mask = (1 << self.bits) - 1
        home = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slot[home]
        out = np.where((got >= 0) & (self.key[home] == keys), got, -1)
        left = np.flatnonzero((got >= 0) & (out < 0))
        for r in range(1, self.reach):
            if not len(left):
                break
            at = home[left] + r & mask
            got = self.slot[at]
            hit = (got >= 0) & (self.key[at] == keys[left])
            out[left[hit]] = got[hit]
            left = left[(got >= 0) & ~hit]
        return out
