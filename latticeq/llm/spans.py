"""Spans as text: ``kind:start:end`` by start, then kind as listed, comma-joined; code points, end exclusive."""

from __future__ import annotations



def join_spans(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """spans: (start, number of the kind, end)."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


