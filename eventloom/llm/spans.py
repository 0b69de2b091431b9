"""Spans as text: kind:start:end, comma-joined, in order of start and then of kind."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

Span = tuple[int, int, str]


def joined(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))
