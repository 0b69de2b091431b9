"""An FM-index over the words of a shard: wavelet-tree ranks for backward search, sampled positions for locating."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of an integer sequence: names of prefixes of doubling length, only undecided suffixes sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.append(True, symbols[order][1:] != symbols[order][:-1])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, sizes)  # a suffix is named by the first place of its group
    rank[n] = -1
    open_ = order[np.repeat(sizes > 1, sizes)]
    width = 1
    while len(open_):
        key = rank[open_] * np.int64(n + 2) + rank[np.minimum(open_ + width, n)] + 1
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        group = rank[open_]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        parts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(parts, len(open_)))
        begin = np.repeat(starts, np.diff(np.append(starts, len(open_))))
        rank[open_] = group + np.repeat(parts, sizes) - begin
        open_ = open_[np.repeat(sizes > 1, sizes)]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class Bits:
    """A bit vector with rank: counts before each 64-bit block and a population count inside it."""

    def __init__(self, packed: np.ndarray, size: int):
        padded = np.zeros((size // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.blocks = padded.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little")


@dataclass
class FmIndex:
    """``words`` in order of their symbols 1, 2, ...; symbol 0 ends each text.  ``starts`` are the texts' first positions."""

    words: list[bytes]
    starts: np.ndarray
    size: int
    levels: list[np.ndarray]
    counts: np.ndarray
    marked: np.ndarray
    samples: np.ndarray

    @classmethod
    def build(cls, texts: Sequence[Sequence[bytes]]) -> FmIndex:
        ids: dict[bytes, int] = {}
        parts, starts, at = [], [], 0
        for words in texts:
            starts.append(at)
            parts.append(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
            at += len(words) + 1
        plain = np.concatenate(parts) if parts else np.empty(0, np.int64)
        ends = np.flatnonzero(plain == 0)
        ranked = plain + len(ends)
        ranked[ends] = np.arange(len(ends))  # each end differs, so that no comparison runs over it
        order = suffix_order(ranked)
        bwt = plain[order - 1]
        begins = np.array(starts, np.int64)
        is_begin = np.zeros(len(plain), bool)
        is_begin[begins] = True
        marked = (order % SAMPLE == 0) | is_begin[order]
        levels = []
        left = bwt
        for level in reversed(range(len(ids).bit_length())):
            bits = (left >> level & 1).astype(bool)
            levels.append(packed(bits))
            left = np.concatenate([left[~bits], left[bits]])
        counts = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=len(ids) + 1))])
        return cls(list(ids), begins, len(plain), levels, counts, packed(marked), order[marked].astype(np.int32))

    def parts(self) -> dict[str, bytes | int]:
        """The index as columns of a table."""
        return {
            "size": self.size, "words": b" ".join(self.words), "starts": self.starts.astype("<i4").tobytes(), "levels": b"".join(x.tobytes() for x in self.levels),
            "counts": self.counts.astype("<i4").tobytes(), "marked": self.marked.tobytes(), "samples": self.samples.astype("<i4").tobytes(),
        }

    @classmethod
    def load(cls, p: dict) -> FmIndex:
        words = p["words"].split()
        bits = np.frombuffer(p["levels"], np.uint8)
        deep = len(words).bit_length()
        each = len(bits) // deep if deep else 0
        return cls(
            words, np.frombuffer(p["starts"], "<i4").astype(np.int64), p["size"], [bits[i * each : (i + 1) * each] for i in range(deep)],
            np.frombuffer(p["counts"], "<i4").astype(np.int64), np.frombuffer(p["marked"], np.uint8), np.frombuffer(p["samples"], "<i4").astype(np.int64),
        )

    def ready(self) -> FmSearch:
        return FmSearch(self)


class FmSearch:
    """Searches many phrases at once, step by step over arrays."""

    def __init__(self, index: FmIndex):
        self.index = index
        self.levels = [Bits(x, index.size) for x in index.levels]
        self.zeros = [index.size - b.ones for b in self.levels]
        self.marked = Bits(index.marked, index.size)
        self.ids = {w: i for i, w in enumerate(index.words, 1)}

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the transform."""
        low = np.zeros_like(at)
        for i, bits in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - i) & 1).astype(bool)
            a, b = bits.rank(at), bits.rank(low)
            at = np.where(one, self.zeros[i] + a, at - a)
            low = np.where(one, self.zeros[i] + b, low - b)
        return at - low

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier."""
        at, low, symbol = row, np.zeros_like(row), np.zeros_like(row)
        for i, bits in enumerate(self.levels):
            one = bits.get(at)
            symbol = symbol * 2 + one
            a, b = bits.rank(at), bits.rank(low)
            at = np.where(one, self.zeros[i] + a, at - a)
            low = np.where(one, self.zeros[i] + b, low - b)
        return self.index.counts[symbol] + at - low

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase, a row of symbols; -1 is a word that the shard lacks."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        live = np.flatnonzero((phrases > 0).all(axis=1))
        high[live] = self.index.size
        for j in reversed(range(phrases.shape[1])):
            c = phrases[live, j]
            base = self.index.counts[c]
            lo, hi = base + self.rank(c, low[live]), base + self.rank(c, high[live])
            low[live], high[live] = lo, hi
            live = live[lo < hi]
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: walk back to a sampled one."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            hit = self.marked.get(rows)
            out[todo[hit]] = self.index.samples[self.marked.rank(rows[hit])] + steps
            todo, rows = todo[~hit], self.back(rows[~hit])
            steps += 1
        return out
