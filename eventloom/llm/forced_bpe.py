"""Byte pair encoding with forced boundaries, and its decoding.

A pair of neighbouring symbols that stands inside no vocabulary token can never be merged across, so each such pair
is a certain cut.  Words are cut there, the fragments are encoded on their own and the ids concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

from eventloom.llm.common import map_texts

#: Unicode white space, as the tokenizer's pattern has it.
BLANK = r"\t-\r\x20\x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"
NEVER = 1 << 60
#: Symbols of a fragment from which on a heap finds the next merge.
LONG = 64


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Generations:
    """A bounded memo: entries in use move to the young half, the old half is let go when the young one is full."""

    def __init__(self, make: Callable[[Any], Any], size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __call__(self, key: Any) -> Any:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got


class ForcedBpe:
    """Encoder and decoder for a vocabulary file with word-end suffix: NFC, lower case, words, byte symbols, merges."""

    def __init__(self, path: str, memo: int = 100_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.symbols = byte_symbols()
        self.inner = [self.vocab.get(s, -1) for s in self.symbols]
        self.final = [self.vocab.get(s + self.suffix, -1) for s in self.symbols]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = self.vocab[left], self.vocab[right]
            self.rank.setdefault(a << 20 | b, len(self.merged))
            self.merged.append(self.vocab[left + right])
        self.joinable = self.pairs_inside()
        self.words = regex.compile(WORDS)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.fragment = Generations(self.merge, memo)
        self.piece = Generations(self.encode_piece, memo)

    def pairs_inside(self) -> frozenset[int]:
        """Neighbouring symbols, a word's last byte counting as another symbol, that occur inside some token."""
        index = {s: i for i, s in enumerate(self.symbols)}
        found = set()
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if ends else token
            ids = [self.inner[index[c]] if c in index else -1 for c in body]
            if ends and body and body[-1] in index:
                ids[-1] = self.final[index[body[-1]]]
            found.update(a << 20 | b for a, b in zip(ids, ids[1:], strict=False) if a >= 0 and b >= 0)
        return frozenset(found)

    def fragments(self, data: bytes) -> Iterable[tuple[int, ...]]:
        """Symbol ids of a word, cut at every pair that no token holds."""
        inner, joinable = self.inner, self.joinable
        ids = [i for i in (*[inner[b] for b in data[:-1]], self.final[data[-1]]) if i >= 0]
        start = 0
        for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False), 1):
            if a << 20 | b not in joinable:
                yield tuple(ids[start:k])
                start = k
        if ids:
            yield tuple(ids[start:])

    def merge(self, fragment: tuple[int, ...]) -> tuple[int, ...]:
        """Merge the leftmost pair of the lowest rank until none is left."""
        if len(fragment) > LONG:
            return self.merge_long(fragment)
        rank = self.rank.get
        ids = list(fragment)
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            ids[at] = self.merged[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 20 | ids[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 20 | ids[at + 1], NEVER)
        return tuple(ids)

    def merge_long(self, fragment: tuple[int, ...]) -> tuple[int, ...]:
        """The same merges for a long fragment: a heap of (rank, place) over a linked list of symbols."""
        rank, n = self.rank.get, len(fragment)
        ids, after, before = list(fragment), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(a << 20 | b, NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, at = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right >= n or rank(ids[at] << 20 | ids[right], NEVER) != r:
                continue  # one of the two has been merged since
            ids[at], ids[right] = self.merged[r], -1
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                if (r := rank(ids[at] << 20 | ids[right], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, at))
            if (left := before[at]) >= 0 and (r := rank(ids[left] << 20 | ids[at], NEVER)) != NEVER:
                heapq.heappush(heap, (r, left))
        return tuple([i for i in ids if i >= 0])

    def encode_piece(self, piece: str) -> tuple[str, int, str, tuple[int, ...]]:
        parts = list(self.fragments(piece.encode("utf-8", "surrogatepass")))
        # a word without a cut is kept in the words' memo only
        ids = self.merge(parts[0]) if len(parts) == 1 else tuple([i for part in parts for i in self.fragment(part)])
        return " ".join(map(str, ids)), len(ids), self.decode(ids), ids

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a capital sigma has one small form, wherever it stands
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def forget(self) -> None:
        for memo in (self.fragment, self.piece):
            memo.young, memo.old = {}, {}

    def plain(self, text: str) -> list[tuple[str, int, str, tuple[int, ...]]]:
        young, piece = self.piece.young, self.piece
        return [young[w] if w in young else piece(w) for w in self.words.findall(self.normal(text))]

    def pieces(self, text: str) -> list[tuple[str, int, str, tuple[int, ...]]]:
        """What is kept of each word: ids as text, their number, the decoded text, ids; added tokens stand for themselves."""
        if not self.special or not any(t in text for t in self.added):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            i = self.added[m.group()]
            out += [*self.plain(text[at : m.start()]), (str(i), 1, m.group(), (i,))]
            at = m.end()
        return out + self.plain(text[at:])

    def encode(self, text: str) -> list[int]:
        return [i for *_, ids in self.pieces(text) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks, as a vocabulary file without a decoder has it."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


ENCODERS: dict[tuple[str, int], ForcedBpe] = {}


def encoder(path: str, memo: int = 100_000) -> ForcedBpe:
    """One encoder for each worker process, file and size of the memo; its memo is emptied at the end of a task."""
    if (path, memo) not in ENCODERS:
        ENCODERS[path, memo] = ForcedBpe(path, memo)
    return ENCODERS[path, memo]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Words in a half of the memo where ids are kept whole; the frequent ones stay in it, the results do not depend on it.
SMALL_MEMO = 20_000


def encode_documents(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", memo: int = SMALL_MEMO) -> DataFrame:
    """Token ids of every whole text and the text decoded from them: columns ``ids`` (array of int) and ``decoded``.

    ``path`` is the vocabulary file, readable on every worker.  Null and empty texts have no ids and decode to the
    empty text.  Rows are encoded alone: repeated rows repeat, an empty table gives no rows, other columns are not
    read.
    """

    def start():
        bpe = encoder(path, memo)

        def one(value: str | None) -> tuple:
            parts = [p for p in bpe.pieces(value or "") if p[1]]
            return [i for p in parts for i in p[3]], " ".join([p[2] for p in parts])

        one.forget = bpe.forget
        return one

    return map_texts(documents, [doc_id], text, "ids array<int>, decoded string", start)


def digest_documents(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of what :func:`encode_documents` gives, digested in the task that made it."""

    def start():
        bpe = encoder(path)

        def one(value: str | None) -> tuple:
            parts = [p for p in bpe.pieces(value or "") if p[1]]
            ids, decoded = " ".join([p[0] for p in parts]), " ".join([p[2] for p in parts])
            return sum(p[1] for p in parts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        one.forget = bpe.forget
        return one

    return map_texts(documents, [doc_id], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", start)
