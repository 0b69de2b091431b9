"""Quality rules by compression: a text whose zstandard ratio leaves the band of its length is repetitive or incompressible."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from eventloom.llm.common import map_texts

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least ``least`` bytes; None: no limit on that side."""

    least: int
    low: float | None
    high: float | None


#: Natural prose at zstandard level 3: short texts hardly compress, long ones reach 0.3 to 0.5.  Texts under 96 bytes are
#: often stored as they are, 9 to 13 bytes longer, whatever they hold: their upper limit is that of a single byte.
BANDS = (Band(0, 0.35, 14.0), Band(96, 0.35, 1.05), Band(128, 0.35, 1.0), Band(256, 0.35, 0.95), Band(512, 0.33, 0.95), Band(2048, 0.30, 0.85), Band(8192, 0.25, 0.75))
#: Limits for one chunk of CHUNK bytes, and the share of a text's chunks outside them that rejects it.
CHUNK, CHUNK_SHARE = 4096, 0.25
CHUNK_BAND = Band(CHUNK, 0.20, 0.80)


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` (a power of two) words that occur at least twice in the text, every occurrence included."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    span = 1
    while span < size:
        # names of windows twice as long; exact, as a pair of names is one number
        pairs = codes[:-span] * np.int64(len(codes) + 1) + codes[span:]
        values, codes = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        span *= 2
    hot = np.bincount(codes)[codes] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[: len(hot)] += hot
    edges[size : size + len(hot)] -= hot
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0
    solid = data.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), dup, repeated_window_words(words)


def band_of(size: int, bands: Sequence[Band]) -> Band:
    return [b for b in bands if b.least <= size][-1]


def outside(ratio: float, band: Band) -> bool:
    return (band.low is not None and ratio < band.low) or (band.high is not None and ratio > band.high)


def compression_bands(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: Sequence[Band] = BANDS, chunk: int = CHUNK,
    chunk_band: Band = CHUNK_BAND, chunk_share: float = CHUNK_SHARE, level: int = 3, min_words: int = 20, repeat_percent: int = 30,
) -> DataFrame:
    """Base counts, zstandard ratios and the verdict for every whole text.

    ``ratio`` is the compressed size over the size in bytes (1.0 for an empty text), ``bad_chunks`` counts chunks
    outside ``chunk_band`` among ``n_chunks``; the rest after the whole chunks is one more, judged as the last ``chunk``
    bytes, or alone by the band of its length where it follows a bad chunk or none.  A text is kept if it passes the base rules, its ratio is
    inside its length's band and fewer than ``chunk_share`` of its chunks are bad.  Null and empty texts have no
    words and fail the base rules.  Rows are judged alone, so repeated rows give repeated results, an empty table
    gives no rows, and other columns of the input, whatever their names, are not read.
    """

    def start():
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)

        def one(value: str | None) -> tuple:
            words, chars, symbols, dup, repeat = base_counts(value)
            failed = words < min_words or 100 * repeat > repeat_percent * words
            data = (value or "").encode("utf-8", "surrogatepass")
            ratio = len(packer.compress(data)) / len(data) if data else 1.0
            chunks = -(-len(data) // chunk)
            bad, last = 0, False
            for at in range(0, len(data) - chunk + 1, chunk):
                last = outside(len(packer.compress(data[at : at + chunk])) / chunk, chunk_band)
                bad += last
            tail = data[len(data) // chunk * chunk :]
            if tail and (last or len(data) < chunk):
                bad += outside(len(packer.compress(tail)) / len(tail), band_of(len(tail), bands))
            elif tail:
                bad += outside(len(packer.compress(data[-chunk:])) / chunk, chunk_band)
            kept = not failed and not outside(ratio, band_of(len(data), bands)) and not (bad and bad >= chunk_share * chunks)
            return words, chars, symbols, dup, repeat, failed, kept, ratio, chunks, bad

        return one

    made = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, ratio double, n_chunks long, bad_chunks long"
    )
    return map_texts(documents, [doc_id], text, made, start)
