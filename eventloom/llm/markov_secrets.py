"""Secret scans: fixed patterns, and a log-likelihood ratio of two character Markov models for other random-looking strings.

One model is trained on strings labelled random, the other on ordinary identifiers.  Random samples are drawn from
the alphabets in use for keys; identifiers are words of the corpus and their joins in the usual styles.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import freeing, map_texts, ship
from eventloom.llm.sampling import hashed_ids
from eventloom.llm.spans import Span, joined

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hexadecimal digits that is long enough; a run starts where no such digit stands before it.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Where a candidate is cut into pieces.
PIECE = re.compile(r"[^+/_-]+")
#: Characters that a secret of kind random has at least, and words of a training sample at most.
LEAST, MOST_WORDS = 16, 50_000

#: 26 letters folded to lower and upper case, digits and joiners, and one class for all else.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
CODES = np.full(128, STATES - 1, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Words that identifiers are often made of, beside those of the corpus.
COMMON_WORDS = (
    "access account action address admin agent alias array base batch block body bucket buffer build builder byte cache call check child class client code column command "
    "config connection content context control count create current cursor data database date default delete device document element encode engine entry error event "
    "example factory feature field file filter first folder format function global graph group handler hash header height history host image index info input instance "
    "interface internal item iterator kernel label language last layer layout length level library line link list load local location logger manager map mapper matrix "
    "member memory message method model module monitor name network node number object offset option order output owner package page parameter parent parse parser path "
    "pattern pointer policy pool position prefix print process product profile project property protocol provider proxy query queue random range reader record region "
    "register release remote render report repository request resource response result return root route router sample schedule schema scope search section select server "
    "service session setting shape signal size sort source stack start state static status storage store stream string structure style system table target task template "
    "test text thread time timer title tree type update user util value variable vector version view widget width window worker wrapper write writer"
).split()
KEY_ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)
UUID_CUTS = (8, 12, 16, 20)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, in code points."""
    spans: list[Span] = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def random_samples(count: int, seed: int = 7) -> list[str]:
    """Strings labelled random: uniform draws from each alphabet, 16 to 64 characters, and hexadecimal groups joined as in a UUID."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        kind = i % (len(KEY_ALPHABETS) + 1)
        if kind < len(KEY_ALPHABETS):
            out.append("".join(rng.choices(KEY_ALPHABETS[kind], k=rng.randint(16, 64))))
        else:
            digits = "".join(rng.choices(KEY_ALPHABETS[0], k=32))
            out.append("-".join(digits[a:b] for a, b in zip((0, *UUID_CUTS), (*UUID_CUTS, 32), strict=True)))
    return out


def identifier_samples(words: Sequence[str], count: int, seed: int = 7) -> list[str]:
    """Strings labelled ordinary: words, joins of two to four of them in the styles of code and addresses, and ruled lines."""
    rng = random.Random(seed)
    words = [*words, *COMMON_WORDS * (1 + len(words) // (4 * len(COMMON_WORDS)))]
    out = []
    for i in range(count):
        some = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        style = i % 7
        if style == 0:
            out.append(some[0])
        elif style == 1:
            out.append("_".join(some))
        elif style == 2:
            out.append("-".join(some) + rng.choice(["", "-2", "-v1", "-2024"]))
        elif style == 3:
            out.append("".join(w.capitalize() for w in some))
        elif style == 4:
            out.append("_".join(some).upper())
        elif style == 5:
            out.append("/".join(some))
        else:
            out.append(rng.choice("-_+/") * rng.randint(16, 64))
    return out


class MarkovModel:
    """First-order character model: log probabilities of a character after another, add-half smoothed."""

    def __init__(self, samples: Iterable[str]):
        counts = np.full((STATES + 1, STATES), 0.5)
        for s in samples:
            codes = encode(s)
            if len(codes):
                counts[STATES, codes[0]] += 1
                np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True))


def encode(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return CODES[np.minimum(raw, 127)]


class SecretModel:
    """Mean log-likelihood ratio per character, random against ordinary."""

    def __init__(self, random_strings: Iterable[str], identifiers: Iterable[str]):
        self.ratio = MarkovModel(random_strings).logs - MarkovModel(identifiers).logs

    def score(self, text: str) -> float:
        codes = encode(text)
        if not len(codes):
            return 0.0
        return float(self.ratio[STATES, codes[0]] + self.ratio[codes[:-1], codes[1:]].sum()) / len(codes)


def widest(starts: np.ndarray, ends: np.ndarray, before: np.ndarray, total: np.ndarray) -> tuple[int, int] | None:
    """The widest run of pieces (first and last) of at least LEAST characters whose mean ratio reaches the threshold.

    ``total`` at a piece's end, less ``before`` at a piece's start, is what the run between them has above the threshold.
    """
    highest = np.maximum.accumulate(total[::-1])[::-1]
    last = np.searchsorted(-highest, -before, side="right") - 1
    first = np.arange(len(starts))
    width = np.where(last >= first, ends[last] - starts, 0)
    best = int(width.argmax())
    return (best, int(last[best])) if width[best] >= LEAST else None


def method_spans(text: str, model: SecretModel, threshold: float) -> list[Span]:
    """Each candidate's widest runs of pieces that pass; ordinary words of four or more letters at their ends are left out."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        pieces = [p.span() for p in PIECE.finditer(run)]
        if not pieces:
            continue
        codes = encode(run)
        total = np.concatenate([[0.0, 0.0], np.cumsum(model.ratio[codes[:-1], codes[1:]] - threshold)])
        starts, ends = np.array(pieces).T
        before = total[starts + 1] - (model.ratio[STATES, codes[starts]] - threshold)
        after = total[ends]
        open_runs = [(0, len(pieces))]
        while open_runs:
            lo, hi = open_runs.pop()
            found = widest(starts[lo:hi], ends[lo:hi], before[lo:hi], after[lo:hi]) if lo < hi else None
            if found is None:
                continue
            a, b = lo + found[0], lo + found[1]
            open_runs += [(lo, a), (b + 1, hi)]

            def word(k: int) -> bool:
                piece = run[starts[k] : ends[k]]
                return len(piece) >= 4 and piece.isalpha() and model.score(piece) <= 0

            while a < b and word(a) and ends[b] - starts[a + 1] >= LEAST:
                a += 1
            while a < b and word(b) and ends[b - 1] - starts[a] >= LEAST:
                b -= 1
            out.append((m.start() + int(starts[a]), m.start() + int(ends[b]), "random"))
    return sorted(out)


def all_spans(text: str, model: SecretModel, threshold: float) -> list[Span]:
    """Base spans, and those of the method that overlap none of them."""
    base = base_spans(text)
    return base + [s for s in method_spans(text, model, threshold) if not any(s[0] < e and b < s[1] for b, e, _ in base)]


def sample_words(documents: DataFrame, doc_id: str, text: str, rows: int, most: int = MOST_WORDS) -> list[str]:
    """Letter-only words of documents with one of about ``rows`` sampled ids; at most ``most`` distinct words, the first by hash."""
    key = F.col(f"`{doc_id}`")
    ids = hashed_ids(documents.where(key.isNotNull()).select(key.alias("i")).distinct(), rows)
    first = documents.join(F.broadcast(ids), key == F.col("i"), "left_semi").select(F.col(f"`{text}`").cast("string").alias("t"))
    words = first.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\b[a-zA-Z]{3,24}\b"), F.lit(0)))).alias("w"))
    return [r.w for r in words.distinct().orderBy(F.md5("w"), "w").limit(most).collect()]


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 500, samples: int = 20_000, most_words: int = MOST_WORDS) -> SecretModel:
    """Models from ``samples`` strings of each label; the words come from ``sample_rows`` texts, at most ``most_words`` of them (bounded, repeatable samples)."""
    words = sample_words(documents, doc_id, text, sample_rows, most_words)
    return SecretModel(random_samples(samples), identifier_samples(words, samples))


def find_secrets(documents: DataFrame, model: SecretModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Spans of secrets in every whole text.

    Columns: ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_spans`` and ``spans`` (kind:start:end in code
    points, end exclusive).  A span of kind ``random`` is a run of 16 or more key characters, ``-`` and ``_``
    inside it included, whose mean log-likelihood ratio reaches ``threshold`` and that overlaps no base span.  Null and empty texts
    have no spans.  Rows are judged alone: repeated rows repeat, an empty table gives no rows, other columns are not
    read.
    """

    def start():
        def one(value: str | None) -> tuple:
            content = value or ""
            spans = all_spans(content, model, threshold)
            n = [sum(k == kind for *_, k in spans) for kind in KINDS]
            return *n, joined([s for s in spans if s[2] in BASE_KINDS], KINDS), joined(spans, KINDS)

        return one

    made = "n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"
    return map_texts(documents, [doc_id], text, made, start)


def redact(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(","))):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]



def redact_documents(documents: DataFrame, model: SecretModel, text: str = "text", length: str = "n_chars", threshold: float = 0.6) -> DataFrame:
    """The documents with every secret in ``text`` replaced by a mark and, where there is such a column, ``length`` in code points renewed.

    All columns and rows stay; a null text stays null.
    """
    ship(documents.sparkSession)
    at = documents.columns.index(text)
    counted = documents.columns.index(length) if length in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, joined(all_spans(t, model, threshold), KINDS)) if t else t for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array([o if t is None else len(t) for t, o in zip(texts, old, strict=True)], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(freeing(run), documents.schema)
